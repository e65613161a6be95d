"""Operator 4 on small pages with known articles."""

import pytest

from proseflow.llm import htmltext

SITE = "<nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>{}<footer>(c)</footer>"
PAGE = SITE.format(
    "<div class=wrap><div class='post post-{n}'><header class=entry-header><h1>T&eacute;st {n}</h1></header><div class=entry-content>"
    "<p>One  <i>two</i>\nthree&nbsp;four.<p>Five &lt;six&gt; &amp;amp;<ul><li>a<li>b</ul><p>long text, long text</div></div>"
    "<div class=comments><p>nice</p></div><aside>side</aside></div><form>f</form><script>if (a<b) {{'</div>'}}</script>"
)
TEXT = "Tést {n}\n\nOne two three four.\n\nFive <six> &amp;\n\na\n\nb\n\nlong text, long text"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<", "<"), ("a < b > c", "a < b > c"), ("<div><div><p>", ""), ("</p></div>x", "x"), ("<!-- x", ""),
        ("plain", "plain"), ("<p>x</p>" * 3, "x\n\nx\n\nx"), ("<script>x", ""), ("<p><b>A<br><p>B c</p>", "A\n\nB c"),
        ("<article><h1>T</h1><p>x<br>y</p></article><p class=ad>z", "T\n\nx y"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
        ("<body class='has-sidebar'><main><p>kept</p></main></body>", "kept"), ("<div hidden>h</div><p>x</p>", "x"),
        ("<div>" * 20000 + "deep", "deep"),
    ],
)
def test_extract(html, text):
    assert htmltext.extract(html, None) == text


def test_consensus(spark):
    odd = SITE.format("<div class='post post-7'><p>tiny</p></div><div class=other>" + "<p>the real article is here</p>" * 9 + "</div>")
    rows = [(i, "https://u@A.example:80/x", PAGE.format(n=i)) for i in range(5)] + [(5, "http://a.example", odd), (6, None, PAGE.format(n=6)), (7, "no url", None), (7, "http://b", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS path", "2 AS winner", "3 AS text")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in htmltext.main_text(df).collect()}
    assert len(got) == 9
    for i in [0, 1, 2, 3, 4]:
        assert got[i, "https://u@A.example:80/x"] == (TEXT.format(n=i), len(TEXT.format(n=i)))
    assert got[5, "http://a.example"][0] == "\n\n".join(["the real article is here"] * 9)
    assert got[6, None][0] == TEXT.format(n=6)
    assert got[7, "no url"] == got[7, "http://b"] == ("", 0)
    assert htmltext.main_text(df.limit(0)).count() == 0


WINNER = "body/div.wrap/div.content"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<div class=content><p>aaaaa aaaa aaaaa</div><div class=part><div class=extra><p>bbbb bbbbb</div></div>", "aaaaa aaaa aaaaa\n\nbbbb bbbbb"),
        ("<div class=part><p>bbbb bbbbb</div><div class=content><p>aaaaa aaaa aaaaa</div>", "bbbb bbbbb\n\naaaaa aaaa aaaaa"),
        ("<div class=content><p>aaaaa aaaa</p><div class=part><p>bbbb bbbbb cccc dddd eeee ffff gggg hhhh iiii</div></div>", "aaaaa aaaa\n\nbbbb bbbbb cccc dddd eeee ffff gggg hhhh iiii"),
        ("<div class=content><p>aaaaa aaaa</div><div class=content><p>bbbb bbbb</div>", "aaaaa aaaa\n\nbbbb bbbb"),
        ("<div class=other><p>bbbb bbbb</div>", "bbbb bbbb"),
    ],
)
def test_winner_loses_no_text(inner, text):
    assert htmltext.extract(SITE.format(f"<div class=wrap>{inner}</div>"), WINNER) == text


LONG = "<p>" + "long text of the body " * 20 + "</p>"


@pytest.mark.parametrize(
    ("html", "first"),
    [
        (f"<main><h2>Head</h2><div class=lead><p>some lead text</div><div class=body>{LONG}</div></main>", "Head\n\nsome lead text\n\nlong"),
        (f"<main><div class=lead><p>some lead text</div><div class=body>{LONG}</div></main>", "some lead text\n\nlong"),
        (f"<body><h1>T</h1><p>intro of it</p><article>{LONG}</article></body>", "T\n\nintro of it\n\nlong"),
        (f"<body><h1>T</h1><article>{LONG}</article></body>", "T\n\nlong"),
        (f"<div>A <b>bold</b> start<div>too little<div>{LONG}</div></div></div>", "A bold start\n\ntoo little\n\nlong"),
        (f"<div><p>前書きの文です</p><article>{LONG}</article></div>", "前書きの文です\n\nlong"),
        (f"<ul><li>own text<div>{LONG}</div></ul>", "own text\n\nlong"),
        (f"<ul><li><a href=x>One link</a> | <a href=y>Another link</a></ul>&middot;<div class=ad>ad text</div><article>{LONG}</article>", "long"),
    ],
)
def test_descent_loses_no_text(html, first):
    assert htmltext.extract(html, None).removesuffix(" ".join(["long text of the body"] * 20)) == first.removesuffix("long")


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<p>The <math>x</math> value</p><section id='related-work'><h2>Work</h2><p>of others</p></section>", "The x value\n\nWork\n\nof others"),
        ("<p class='legal'>of the law</p><div id='search-algorithms'><p>to search</p></div><p class=notice-period>a month</p>", "of the law\n\nto search\n\na month"),
        ("<p>Body text</p><div class='comment-list'><p>I agree</p></div><div id=reader-comments><p>me too</p></div>", "Body text"),
        ("<p>Body text</p><div class='cookie-banner'><p>We use cookies</p></div><p class=ad>Buy now</p><div class=social-share>Share it</div>", "Body text"),
        ("<p>AT&<b>lt;</b> &am<!-- -->p; &lt;</p>", "AT&lt; &amp; <"),
    ],
)
def test_names_of_elements_decide_with_the_score(inner, text):
    assert htmltext.extract(f"<nav>Menu</nav><article><h1>T</h1>{inner}</article>", None) == "T\n\n" + text


def test_form_around_the_page():
    assert htmltext.extract("<form><div><h1>T</h1><p>some text here</p></div></form>", None) == "T\n\nsome text here"


@pytest.mark.parametrize("unit", ["<a ", "<b><hr>", "<div>", '<a ">" ', "<b></i>", "<!--", "<b"])
def test_time_grows_with_the_page(unit):
    import time

    start = time.time()
    htmltext.extract(unit * (300_000 // len(unit)), None)
    assert time.time() - start < 8


def test_vote_against_plain_count(spark):
    """Winners equal those of votes counted on the driver; ties fall to the smallest digest, repeated rows vote twice."""
    pages = ["<div class=a><p>one two</p></div><div class=b><p>three four</p></div>", "<div class=a><p>x y z</p></div><nav>n</nav>", "<div class=b><p>x y z</p></div><nav>n</nav>"]
    rows = [(i, f"http://h{i % 3}", pages[i % 2 if i % 3 else 0]) for i in range(12)] + [(None, "http://h0", pages[2])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for _, url, html in rows:
        for path, n in htmltext.vote(html).items():
            sums = want.setdefault(url[7:], {})
            sums[path - (1 << 64) if path >> 63 else path] = sums.get(path - (1 << 64) if path >> 63 else path, 0) + n
    votes = [(h, p, n, 1) for h, x in want.items() for p, n in x.items()]
    got = {r.host: r.winner for r in htmltext.winners_of(spark.createDataFrame(votes, "host string, path long, score long, pages long")).collect()}
    assert got == {h: min(x, key=lambda p: (-x[p], p)) for h, x in want.items()}
    few = sorted((str(r.page_id), r.text) for r in htmltext.main_text(df).collect())
    limit, htmltext.BROADCAST_HOSTS = htmltext.BROADCAST_HOSTS, 0  # the way for more hosts than are broadcast
    try:
        assert sorted((str(r.page_id), r.text) for r in htmltext.main_text(df).collect()) == few and len(few) == 14
    finally:
        htmltext.BROADCAST_HOSTS = limit


BODY = "The valley lies between two hills and the river runs through it for many miles."


@pytest.mark.parametrize("html", [
    f'<article data-title="Hidden valleys"><p>{BODY}</p></article>', f'<div title="the hidden valley"><p>{BODY}</p></div>', f'<p title="A hidden gem">{BODY}</p>',
    f'<p data-class="ad">{BODY}</p>', f"<article data-x='role=\"dialog\"'><p>{BODY}</p></article>", f'<p title="id=ad class=menu style=display:none">{BODY}</p>',
    f'<p data-hidden>{BODY}</p>', f'<p data-hidden=1 lang=en>{BODY}</p>', f'<article alt="x > hidden"><p>{BODY}</p></article>',
])
def test_values_of_attributes_are_no_attributes(html):
    assert htmltext.extract(html, None) == BODY
    assert htmltext.extract(f"<nav>menu</nav>{html}", None) == BODY


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'hidden=""', "hidden='until-found'", 'aria-hidden="true"', 'ROLE="dialog"', "title='x' hidden", 'style="display: none"'])
def test_hidden_elements(attributes):
    assert htmltext.extract(f"<article><p>{BODY}</p><div {attributes}>Do not read this text at all.</div></article>", None) == BODY


@pytest.mark.parametrize("name", ["share-buttons", "related-articles", "social-icons", "cookie-policy", "tags", "post-tags"])
def test_names_of_lists_beside_the_text(name):
    assert htmltext.extract(f'<article><p>{BODY}</p><p>{BODY}</p><div class="{name}"><p>Tell your friends about this one now.</p></div></article>', None) == f"{BODY}\n\n{BODY}"
