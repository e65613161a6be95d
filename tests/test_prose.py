"""Functions and rules on sentences of our own with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.operators import dictionary, fidelity, rules_en, rules_ru, segments


def values(spark, expression, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_word_count(spark):
    cases = {
        "": 0, "One two.": 2, "Use (all of these) now": 3, 'Say "hello there" now': 3, "Wait 5 mm more": 3, "Wait 5mm": 2, "a well-known fact": 3,
        "- Remove it": 2, "WARNING: Stop": 1, "1. Push the button": 3, "It's fine": 2, "50% of it": 3, "naïve Ω": 2,
    }
    assert dict(zip(cases, values(spark, T.word_count, cases))) == cases


def test_headings(spark):
    cases = {"# A heading": True, "Before You Start": True, "---": True, "Before you start": False, "Stop.": False, "lower": False}
    assert dict(zip(cases, values(spark, T.is_heading, cases))) == cases


@pytest.mark.parametrize(
    ("core", "kind"),
    [
        ("--dry-run", "flag"), ("-ing", ""), ("https://a.example/x", "url"), ("main.go:12", "path"), ("a/b.c", "path"), ("and/or", ""), ("/usr", "path"),
        ("readme.md", "file"), (".bashrc", "file"), ("t.Run", "dotted"), ("e.g", ""), ("snake_case", "snake_case"), ("fooBar", "mixed_case"), ("Bar", ""),
        ("run()", "call"), ("JSON", "acronym"), ("NOTE", ""), ("12", ""),
    ],
)
def test_code_kind(spark, core, kind):
    assert values(spark, T.code_kind, [core]) == [kind]


def test_core_of(spark):
    cases = {"(word),": "word", "f(x).": "f(x)", "run())": "run()", "user's": "user", "“quoted”": "quoted", "plain": "plain"}
    assert dict(zip(cases, values(spark, T.core_of, cases))) == cases


def test_sentences(spark):
    text = "See Fig. 3 and No. 4, e.g. This one. Next: 5 of them. \"Quoted\" too! not here? Yes.\n\n# Title\n\n- one. Two\n- three"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.para, r.sent, r.text) for r in segments.sentences(df).orderBy("sent").collect()]
    assert got == [
        (1, 1, "See Fig. 3 and No. 4, e.g. This one."), (1, 2, "Next:"), (1, 3, "5 of them."), (1, 4, '"Quoted" too! not here?'), (1, 5, "Yes."),
        (3, 6, "- one."), (3, 7, "Two"), (3, 8, "- three"),
    ]


def test_strip_code(spark):
    cases = {
        "a `b` c ``d ` e`` f ` g": "a CODESPAN c CODESPAN f ` g",
        "x\n```go\ncode\n```\ny": "x\n\n\n\ny",
        "x\n~~~~\n~~~\n~~~~\ny": "x\n\n\n\ny",
        "x\n\n    code\n    more\n\ny": "x\n\n\n\n\ny",
        "- item\n\n    still the item": "- item\n\n    still the item",
        "x\n    same paragraph": "x\n    same paragraph",
        "```\nopen": "\n",
        "plain": "plain",
    }
    assert dict(zip(cases, values(spark, segments.strip_code, cases))) == cases


def test_findings(spark):
    def kinds(text):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return sorted((r.rule, r.match) for r in rules_en.findings(df).collect())

    assert kinds("The file was removed by the tool.") == [("3.6", "was removed")]
    assert kinds("The file is removed.") == [("3.6?", "is removed")]
    assert kinds("They have removed it; this is being done.") == [("3.4", "being"), ("3.4", "have removed"), ("3.6?", "being done"), ("8.1", ";")]
    assert kinds("It doesn't stop, e.g. for him. The user's name is there.") == [("4.2", "doesn't"), ("GR-6", "e.g."), ("GR-7", "him")]
    assert kinds("Do it when running. Use the running shoe.") == [("3.5", "running"), ("3.5?", "running")]
    assert kinds(" ".join(["word"] * 26) + ".") == [("6.3", "26")]
    assert kinds("Open " + " ".join(["word"] * 20) + ".") == [("5.1", "21")]
    assert kinds(" ".join(f"Sentence {k} is here." for k in range(7))) == [("6.6", "7")]
    assert kinds("The etcd string is a thing. `he said; it's` - no.") == [("GR-6", "etc")]


def test_cluster_findings(spark):
    from proseflow.plans import queries
    from proseflow.streaming import check

    text = "The server error log file name is removed. Use the pump motor drive belt."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = [(1, "2.1", "server error log file name"), (1, "3.6?", "is removed"), (2, "2.1", "pump motor drive belt")]
    assert [(r.sent, r.rule, r.match) for r in check.findings(df).orderBy("sent", "seq").collect()] == want
    found = queries.finding_counts(spark, "/root/testdata/sf0.001").where("kind = 'noun-cluster'").collect()
    total = queries.noun_clusters_documents(spark, "/root/testdata/sf0.001").selectExpr("sum(n) AS n").head().n
    assert [(r.rule, r.n) for r in found] == [("2.1", total)]


def test_order_and_tokens(spark):
    df = spark.createDataFrame([(1, "He can't make sure of it. Ask Bob about fooBar's JSON, (not this).")], "doc_id long, text string")
    assert [(r.tok, r.opaque) for r in segments.tokens(df).orderBy("sent", "ord").collect()] == [
        ("he", False), ("make_sure", False), ("of", False), ("it", False), ("ask", False), ("bob", True), ("about", False), ("<code>", True),
    ]
    assert [r.kind for r in rules_en.ordered(rules_en.findings(df)).orderBy("place").collect()] == ["contraction", "pronoun"]


def test_russian(spark):
    text = "Мы взяли API, а потом UIшку. не-API годится!\nСлово… и ещё. «Конец.» `код x` идёт."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.text for r in rules_ru.sentences(df).orderBy("sent").collect()] == [
        "Мы взяли API, а потом UIшку. не-API годится!", "Слово… и ещё.", "«Конец.»", f"{rules_ru.SPAN} идёт."
    ]
    assert [(r.rule, r.match) for r in rules_ru.findings(df).collect()] == [("glued", "UIшку")]
    assert [tuple(r) for r in rules_ru.verdict(df).collect()] == [(1, 1, 0, 1)]
    cases = {"a, b; c": 2, "раз — два": 1, "шёл, но упал": 1, "шёл но упал а встал": 2}
    assert dict(zip(cases, values(spark, rules_ru.clause_breaks, cases))) == cases
    assert [(r.line, r.col, r.tok) for r in rules_ru.tokens(spark.createDataFrame([(1, "раз два-три\n x")], "doc_id long, text string")).collect()] == [(1, 1, "раз"), (1, 5, "два-три"), (2, 2, "x")]


def brute_breaks(s):
    """As the reference: marks, and lower-case conjunctions with no mark before them."""
    n = len(re.findall(r"[,;]|(?<=\s)[—–](?=\s)", s))
    toks = list(re.finditer(r"\w+(?:[-'’]\w+)*", s))
    for k, t in enumerate(toks):
        pair = t[0] == "при" and k + 1 < len(toks) and toks[k + 1][0] == "этом"
        n += (t[0] in ("а", "но") or pair) and not s[: t.start()].rstrip().endswith((",", ";", "—", "–"))
    return n


def test_clause_breaks(spark):
    from proseflow.plans import queries
    from proseflow.sources import tables

    sf = "/root/testdata/sf0.001"
    texts = {(r.doc_id, r.sent): r.text for r in rules_ru.sentences(tables.russian(spark, sf)).collect()}
    got = {(r.doc_id, r.sent): r.n for r in queries.QUERIES["clause_breaks"](spark, sf).collect()}
    assert got == {k: brute_breaks(t) for k, t in texts.items()}
    assert any(re.search(r"\b(а|но|при этом)\b", t) for t in texts.values())
    cases = ["шёл а-б но упал", "шёл при  этом пел", "шёл при этом пел а пил", "А потом но", "раз, а два — но три", "но-но а"]
    assert values(spark, rules_ru.clause_breaks, cases) == [brute_breaks(s) for s in cases]


def test_fidelity(spark):
    rows = [
        (1, "Set 2.5 and 1,000 in `x y` at a/b.go:12 and ./c/d.md.", "Задайте 2,5 и 1 000 в ` x y ` у a/b.go:12 и ./c/d.md"),
        (2, "Set 3 at `x` in a.go:7, see /usr/lib. It may stop.", "Задайте 33."),
        (3, "It is so.", "Это точно так."),
    ]
    df = spark.createDataFrame(rows, "pair_id long, src_text string, out_text string")
    got = sorted((r.pair_id, r.kind, r.match) for r in fidelity.compare(df).collect())
    assert got == [(2, "code", "x"), (2, "file:line", "a.go:7"), (2, "hedge", "possible"), (2, "number", "3"), (2, "number", "7"), (2, "path", "/usr/lib"), (3, "hedge", "certain")]


def test_dictionary(spark):
    words = spark.createDataFrame([(w,) for w in "is tools tests removing removed ensures failing xyzzy makes cleaned jq".split()], "word string")
    got = {r.word: (r.kind, r.base) for r in dictionary.looked_up(words, glossary=["jq"]).collect()}
    assert got == {
        "is": ("approved", "be"), "tools": ("approved", "tool"), "tests": ("approved", "test"), "removing": ("approved-inflected", "remove"),
        "removed": ("approved", "remove"), "ensures": ("non_approved", "ensure"), "failing": ("non_approved", "fail"), "xyzzy": ("unknown", "xyzzy"),
        "makes": ("unknown", "makes"), "cleaned": ("approved", "clean"), "jq": ("glossary", "jq"),
    }


def test_stream_equals_batch(spark, tmp_path):
    from proseflow.streaming import check

    rows = [(i, "He can't stop. The file was removed by it.", "en", "s", 10) for i in range(5)]
    df = spark.createDataFrame(rows, check.DOCUMENTS)
    df.write.parquet(str(tmp_path / "in"))
    stream = check.findings(check.read_documents(spark, str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("findings").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    key = lambda r: tuple(r)
    assert sorted(map(key, spark.table("findings").collect())) == sorted(map(key, rules_en.findings(df).collect()))
