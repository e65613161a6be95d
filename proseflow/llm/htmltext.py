"""Operator 4: main text of web pages by consensus of container paths per host.

Every container of a page is scored: its own text counts for it, the text of links and of
what is marked as no content in it counts against it.  Scores vote for paths: the tags and
classes from the root, digits generalised, as a 64-bit digest.  The path with the highest
sum wins its host; a page is then read at the winning path where that covers the page's own
container, and otherwise at both, so that no text of either is lost.

Parsing takes time in proportion to the page, whatever is in it.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.llm.common import in_arrow, join_skewed, stored

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: An attribute in full, so that what its value holds is never taken for another one.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
#: Words of a text; in scripts without spaces each character counts as one.
_TEXT_WORD = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]|\w+")
#: Hosts whose winners are broadcast, at most: a digest and a name of 255 bytes at most each.
BROADCAST_HOSTS = 200_000

# Tags of HTML by kind, and words of class names by what they mark.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
#: Never text of an article, and what is so unless it holds the article itself.
DROPPED = frozenset("nav button select option svg canvas audio video menu dialog datalist".split())
BESIDE = frozenset("footer aside form fieldset".split())
BLOCKS = frozenset(
    "html head body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr pre blockquote figure "
    "figcaption header footer hr address details summary center nav aside form fieldset hgroup".split()
)
CONTAINERS = frozenset("article main section div td body center".split())
ENDS_P = BLOCKS - frozenset("html head body thead tbody tfoot tr caption".split())
KEEPS_P = CONTAINERS | frozenset("li table blockquote".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer footers masthead cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social tags related recommended "
    "recommendations comment comments disqus respond reply replies feedback toolbar pagination pager skip copyright legal disclaimer".split()
)
#: Of these, words that the text itself may be about.
AMBIGUOUS = frozenset("notice notices alert search share social related recommended respond reply replies feedback skip copyright legal disclaimer promotion".split())
#: What may stand beside such a word in a name without changing what the name marks.
FILLER = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content entry form global group header holder icon icons inline inner "
    "item items left link links list main message module nav outer page panel policy post posts reader right row section site slot small sticky stories story text thread title top unit user "
    "users view wide wrap wrapper".split()
)
HEADER = frozenset("header topbar".split())
OF_ARTICLE = frozenset("article entry post story content main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_GROUPS = {"#block": BLOCKS, "#container": CONTAINERS, "#keeps": KEEPS_P}
_GROUPS_OF = {tag: [g for g, tags in _GROUPS.items() if tag in tags] for tag in BLOCKS | KEEPS_P}


class Node:
    __slots__ = ("tag", "name", "kids", "words", "marks", "drop", "size", "linked", "noise", "holds", "titles")

    def __init__(self, tag: str, name: str = "", words: frozenset = frozenset(), marks: frozenset = frozenset(), drop: bool = False):
        self.tag, self.name, self.words, self.marks, self.drop = tag, name or tag, words, marks, drop
        self.kids: list = []
        self.size = self.linked = self.noise = 0
        self.titles = 0
        self.holds = tag in ("article", "main", "h1")


def marks_of(name: str) -> set[str]:
    """The words by which a whole class or id marks its element as no content: all else in it is filler."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    found = {p for p in parts if p in NOT_CONTENT}
    return found if all(p in NOT_CONTENT or p in FILLER or len(p) < 3 or p.isdigit() for p in parts) else set()


def _node(tag: str, attributes: str) -> Node:
    if not attributes or attributes == "/":
        return Node(tag, drop=tag in DROPPED)
    name, words, marks, drop = tag, set(), set(), tag in DROPPED
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "class":
            classes = sorted(set(value.split()))
            name = ".".join([tag, *(_DIGITS.sub("#", c) for c in classes)]).replace("/", "|")
            words.update(p.lower() for p in _PARTS.findall(value))
            marks.update(*map(marks_of, classes))
        elif key == "id":
            words.update(p.lower() for p in _PARTS.findall(value))
            marks |= marks_of(value)
        elif key == "role":
            drop |= value.lower() in ROLES
        elif key == "style":
            drop |= "display:none" in value.replace(" ", "").lower()
        elif key == "aria-hidden":
            drop |= value.lower() == "true"
        elif key == "hidden":
            drop = True
    return Node(tag, name, frozenset(words), frozenset(marks), drop)


class _Stack:
    """Open elements; where the last of each tag and kind of tags stands is known without a walk."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}
        self._note(root)

    def _note(self, node: Node) -> None:
        for key in (node.tag, *_GROUPS_OF.get(node.tag, ())):
            self.at.setdefault(key, []).append(len(self.nodes) - 1)

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self._note(node)

    def last(self, key: str) -> int:
        places = self.at.get(key)
        return places[-1] if places else -1

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            node = self.nodes.pop()
            for key in (node.tag, *_GROUPS_OF.get(node.tag, ())):
                self.at[key].pop()

    def close(self, tag: str) -> None:
        k = self.last(tag)
        barrier = self.last("#container") if tag == "p" else -1 if tag in BLOCKS else self.last("#block")
        if k > max(barrier, 0):
            self.cut(k)

    def open(self, tag: str) -> None:
        """Closes what the start of this element ends."""
        if tag in ENDS_P and (k := self.last("p")) > self.last("#keeps"):
            self.cut(k)
        if tag in SIBLINGS:
            k = max(map(self.last, SIBLINGS[tag]))
            if k > max(map(self.last, STOPS[tag])):
                self.cut(k)


def parse(html: str) -> Node:
    """A tree of the page, references decoded; the text of raw elements and comments is left out."""
    root = Node("body", "body")
    stack, at, begun = _Stack(root), 0, 0
    last_end, quoted, ends = html.rfind(">"), True, {}

    def text(until: int) -> None:
        if until > begun:
            stack.nodes[-1].kids.append(entities.unescape(html[begun:until]))

    while (m := _OPEN.search(html, at)) is not None:
        start, sign = m.start(), m[0]
        if sign == "<!--":
            end = html.find("-->", start + 4)
            text(start)
            at = begun = end + 3 if end >= 0 else len(html)
            continue
        if sign == "<![CDATA[":
            end = html.find("]]>", start)
            text(start)
            inner = html[start + 9 : end if end >= 0 else len(html)]
            if inner:
                stack.nodes[-1].kids.append(inner)
            at = begun = end + 3 if end >= 0 else len(html)
            continue
        if start > last_end:
            break
        if sign in ("<!", "<?"):
            text(start)
            at = begun = html.find(">", start) + 1
            continue
        # An unpaired quote makes the first pattern read to the end in vain: once is enough.
        t = _QUOTED.match(html, start) if quoted else None
        if t is None:
            quoted, t = False, _PLAIN.match(html, start)
        text(start)
        at = begun = t.end()
        tag = t[2].lower()
        if t[1]:
            stack.close(tag)
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in RAW:
            if tag not in ends:  # the places where such an element ends, once for the page
                ends[tag] = iter([(x.start(), x.end()) for x in re.finditer(rf"</{re.escape(tag)}\s*>", html, re.I)])
            at = begun = next((e for s, e in ends[tag] if s >= at), len(html))
            continue
        stack.open(tag)
        node = _node(tag, t[3])
        stack.nodes[-1].kids.append(node)
        if tag not in VOID:
            stack.push(node)
    text(len(html))
    return root


def measure(root: Node) -> None:
    """Marks what is no content, and sets for each element the sizes of its text, of that in links, and of what is dropped in it."""
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        inside |= node.tag in ("article", "main")
        todo += [(k, inside) for k in node.kids if type(k) is Node]
    sizes: dict[int, int] = {}  # text of each element that is not in links, dropped or not
    for node, _ in reversed(order):
        node.holds |= any(k.holds for k in node.kids if type(k) is Node)
        own = sum(len(k.strip()) if type(k) is str else sizes[id(k)] for k in node.kids)
        sizes[id(node)] = 0 if node.tag == "a" else own
    most = sizes[id(root)] / 2
    for node, inside in reversed(order):
        size = linked = noise = 0
        for k in node.kids:
            if type(k) is str:
                size += len(k.strip())
            else:
                noise += k.noise
                if k.drop:
                    noise += k.size
                else:
                    size += k.size
                    linked += k.linked
                    node.titles += k.titles
        node.titles += node.tag in HEADINGS and size > 0
        node.size, node.linked, node.noise = size, size if node.tag == "a" else linked, noise
        if not node.drop and node.tag not in ("body", "article", "main"):
            # The element that the text is in is no note beside it, whatever it is called.
            the_text = node.holds or sizes[id(node)] > most and 2 * node.linked < size and any(type(k) is Node and k.tag in BLOCKS for k in node.kids)
            node.drop = not the_text and (node.tag in BESIDE or _marked(node, inside) or (
                (node.tag == "header" or bool(node.words & HEADER)) and not inside and not node.words & OF_ARTICLE
            ))


def _marked(node: Node, inside: bool) -> bool:
    """Whether the names of an element mark it; a single block of text inside an article is judged by plain words only."""
    if node.tag in HEADINGS or node.tag in ("td", "th", "tr", "tbody", "li", "pre", "code"):
        return False
    holder = node.tag in CONTAINERS or node.tag in ("ul", "ol", "dl", "table", "header", "details")
    return bool(node.marks if holder or not inside else node.marks - AMBIGUOUS)


def has_text(node: Node, heavy: Node, chain: tuple | None) -> bool:
    """Whether two words or more stand in this element outside ``heavy``; what is nearly all links has none.

    chain: the elements between the two, as nested pairs.
    """
    between = set()
    while chain:
        chain, x = chain
        between.add(id(x))
    n, todo = 0, list(node.kids)
    while todo and n < 2:
        k = todo.pop()
        if type(k) is str:
            n += len(_TEXT_WORD.findall(k))
        elif k is not heavy and not k.drop and (id(k) in between or 10 * k.linked < 9 * k.size):
            todo += k.kids
    return n > 1


def path_of(names: str | list[str]) -> int:
    """Digest of a path from the root, such as ``body/div.post``."""
    key = 0
    for name in names.split("/") if isinstance(names, str) else names:
        key = below(key, name)
    return key


def below(key: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, key)


def scores(root: Node) -> dict[int, int]:
    """Score of each container's path, containers with one path added up: text less that of links and of what is dropped.

    In millionths of the page's highest, so that every page has the same weight.
    """
    found: dict[int, int] = {}
    todo = [(root, path_of("body"))]
    while todo:
        node, key = todo.pop()
        if node.tag in CONTAINERS:
            score = node.size - 2 * node.linked - node.noise
            if score > 0:
                found[key] = found.get(key, 0) + score
        todo += [(k, below(key, k.name)) for k in node.kids if type(k) is Node and not k.drop]
    most = max(found.values(), default=1)
    return {key: 1_000_000 * score // most for key, score in found.items()}


def best(root: Node) -> Node:
    """The page's own container of the article: the deepest beside which no heading and no text stands.

    A single word beside it, such as a label, is passed over if it is less than a fifth of the text.
    """
    node = root
    while True:
        heavy, todo = None, [(k, None) for k in node.kids if type(k) is Node and not k.drop]
        while todo:  # containers below, through other elements
            k, chain = todo.pop()
            if k.tag in CONTAINERS:
                if heavy is None or k.size - k.linked > heavy[0].size - heavy[0].linked:
                    heavy = k, chain
            else:
                todo += [(x, (chain, k)) for x in k.kids if type(x) is Node and not x.drop]
        if (
            heavy is None or not heavy[0].size or heavy[0].titles < node.titles
            or 5 * (heavy[0].size - heavy[0].linked) < 4 * (node.size - node.linked) or has_text(node, *heavy)
        ):
            return node
        node = heavy[0]


def at_path(root: Node, path: int) -> list[Node]:
    """Elements with this path, in page order."""
    found, todo = [], [(root, path_of("body"))]
    while todo:
        node, key = todo.pop()
        if key == path:
            found.append(node)
        else:
            todo += [(k, below(key, k.name)) for k in reversed(node.kids) if type(k) is Node and not k.drop]
    return found


def outermost(root: Node, nodes: list[Node]) -> list[Node]:
    """These elements in page order, without those inside another of them."""
    wanted, found, todo = set(map(id, nodes)), [], [root]
    while todo:
        node = todo.pop()
        if id(node) in wanted:
            found.append(node)
        else:
            todo += [k for k in reversed(node.kids) if type(k) is Node and not k.drop]
    return found


def text_of(nodes: list[Node]) -> str:
    blocks, run = [], []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    for top in nodes:
        todo = [(top, False)]
        while todo:
            x, done = todo.pop()
            if type(x) is str:
                run.append(x)
            elif done:
                flush()
            elif x.tag in VOID:
                flush() if x.tag == "hr" else run.append(" ") if x.tag == "br" else None
            elif not x.drop:
                if x.tag in ("td", "th"):
                    run.append(" ")
                if x.tag in BLOCKS:
                    flush()
                    todo.append((x, True))
                todo += [(k, False) for k in reversed(x.kids)]
        flush()
    return "\n\n".join(blocks)


def vote(html: str | None) -> dict[int, int]:
    measure(root := parse(html or ""))
    return scores(root)


def extract(html: str | None, winner: int | str | None) -> str:
    """The text of a page whose host's winning path is ``winner`` (its digest or its names)."""
    measure(root := parse(html or ""))
    node = best(root)
    nodes = at_path(root, path_of(winner) if isinstance(winner, str) else winner) if winner is not None else []
    inside = outermost(node, nodes)
    # Elements that hold all of the container's text, headings and all, stand for it.
    if inside and sum(x.size - x.linked for x in inside) >= node.size - node.linked and sum(x.titles for x in inside) >= node.titles:
        return text_of(nodes)
    return text_of(outermost(root, [*nodes, node]))


def winners_of(votes: DataFrame) -> DataFrame:
    """``host, winner, pages`` of ``votes(host, path, score, pages)``: the path with the highest sum, of equal ones the smallest digest."""
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("pages").alias("pages"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("winner"), F.max("pages").alias("pages"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, a row for each page.

    A null or empty page has the text ''.  Pages whose url is null or names no host have no
    host to vote with and are read at their own containers.  Repeated rows vote each and give
    a row each, null ids stay.  Long pages are read whole; their time grows with their length.
    Other columns of ``pages`` are not read.
    """
    host = F.nullif(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[tuple[str, int], list[int]] = {}
        for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for path, n in vote(html).items():
                own = total.setdefault((name, path), [0, 0])
                own[0] += n
                own[1] += 1
        signed = [p - (1 << 64) if p >> 63 else p for _, p in total]
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in total], pa.string()), pa.array(signed, pa.int64()), *(pa.array([x[k] for x in total.values()], pa.int64()) for k in (0, 1))], ["host", "path", "score", "pages"]
        )

    votes = in_arrow(rows.select("host", "html").where("host IS NOT NULL"), score, "host string, path long, score long, pages long")
    winners, _ = stored(winners_of(votes))
    few = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(winners), "host", "left") if few else join_skewed(rows, winners, ["host"], "pages", "left")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        texts = [extract(h, w if w is None else w & ((1 << 64) - 1)) for h, w in found]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)[id_col]
    return in_arrow(joined.select("page_id", "url", "html", "winner"), read, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
