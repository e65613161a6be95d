"""Segmentation of documents: code, paragraphs, sentences and tokens.

All of it is array work inside the document's row.  Neighbours are array neighbours, so no
window and no shuffle is needed before an aggregate asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseflow.functions import text as T

# Phrases that are one token.
PHRASES = (
    "make sure,makes sure,made sure,away from,out of,in front of,because of,adjacent to,each other,in progress,put on,come on,go off,aft of,"
    "forward of,inboard of,outboard of,upstream of,downstream of,for example,as a result,at the same time"
).split(",")

INLINE_CODE = r"(?<!`)(`+)(?!`)([^\n]*?)(?<!`)\1(?!`)"
_SENTENCE_END = (
    r"(?<=[.!?:])(?<!(?:^|[^\p{L}\p{N}_])(?:" + "|".join(map(T.escaped, T.ABBREVIATIONS)) + r"))" + T.WS + r"+(?=[\"“(]?[A-Z0-9])"
)


def strip_code(text: Column, inline: bool = True) -> Column:
    """Code blocks become empty lines and, if ``inline``, inline spans one word, ``CODESPAN``.

    A fold over the lines keeps the opener of a fence, whether an indented block or a list
    goes on, and whether the last line was blank.
    """
    start = F.from_json(F.lit('{"open":"","indented":false,"list":false,"blank":true}'), "open STRING, indented BOOLEAN, list BOOLEAN, blank BOOLEAN")

    def step(s: Column, line: Column) -> tuple[Column, Column]:
        body = F.regexp_replace(line, r"^[ \t]+", "")
        fence = F.regexp_extract(body, r"^(`{3,}(?=[^`]*$)|~{3,})", 1)
        run = F.regexp_extract(body, r"^(`+|~+)\s*$", 1)
        inside = s["open"] != ""
        closes = inside & (run != "") & (F.left(run, F.lit(1)) == F.left(s["open"], F.lit(1))) & (F.length(run) >= F.length(s["open"]))
        empty = ~inside & ~body.rlike(r"\S")
        deep = line.rlike("^(    |\t)")
        block = ~inside & ~empty & deep & (s["indented"] | (s["blank"] & ~s["list"]))
        plain = ~inside & ~empty & ~block
        opens = plain & (fence != "")
        marker = line.rlike(T.LIST_MARKER)
        code = inside | block | opens
        kept = F.when(code, "").when(empty, line).otherwise(F.regexp_replace(line, INLINE_CODE, "CODESPAN") if inline else line)
        state = F.struct(
            F.when(closes, "").when(opens, fence).otherwise(s["open"]).alias("open"),
            F.when(plain, False).when(block, True).otherwise(s["indented"]).alias("indented"),
            F.when(plain & ~opens & marker, True).when(plain & ~opens & s["blank"] & ~deep, False).otherwise(s["list"]).alias("list"),
            empty.alias("blank"),
        )
        return state, F.array(kept)

    def of(text: Column) -> Column:  # most texts have no code, and many that have some have no block
        folded = F.array_join(T.fold_list(F.split(text, "\n", -1), start, step, "string"), "\n")
        spans = F.regexp_replace(text, INLINE_CODE, "CODESPAN") if inline else text
        return F.when(text.rlike(r"```|~~~|\n(?:    |\t)|^(?:    |\t)"), folded).otherwise(spans)

    return T.let(text, of)


def code_spans(text: Column) -> Column:
    """Inline spans and fenced blocks, in order: ``content, fenced``."""
    both = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^[ \t]*\1[^\n]*$|\z)|" + INLINE_CODE.replace(r"\1", r"\3").replace("(?ms)", "")
    found = F.regexp_extract_all(text, F.lit(both), F.lit(0))
    fenced = lambda x: x.rlike(r"^[ \t]*(```|~~~)")

    def one(x: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(x, r"^[ \t]*(`{3,}|~{3,})[^\n]*\n", ""), r"\n?[ \t]*(`{3,}|~{3,})[^\n]*\z", "")
        return F.struct(F.when(fenced(x), inner).otherwise(F.trim(F.regexp_replace(x, "^`+|`+$", ""))).alias("content"), fenced(x).alias("fenced"))

    return F.transform(found, one)


def paragraphs_of(text: Column) -> Column:
    """Maximal runs of lines that are not blank, as an array of blocks."""
    blocks = T.let(text, lambda x: T.split_at(x, rf"\n(?:{T.WS}*\n)+"))
    edges = F.transform(blocks, lambda b: F.regexp_replace(b, rf"\A(?:{T.WS}*\n)+|(?:\n{T.WS}*)+\z", ""))
    return F.filter(edges, lambda b: b.rlike(T.NOT_WS))


def is_heading_block(block: Column) -> Column:
    return ~block.contains("\n") & T.is_heading(block)


def is_list_block(block: Column) -> Column:
    lines = F.split(block, "\n", -1)
    return F.size(F.filter(lines, lambda x: x.rlike(T.LIST_MARKER))) >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2))


def sentences_of_line(block: Column) -> Column:
    pieces = F.transform(T.let(block, lambda x: T.split_at(x, _SENTENCE_END)), lambda s: T.trimmed(F.replace(s, F.lit("<DOT>"), F.lit("."))))
    return F.filter(pieces, lambda s: s != "")


def sentences_of(block: Column, listed: Column | None = None) -> Column:
    """Sentences of a paragraph: lines of a list apart, lines of prose together.  listed: whether it is a list, if that is known."""
    listed = is_list_block(block) if listed is None else listed
    lines = F.split(block, "\n", -1)
    apart = F.flatten(F.transform(lines, sentences_of_line))
    together = sentences_of_line(F.array_join(F.transform(lines, T.trimmed), " "))
    return F.when(listed, apart).otherwise(together)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, para, block, is_heading, is_list``; numbers count headings."""
    blocks = docs.select("doc_id", F.posexplode(paragraphs_of(strip_code(T.lf_normalised(F.col("text"))))).alias("para", "block"))
    heading = is_heading_block(F.col("block"))
    return blocks.select("doc_id", (F.col("para") + 1).alias("para"), "block", heading.alias("is_heading"), (~heading & is_list_block(F.col("block"))).alias("is_list"))


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, para, sent, text``; ``sent`` counts through the document and skips headings."""
    return counted_sentences(docs).drop("n")


def counted_sentences(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id, para, sent, text, n`` and other columns: ``n`` is how many sentences a paragraph of prose has, given with its first."""
    none = F.expr("array()").cast("array<struct<para:int,text:string,n:int>>")

    def of(b: Column, i: Column) -> Column:
        each = lambda ss, listed: F.transform(ss, lambda s, k: F.struct((i + 1).alias("para"), s.alias("text"), F.when((k == 0) & ~listed, F.size(ss)).alias("n")))
        prose = T.let(is_list_block(b), lambda listed: T.let(sentences_of(b, listed), lambda ss: each(ss, listed)))
        return F.when(is_heading_block(b), none).otherwise(prose)

    by_para = F.transform(paragraphs_of(strip_code(T.lf_normalised(F.col("text")))), of)
    flat = docs.select("doc_id", *others, F.posexplode(F.flatten(by_para)).alias("sent", "s"))
    return flat.select("doc_id", F.col("s.para").alias("para"), (F.col("sent") + 1).alias("sent"), F.col("s.text").alias("text"), F.col("s.n").alias("n"), *others)


def shown_sentences(docs: DataFrame) -> DataFrame:
    """``sentences`` with ``shown``, the sentence with its inline code back in place."""
    spans = F.when(F.col("text").contains("`"), F.regexp_extract_all(strip_code(T.lf_normalised(F.col("text")), inline=False), F.lit(INLINE_CODE), F.lit(0)))
    rows = docs.select("doc_id", "text", spans.alias("spans"))
    each = counted_sentences(rows, "spans")
    used = F.size(F.split("text", "CODESPAN")) - 1
    before = F.sum(used).over(Window.partitionBy("doc_id").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1))
    plain = each.where("spans IS NULL OR size(spans) = 0").select("doc_id", "para", "sent", "text", F.col("text").alias("shown"))
    coded = each.where("size(spans) > 0").withColumn("before", F.coalesce(before, F.lit(0)))
    at = lambda i: (F.col("before") + i - 1).cast("int")
    put = F.transform(F.split("text", "CODESPAN"), lambda p, i: F.concat(F.when(i > 0, F.coalesce(F.get("spans", at(i)), F.lit("CODESPAN"))).otherwise(""), p))
    return plain.unionByName(coded.select("doc_id", "para", "sent", "text", F.array_join(put, "").alias("shown")))


def marked(sentence: Column) -> Column:
    """The sentence with code-like tokens other than acronyms as ``GLOSSARYAUTO``."""
    plain = F.replace(sentence, F.lit("’"), F.lit("'"))

    def one(chunk: Column) -> Column:
        masked = lambda core: F.when(T.code_kind(core).isin("", "acronym"), chunk).otherwise(F.replace(chunk, core, F.lit("GLOSSARYAUTO")))
        return F.when(chunk.rlike("^" + T.MAYBE_CODE), T.let(T.core_of(chunk), masked)).otherwise(chunk)

    looks = lambda x: x.rlike(r"[A-Za-z0-9][._/:][A-Za-z0-9]|[A-Za-z0-9][A-Z]|--?[A-Za-z]|\(\)|/|_|(^|\s)\.")
    chunks = lambda x: F.regexp_extract_all(x, F.lit(f"{T.NOT_WS}+|{T.WS}+"), F.lit(0))
    return T.let(plain, lambda x: F.when(looks(x), F.array_join(F.transform(chunks(x), one), "")).otherwise(x))


def auto_terms(sentence: Column, is_known=None) -> Column:
    """Code-like tokens of a sentence, ``term, kind``; a shouted sentence has no acronyms, and words that are known (in lower case) are none."""
    plain = F.replace(sentence, F.lit("’"), F.lit("'"))
    cores = F.transform(F.regexp_extract_all(plain, F.lit(rf"(?<!{T.NOT_WS}){T.MAYBE_CODE}{T.NOT_WS}*"), F.lit(0)), T.core_of)
    found = F.transform(cores, lambda c: F.struct(c.alias("term"), T.code_kind(c).alias("kind")))
    some = F.filter(found, lambda x: x["kind"] != "")
    word = lambda x: is_known(F.lower(x["term"])) if is_known else F.lit(False)
    quiet = lambda xs: T.let(T.is_shouted(plain), lambda loud: F.filter(xs, lambda x: (x["kind"] != "acronym") | ~(loud | word(x))))
    return T.let(some, lambda xs: F.when(F.exists(xs, lambda x: x["kind"] == "acronym"), quiet(xs)).otherwise(xs))


def _joined(work: Column, phrases: list[str], by) -> Column:
    """Each phrase, in order and in any case, replaced where it stands between word ends.  Most sentences have none: they are asked once."""
    word = r"[\p{L}\p{N}_]"
    replaced = work
    for phrase in phrases:
        replaced = F.regexp_replace(replaced, rf"(?iu)(?<!{word}){T.escaped(phrase)}(?!{word})", by(phrase))
    return F.when(work.rlike(rf"(?iu)(?<!{word})(?:{T.trie_pattern(phrases)})"), replaced).otherwise(work)


def tokens_of(sentence: Column, terms: list[str] = ()) -> Column:
    """Tokens for the word rules: ``tok`` in lower case, ``opaque`` for names and code.

    Parentheses, quotations, list markers and labels go; set phrases are one token joined by
    ``_``; words in capitals, code spans and contractions vanish; a possessive loses its ending.
    terms: of several words, longest first; each is one opaque token.
    """
    return plain_tokens(marked(sentence), terms)


def plain_tokens(masked: Column, terms: list[str] = ()) -> Column:
    """``tokens_of`` a sentence that is ``marked`` already."""
    work = F.regexp_replace(F.regexp_replace(masked, r"\([^()]*\)", " "), "\"[^\"]+\"|“[^”]+”", " ")
    work = F.regexp_replace(F.regexp_replace(work, T.LIST_MARKER, ""), T.LABEL, "")
    if terms:
        work = T.let(work, lambda w: _joined(w, list(terms), lambda p: "GLOSSARYTERM"))
    work = T.let(work, lambda w: _joined(w, PHRASES, lambda p: p.replace(" ", "_")))
    raw = F.regexp_extract_all(work, F.lit(r"[A-Za-z][A-Za-z'\-_]*"), F.lit(0))

    def one(tok: Column, i: Column) -> Column:
        low = F.lower(tok)
        gone = tok.contains("'") & (low.endswith("n't") | low.isin(T.CONTRACTIONS))
        other = F.when(~gone, T.let(F.substring_index(tok, "'", 1), lambda bare: token(bare, i)))
        # Most tokens are words in lower case, which stand as they are.
        return F.when(~tok.rlike("[A-Z']"), F.struct(tok.alias("tok"), F.lit(False).alias("opaque"))).otherwise(other)

    def token(bare: Column, i: Column) -> Column:
        auto, term = bare == "GLOSSARYAUTO", bare == "GLOSSARYTERM"
        upper = T.is_upper_word(bare)
        gone = ~auto & ~term & upper & (F.length(bare) > 1)
        opaque = auto | term | ((i > 0) & bare.rlike("^[A-Z]") & ~upper & ~bare.contains("_"))
        return F.when(~gone, F.struct(F.when(auto, "<code>").when(term, "<term>").otherwise(F.lower(bare)).alias("tok"), opaque.alias("opaque")))

    return F.array_compact(F.transform(raw, one))


def tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, sent, ord, tok, opaque``."""
    rows = sentences(docs).select("doc_id", "sent", F.posexplode(tokens_of(F.col("text"))).alias("ord", "t"))
    return rows.select("doc_id", "sent", (F.col("ord") + 1).alias("ord"), F.col("t.tok").alias("tok"), F.col("t.opaque").alias("opaque"))
