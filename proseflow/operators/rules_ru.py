"""The rules for Russian that need no inflected lexicon: masks and places, scripts, sentence length, clause breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.sources.storage import checkpointed

SENTENCE_LIMIT = 25
CLAUSE_LIMIT = 2
#: Stand for the first character of an inline code span, that of an address, and every other one of code.
SPAN, ADDRESS, CODE = "\ue000", "\ue001", "\ue003"
INLINE = r"(?<!`)(`+)(?!`)([^\n]*?)(?<!`)\1(?!`)"
URL = r"https?://[^\s)>\]]+"
#: A line in full: spans, addresses, and what is neither.
_COVER = rf"{INLINE}|`+|{URL}|h|[^`h]+"  # an address starts with "http"; an "h" alone is not one
_WORD = r"[\p{L}\p{Nd}_]"
#: A stop with its closers before white space that no lower case follows.
_STOP = rf"([.!?…][.!?…»\")*]*)(\s+)(?=[^\p{{Ll}}\s{ADDRESS}])"
_CUT = "\ue002"
#: A line that starts with a conjunction.
_CONJUNCTION = r"^\s*(?:а|но|при)(?!\p{L})"

#: A small list of Latin words that Russian prose may hold; users give their own.
ALLOWED = frozenset("api json http sql linux docker kafka spark go".split())


_FENCE = r"^\s*(```|~~~)"


def fenced_lines(lines: Column) -> Column:
    """Whether each line is in a fenced block, which its fences are part of; one that is not closed goes on to the end.

    A fence is a line that starts with three backticks or tildes; it closes at the next that starts with the same.
    """

    def step(open_: Column, x: Column) -> tuple[Column, Column]:
        mark = F.regexp_extract(x, _FENCE, 1)
        inside = open_ != ""
        return F.when(~inside, mark).when(mark == open_, "").otherwise(open_), F.array(inside | (mark != ""))

    return T.fold_list(lines, F.lit(""), step, "boolean")


def fenced_blocks(lines: Column) -> Column:
    """``first, last``: the fences of each block; ``last`` is the number of lines if there is none."""
    starts = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, _FENCE, 1).alias("mark")))
    marks = F.concat(F.filter(starts, lambda x: x["mark"] != ""), F.array(F.struct(F.size(lines).alias("at"), F.lit("end").alias("mark"))))
    begin = F.struct(F.lit("").alias("open"), F.lit(0).alias("since"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        opens, closes = s["open"] == "", (s["open"] == x["mark"]) | (x["mark"] == "end")
        state = F.struct(
            F.when(opens, x["mark"]).when(closes, "").otherwise(s["open"]).alias("open"), F.when(opens, x["at"]).otherwise(s["since"]).cast("int").alias("since")
        )
        block = F.array(F.struct(s["since"].alias("first"), x["at"].cast("int").alias("last")))
        return state, F.when(~opens & closes, block).otherwise(F.expr("array()").cast("array<struct<first:int,last:int>>"))

    return T.fold_list(marks, begin, step, "struct<first:int,last:int>")


def _line(line: Column) -> Column:
    """A line of prose with spans and addresses masked, as long as before."""
    masked = lambda x, mark: F.concat(F.lit(mark), F.repeat(F.lit(CODE), F.length(x) - 1))
    one = lambda x: F.when(x.rlike("^`+[^`]"), masked(x, SPAN)).when(x.startswith("http"), masked(x, ADDRESS)).otherwise(x)
    covered = F.array_join(F.transform(F.regexp_extract_all(line, F.lit(_COVER), F.lit(0)), one), "")
    return F.when(line.rlike("`|https?://"), covered).otherwise(line)


def masked_lines(text: Column) -> Column:
    """The lines of a text, each as long as it was, with code and addresses masked."""

    def of(lines: Column) -> Column:
        blank = lambda x: F.repeat(F.lit(CODE), F.length(x))
        fenced = F.zip_with(lines, fenced_lines(lines), lambda x, inside: F.when(inside, blank(x)).otherwise(_line(x)))
        return F.when(text.rlike("```|~~~"), fenced).otherwise(F.transform(lines, _line))

    plain = F.split(text, "\n", -1)
    return F.when(text.rlike("`|~~~|https?://"), T.let(plain, of)).otherwise(plain)


def prose(text: Column) -> Column:
    """The text with code and addresses as spaces, every other character in its place."""
    return F.translate(F.array_join(masked_lines(text), "\n"), SPAN + ADDRESS + CODE, "   ")


def placed_sentences(text: Column) -> Column:
    """Sentences with at least one word: ``line, col, text, raw, around``.

    Per line, after a stop and its closers, unless lower case follows.  ``text`` has code masked,
    ``raw`` has it as it stands, ``around`` is the text between what stands before and after it
    in the document: a space in place of white space, and the last character before that.
    """

    def of_line(line: Column, raw: Column, i: Column, lines: Column, befores: Column) -> Column:
        step = lambda at, x: ((at + F.length(x["piece"])).cast("int"), F.array(F.struct(at.alias("at"), x["piece"].alias("piece"), x["raw"].alias("raw"))))
        with_raw = lambda ps: F.zip_with(ps, F.when(line == raw, ps).otherwise(T.cut_like(raw, ps)), lambda p, r: F.struct(p.alias("piece"), r.alias("raw")))
        several = lambda ps: T.fold_list(with_raw(ps), F.lit(1), step, "struct<at:int,piece:string,raw:string>")
        alone = F.array(F.struct(F.lit(1).alias("at"), line.alias("piece"), raw.alias("raw")))
        placed = T.let(F.split(F.regexp_replace(line, _STOP, f"$1$2{_CUT}"), _CUT, -1), lambda ps: F.when(F.size(ps) == 1, alone).otherwise(several(ps)))
        # Only a conjunction that starts a line asks what the lines before it end with.
        before = F.when(line.rlike(_CONJUNCTION), F.get(befores, i)).otherwise("")

        def one(p: Column, k: Column, count: Column) -> Column:
            lead = F.length(F.regexp_extract(p["piece"], r"^\s*", 0))
            first, last = k == 0, k == count - 1
            front = F.when(first, F.when(i == 0, "").otherwise(F.concat(before, F.lit(" ")))).otherwise(" ")
            return F.struct(
                (i + 1).alias("line"), (p["at"] + lead).alias("col"), F.regexp_replace(p["piece"], r"^\s+|\s+\z", "").alias("text"),
                F.regexp_replace(p["raw"], r"^\s+|\s+\z", "").alias("raw"),
                F.concat(front, p["piece"], F.when(last & (i + 1 < F.size(lines)), " ").otherwise("")).alias("around"),
            )

        return F.filter(T.let(placed, lambda found: F.transform(found, lambda p, k: one(p, k, F.size(found)))), lambda s: s["text"].rlike(_WORD))

    def of(lines: Column, raw: Column) -> Column:
        ends = lambda last, x: (T.let(F.regexp_extract(x, r"(\S)\s*$", 1), lambda c: F.when(c == "", last).otherwise(c)), F.array(last))
        befores = F.when(F.exists(lines, lambda x: x.rlike(_CONJUNCTION)), T.fold_list(raw, F.lit(""), ends, "string"))
        return T.let(befores, lambda known: F.flatten(F.transform(lines, lambda x, i: of_line(x, F.get(raw, i), i, raw, known))))

    return T.let(F.split(text, "\n", -1), lambda raw: T.let(masked_lines(text), lambda lines: of(lines, raw)))


def sentences_of(text: Column) -> Column:
    """The texts of ``placed_sentences``."""
    return F.transform(placed_sentences(text), lambda s: s["text"])


def tokens_of(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(T.TOKEN), F.lit(0))


def parts_of(token: Column) -> Column:
    return F.split(token, "[-'’]")


def length_of(sentence: Column) -> Column:
    """Words and inline spans."""
    return F.size(tokens_of(sentence)) + F.length(F.regexp_replace(sentence, f"[^{SPAN}]", ""))


def clause_breaks(sentence: Column) -> Column:
    """Commas and semicolons, dashes between spaces, and conjunctions that follow none of these.

    sentence: with what stands around it, as ``around`` of ``placed_sentences`` or alone.
    """
    marks = r"[,;]|(?<=\s)[—–](?=\s)"
    ends = rf"(?!{_WORD}|[-'’]{_WORD})"
    words = rf"(?<!{_WORD})(?<!{_WORD}[-'’])(?<![,;—–])(?:а|но|при(?=[^\p{{L}}\p{{Nd}}_]+этом{ends})){ends}"
    # White space after a mark goes, so that the mark stands right before what follows it.
    count = lambda s: F.regexp_count(s, F.lit(marks)) + F.regexp_count(F.regexp_replace(s, r"([,;—–])\s+", "$1"), F.lit(words))
    # What stands before the sentence is no part of it.
    extra = F.when(sentence.rlike(r"^[,;]\s"), 1).otherwise(0)
    return count(sentence) - extra


def is_allowed_latin(token: Column, allowed: frozenset[str] = ALLOWED) -> Column:
    """The token, or each part of it, is one character, a number, a label such as A1, or allowed."""

    def fine(x: Column) -> Column:
        return (F.length(x) <= 1) | x.rlike(r"^(\p{Nd}+|[A-Za-z]{1,2}[0-9]+)$") | F.lower(x).isin(sorted(allowed))

    return fine(token) | F.forall(parts_of(token), fine)


def is_glued(token: Column) -> Column:
    """Latin and Cyrillic in one token, but for a Latin word after ``не-``."""
    both = token.rlike("[A-Za-z]") & token.rlike(r"\p{IsCyrillic}")
    negated = T.normalised(token).startswith("не-") & ~F.regexp_replace(token, "^..-", "").rlike(r"\p{IsCyrillic}")
    return both & ~negated


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sent, text``, with one SPAN for inline code and a space for an address."""
    text = F.translate(F.translate(F.col("text"), CODE, ""), ADDRESS, " ")
    return placed(docs).select("doc_id", "sent", F.regexp_replace(text, r"^\s+|\s+\z", "").alias("text"))


def placed(docs: DataFrame, *others: Column) -> DataFrame:
    """``doc_id, sent, line, col, text, raw, around`` and other columns of the documents, which may be ``stored_sentences``."""
    if "tokens" in docs.columns:
        return docs.select("doc_id", "sent", *others, "line", "col", "text", "raw", "around", "tokens")
    rows = docs.select("doc_id", *others, F.posexplode(placed_sentences(F.col("text"))).alias("sent", "s"))
    return rows.withColumn("sent", F.col("sent") + 1).select("*", "s.*").drop("s")


def stored_sentences(docs: DataFrame, *others: Column) -> DataFrame:
    """``placed`` with the tokens of each sentence, worked out once for rules that each read all of them."""
    return checkpointed(placed(docs, *others).withColumn("tokens", placed_tokens(F.col("text"), F.col("col"))))


def tokens_in(rows: DataFrame) -> Column:
    """The tokens of each row of ``placed``."""
    return F.col("tokens") if "tokens" in rows.columns else placed_tokens(F.col("text"), F.col("col"))


def placed_tokens(sentence: Column, col: Column) -> Column:
    """``tok, col, gap``: the tokens of a sentence that starts in this column, and what stands before each.

    A pattern that covers the text gives tokens and gaps; lengths of what comes before are offsets.
    """
    pieces = F.regexp_extract_all(sentence, F.lit(rf"{T.TOKEN}|[^\p{{L}}\p{{Nd}}_]+"), F.lit(0))
    none = F.expr("array()").cast("array<struct<tok:string,col:int,gap:string>>")

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        word = x.rlike("^" + _WORD)
        state = F.struct((a["at"] + F.length(x)).cast("int").alias("at"), F.when(word, "").otherwise(x).alias("gap"))
        return state, F.when(word, F.array(F.struct(x.alias("tok"), a["at"].alias("col"), a["gap"].alias("gap")))).otherwise(none)

    return T.fold_list(pieces, F.struct(col.cast("int").alias("at"), F.lit("").alias("gap")), step, "struct<tok:string,col:int,gap:string>")


def tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, line, col, tok``: positions count code points from 1."""
    # No sentence ends inside a token, so lines are enough.
    rows = docs.select("doc_id", F.posexplode(masked_lines(F.col("text"))).alias("at", "x")).where(F.col("x").rlike(_WORD))
    rows = rows.select("doc_id", (F.col("at") + 1).alias("line"), F.explode(placed_tokens(F.col("x"), F.lit(1))).alias("t"))
    return rows.select("doc_id", "line", "t.col", "t.tok")


def findings(docs: DataFrame, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """``doc_id, sent, rule, hard, match``: glued and Latin tokens, long sentences, many clauses."""
    return placed_findings(docs, allowed).drop("ord")


def placed_findings(docs: DataFrame, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """Those of ``findings``, with ``ord``, the place of a token in its sentence, or null."""

    def finding(rule: str, hard: bool, match: Column, place: Column | None = None) -> Column:
        place = F.lit(None) if place is None else place
        return F.struct(F.lit(rule).alias("rule"), F.lit(hard).alias("hard"), match.alias("match"), place.cast("int").alias("ord"))

    s = F.col("text")
    per_token = F.transform(
        tokens_of(s),
        lambda t, i: F.when(is_glued(t), finding("glued", True, t, i)).when(
            t.rlike("[A-Za-z]") & ~t.rlike(r"\p{IsCyrillic}") & ~is_allowed_latin(t, allowed), finding("latin-prose", False, t, i)
        ),
    )
    per_sentence = F.array(
        T.let(length_of(s), lambda n: F.when(n > SENTENCE_LIMIT, finding("length", False, n.cast("string")))),
        T.let(clause_breaks(F.col("around")), lambda n: F.when(n > CLAUSE_LIMIT, finding("facts", False, n.cast("string")))),
    )
    rows = placed(docs).select("doc_id", "sent", F.explode(F.array_compact(F.concat(per_token, per_sentence))).alias("f"))
    return rows.select("doc_id", "sent", "f.*")


def verdict(docs: DataFrame, lexicon: dict[str, list[dict]] | None = None, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """``doc_id, hard, soft, exit_code``: a row for each document, 1 if any finding is hard.

    Counts banned words and phrases and the findings of this module.  A glued token that
    the lexicon allows is none, nor is a Latin token that is a banned word or part of a phrase.
    """
    from proseflow.operators import gate_ru, lexicon_ru

    return gate_ru.verdict(docs, gate_ru.text_findings(docs, lexicon_ru.SEED if lexicon is None else lexicon, allowed))
