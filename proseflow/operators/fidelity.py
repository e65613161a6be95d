"""What a rewrite lost of its source: code, places in files, paths, numbers, hedges.

Source and target stand in one row, so every comparison is a set difference of arrays.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.operators import lexicon_ru
from proseflow.operators import rules_ru as R
from proseflow.sources.storage import checkpointed, shuffled

# What places in files, paths and numbers look like.
FILE_LINE = r"[A-Za-z0-9_./-]*[A-Za-z0-9_-]\.[A-Za-z0-9]+:\d+(?:[-–]\d+)?"
PATH = r"/?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+"
FILE_NAME = r"[A-Za-z0-9_-]\.[A-Za-z][A-Za-z0-9]{0,5}$"
NUMBER = r"\d+(?:[.,]\d+)?"
_MARK = "\ue004"

#: A small table of hedges by strength (English patterns, Russian patterns); users give their own.
HEDGES = {
    "possible": ("may might could possibly perhaps".split(), "может возможно".split()),
    "likely": ("probably likely".split(), "вероятно наверное".split()),
    "advice": ("should recommend".split(), "следует рекомендуем".split()),
    "certain": ("certainly definitely".split(), "точно определённо".split()),
}


_PLACED = "struct<match:string,line:int,col:int>"


def found_in(text: Column, pattern: str) -> Column:
    """First occurrences of what matches, ``match, line, col``; a match lies within a line."""
    none = F.expr("array()").cast(f"array<{_PLACED}>")

    def of_line(line: Column, i: Column) -> Column:
        pieces = F.split(F.regexp_replace(line, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)

        def step(s: Column, x: Column) -> tuple[Column, Column]:
            item = F.array(F.struct(x.alias("match"), (i + 1).cast("int").alias("line"), s["col"].alias("col")))
            return F.struct((s["col"] + F.length(x)).cast("int").alias("col"), (~s["inside"]).alias("inside")), F.when(s["inside"], item).otherwise(none)

        start = F.struct(F.lit(1).alias("col"), F.lit(False).alias("inside"))
        return T.let(pieces, lambda ps: F.when(F.size(ps) > 1, T.fold_list(ps, start, step, _PLACED)).otherwise(none))

    return T.let(F.flatten(F.transform(F.split(text, "\n", -1), of_line)), T.first_of_each)


def code_of(text: Column) -> Column:
    """First occurrences of code, ``match, line, col``: inline spans and fenced blocks, trimmed, empty ones left out."""
    none = F.expr("array()").cast(f"array<{_PLACED}>")

    def of_line(x: Column, i: Column) -> Column:
        pieces = F.regexp_extract_all(x, F.lit(rf"{R.INLINE}|`+|[^`]+"), F.lit(0))

        def step(at: Column, p: Column) -> tuple[Column, Column]:
            inner = T.trimmed(F.regexp_replace(p, "^`+|`+$", ""))
            item = F.struct(inner.alias("match"), (i + 1).cast("int").alias("line"), at.alias("col"))
            return (at + F.length(p)).cast("int"), F.when(p.rlike("^`+[^`]"), F.array(item)).otherwise(none)

        return F.when(x.contains("`"), T.fold_list(pieces, F.lit(1), step, _PLACED)).otherwise(none)

    def of_block(lines: Column, b: Column) -> Column:
        between = F.when(b["last"] - b["first"] > 1, F.sequence(b["first"] + 1, b["last"] - 1)).otherwise(F.array().cast("array<int>"))
        body = F.array_join(F.transform(between, lambda i: F.regexp_replace(F.get(lines, i), "[ \t\r]+$", "")), "\n")
        return F.struct(T.trimmed(body).alias("match"), (b["first"] + 1).cast("int").alias("line"), F.lit(1).alias("col"))

    def of(lines: Column) -> Column:
        inline = F.flatten(T.let(R.fenced_lines(lines), lambda inside: F.transform(lines, lambda x, i: F.when(F.get(inside, i), none).otherwise(of_line(x, i)))))
        return F.concat(inline, F.transform(R.fenced_blocks(lines), lambda b: of_block(lines, b)))

    every = T.let(F.split(text, "\n", -1), of)
    return F.when(text.rlike("`|~~~"), T.let(F.filter(every, lambda x: x["match"] != ""), T.first_of_each)).otherwise(none)


def _names(found: Column) -> Column:
    return F.transform(found, lambda x: x["match"])


def lost_code(source: Column, target: Column) -> Column:
    return F.array_except(_names(code_of(source)), _names(code_of(target)))


def file_lines(source: Column, target: Column) -> Column:
    """Places in files, code included, that are not in the target: ``match, line, col``."""
    return F.filter(found_in(source, FILE_LINE), lambda x: ~target.contains(x["match"]))


def lost_file_lines(source: Column, target: Column) -> Column:
    return _names(file_lines(source, target))


def paths(source: Column, target: Column) -> Column:
    """Paths of the source's prose that are neither in the target nor part of a place in a file: ``match, line, col``."""
    trimmed = F.transform(found_in(R.prose(source), PATH), lambda x: F.struct(F.regexp_replace(x["match"], r"\.+$", "").alias("match"), x["line"].alias("line"), x["col"].alias("col")))

    def is_path(x: Column, places: Column) -> Column:
        v = x["match"]
        return (v.startswith("/") | v.startswith("./") | F.substring_index(v, "/", -1).rlike(FILE_NAME)) & v.rlike("[A-Za-z]") & ~places.contains(v)

    first = T.let(trimmed, T.first_of_each)
    places = F.array_join(_names(found_in(source, FILE_LINE)), "\n")
    return T.let(places, lambda known: F.filter(first, lambda x: is_path(x, known) & ~target.contains(x["match"])))


def lost_paths(source: Column, target: Column) -> Column:
    return _names(paths(source, target))


def numbers(source: Column, target: Column, english: Column | None = None) -> Column:
    """Numbers of the source's prose of which no spelling stands in the target between other characters than digits: ``match, line, col``.

    english: whether the source is; only then do other spellings count.
    """

    def found(form: Column) -> Column:
        return F.regexp_like(target, F.concat(F.lit("(?:^|[^0-9])"), F.replace(form, F.lit("."), F.lit("\\.")), F.lit("(?:[^0-9]|$)")))

    def forms(n: Column) -> Column:
        return T.number_forms(n) if english is None else F.when(english, T.number_forms(n)).otherwise(F.array(n))

    return F.filter(found_in(R.prose(source), NUMBER), lambda x: ~F.exists(forms(x["match"]), found))


def lost_numbers(source: Column, target: Column) -> Column:
    return _names(numbers(source, target))


def hedge_counts(text: Column, words: list[str]) -> Column:
    word = r"[\p{L}\p{Nd}_]"
    return F.regexp_count(T.normalised(R.prose(text)), F.lit(rf"(?<!{word})(?:" + "|".join(w.replace("ё", "е") for w in words) + rf")(?!{word})"))


def lost_hedges(source: Column, target: Column, hedges=HEDGES) -> Column:
    """Strengths with fewer hedges in the target, and ``certain`` if it has more."""
    checks = []
    for strength, (english, russian) in hedges.items():
        before, after = hedge_counts(source, english), hedge_counts(target, russian)
        checks.append(F.when(after > before if strength == "certain" else after < before, F.lit(strength)))
    return F.array_compact(F.array(*checks))


#: What is compared, by kind, in this order.
LOST = {"code": lost_code, "file:line": lost_file_lines, "path": lost_paths, "number": lost_numbers, "hedge": lost_hedges}


def compare(pairs: DataFrame, kinds: tuple[str, ...] = tuple(LOST)) -> DataFrame:
    """``pair_id, kind, match`` for ``pairs(pair_id, src_text, out_text)``: what the target lost, of these kinds alone."""
    source, target = F.col("src_text"), F.col("out_text")

    def of_kind(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("match")))

    lost = [of_kind(kind, LOST[kind](source, target)) for kind in kinds]
    return pairs.select("pair_id", F.inline(F.concat(*lost)))


def source_language(source: Column) -> Column:
    """``en`` if Latin letters of the prose outnumber Cyrillic ones, else ``ru``."""
    return T.language(R.prose(source))


def hedges(docs: DataFrame, rows: list[dict], english: bool) -> DataFrame:
    """``doc_id, strength, nth, line, col, match``: hedges in order; of those that start at one word the longest of a strength.

    English ``could`` before ``not`` is none, also where a sentence ends between the two.
    """
    named = F.from_json(F.lit(json.dumps([r["strength"] for r in rows])), "array<string>")
    hits = lexicon_ru.english_phrases_of(docs, rows) if english else lexicon_ru.placed_phrases(docs, rows, "russian", 1)
    hits = hits.withColumn("strength", F.get(named, F.col("row_id")))
    best = hits.groupBy("doc_id", "strength", "line", "col", "sent", "ord").agg(F.max_by("match", F.struct("size", "match")).alias("match"))
    if english:
        words = lexicon_ru.token_words(docs).select("doc_id", "sent", "ord", "last", F.lower("tok").alias("tok"))
        # The token before the first of a sentence is the last of the sentence before, which has one.
        inner = F.col("ord") > 0
        before = words.where("tok = 'not'").select("doc_id", (F.col("sent") - F.when(inner, 0).otherwise(1)).alias("sent"), F.when(inner, F.col("ord") - 1).alias("at"))
        met = words.where("tok = 'could'").join(shuffled(before), ["doc_id", "sent"])
        past = met.where("at = ord OR (at IS NULL AND last)").select("doc_id", "sent", "ord")
        best = best.join(shuffled(checkpointed(past)), ["doc_id", "sent", "ord"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "strength").orderBy("line", "col")) - 1
    return checkpointed(best.select("doc_id", "strength", nth.alias("nth"), "line", "col", "match"))


def russian_family(rows: list[dict], strength: str, most: int = 6) -> str:
    """Words to show for a strength: the first of its Russian patterns that are no stems."""
    shown = [p.replace("#", "N") for r in rows if r["strength"] == strength for p in lexicon_ru.ticked(r["russian"]) if ":" not in p]
    return " / ".join(shown[:most])


def hedge_findings(pairs: DataFrame, rows: list[dict]) -> DataFrame:
    """``pair_id, kind, strength, in_source, in_target, match, line, col``: hedges that the target lost, certainty that it adds.

    A lost hedge is placed where the source has the first beyond those of the target, added
    certainty where the target has the first beyond those of the source.
    """
    own = pairs.select(F.col("pair_id").alias("doc_id"), "src_text", "out_text", source_language(F.col("src_text")).alias("lang"))
    en, ru = (own.where(F.col("lang") == x).select("doc_id", F.col("src_text").alias("text")) for x in ("en", "ru"))
    other = [r for r in rows if r["strength"] not in lexicon_ru.ENGLISH_ONLY]
    source = hedges(en, rows, True).unionByName(hedges(ru, other, False)).select("*", F.lit(0).alias("side"))
    target = hedges(own.select("doc_id", F.col("out_text").alias("text")), rows, False)
    target = target.join(shuffled(own.select("doc_id", "lang")), "doc_id").where((F.col("lang") == "en") | ~F.col("strength").isin(lexicon_ru.ENGLISH_ONLY)).drop("lang").select("*", F.lit(1).alias("side"))
    item = F.struct("nth", "line", "col", "match")
    both = source.unionByName(target).groupBy("doc_id", "strength").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("side") == k, item))).alias(name) for k, name in enumerate(("s", "t")))
    )
    sure = F.col("strength") == "certain"
    both = both.withColumn("ns", F.size("s")).withColumn("nt", F.size("t"))
    lost = F.when(~sure & (F.col("nt") < F.col("ns")), F.get("s", "nt")).when(sure & (F.col("nt") > F.col("ns")), F.get("t", "ns"))
    found = both.withColumn("x", lost).where("x IS NOT NULL")
    return found.select(F.col("doc_id").alias("pair_id"), F.when(sure, "certainty").otherwise("hedge").alias("kind"), "strength", F.col("ns").alias("in_source"), F.col("nt").alias("in_target"), "x.match", "x.line", "x.col")


def findings(pairs: DataFrame, rows: list[dict] = lexicon_ru.FULL["hedges-en-ru"]) -> DataFrame:
    """``pair_id, seq, kind, hard, where, line, col, match, hint``: all that the target lost or added, in order.

    Code, places in files, paths, numbers by their place in the source, then hedges by strength.
    """
    source, target = F.col("src_text"), F.col("out_text")
    english = source_language(source) == "en"
    spans = T.let(_names(code_of(target)), lambda known: F.filter(code_of(source), lambda x: ~F.array_contains(known, x["match"])))

    def placed(found: Column, kind: int, name: str) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("rank"), F.lit(name).alias("kind"), x["match"].alias("match"), x["line"].alias("line"), x["col"].alias("col")))

    lost = F.concat(placed(spans, 0, "code"), placed(file_lines(source, target), 1, "file:line"), placed(paths(source, target), 2, "path"), placed(numbers(source, target, english), 3, "number"))
    items = pairs.select("pair_id", F.posexplode(lost).alias("at", "f"))
    items = items.select("pair_id", F.col("at").alias("seq"), "f.kind", F.lit("source").alias("where"), "f.line", "f.col", "f.match", F.lit("в тексте этого нет").alias("hint"))
    order = F.create_map(*(F.lit(x) for i, k in enumerate(lexicon_ru.STRENGTHS) for x in (k, i)))
    family = F.create_map(*(F.lit(x) for k in lexicon_ru.STRENGTHS for x in (k, russian_family(rows, k))))
    counts = F.format_string("%s: в исходнике %d, в тексте %d", "strength", "in_source", "in_target")
    hint = F.when(F.col("kind") == "certainty", counts).otherwise(F.concat(counts, F.lit(" → "), family[F.col("strength")]))
    where = F.when(F.col("kind") == "certainty", "text").otherwise("source")
    own = hedge_findings(pairs, rows).select("pair_id", (order[F.col("strength")] + 1_000_000).alias("seq"), "kind", where.alias("where"), "line", "col", "match", hint.alias("hint"))
    return items.unionByName(own).withColumn("hard", F.lit(True))
