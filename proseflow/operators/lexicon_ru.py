"""Inflected Russian words: patterns, their surface forms, and the findings that lexicons give.

A pattern is ``[prefix,prefix]stem:classes`` or a bare word; several words are a phrase and
``#`` is a number.  Matching a prefix, a stem and an ending is a theta join; here every
pattern is expanded once to its surface forms, so tokens meet the lexicon by equality.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.operators import rules_ru
from proseflow.sources.storage import checkpointed

# Endings of nouns and adjectives, and what verb endings are made of.
NOUN_ENDINGS = [""] + "а я у ю ом ем е ы и ов ев ей ам ям ами ями ах ях ой ою ь ью ый ий ая яя ое ее ые ие ого его ому ему ым им ых их ую юю ыми ими".split()
ADJECTIVE_ENDINGS = "ий ый ая яя ое ее ие ые ого его ому ему ым им ых их ую юю ой ыми ими".split()
VERB_THEMES = [""] + "а я и е ну ова ирова иру у ыва ива".split()
VERB_TAILS = "ть ться ю юсь ет ется ешь ем ете ют ются ут утся ит ится ят ятся л ла ло ли лся лась лось лись н на но ны т та то ты в вши я ясь".split()
PARTICIPLE_BASES = "ющ ущ ящ ащ вш нн т ем им н".split()

KINDS = "slang cyrillized metaphor pipeline".split()
CLASSES = "latin loanword glued".split()
#: Strengths of hedges in the order of a report; of a Russian source those of ENGLISH_ONLY are not compared.
STRENGTHS = "possible probable unlikely usual often approx min max advice must certain".split()
ENGLISH_ONLY = "advice must".split()
#: Columns of the tables by what they are called here.
TABLES = {
    "ru-non-approved": ["term", "kind", "use_instead"],
    "ru-allowed": ["term", "class"],
    "ru-domain": ["term", "domain_cues", "slang_cues", "note"],
    "glossary-en-ru": ["english", "preferred", "also_ok", "never", "note"],
    "hedges-en-ru": ["english", "strength", "russian"],
}
#: Column titles of table files.
TITLES = {
    "use instead": "use_instead", "domain cues": "domain_cues", "slang cues": "slang_cues", "English term": "english", "Russian (preferred)": "preferred",
    "also OK": "also_ok", "English hedge": "english", "Russian renderings": "russian",
}
#: Stands for an empty cell.
NONE = "—"

#: A small lexicon of our own; users load theirs with ``read_tables``.
SEED = {
    "ru-non-approved": [
        {"term": "[за,про]деплой:n, [за]депло:v", "kind": "cyrillized", "use_instead": "развернуть, развёртывание"},
        {"term": "лог:n", "kind": "slang", "use_instead": "журнал"},
        {"term": "узл:n", "kind": "metaphor", "use_instead": "сервер"},
        {"term": "код:n написан:n", "kind": "pipeline", "use_instead": "код готов"},
    ],
    "ru-allowed": [{"term": "web-сервер:n", "class": "glued"}, {"term": "api", "class": "latin"}, {"term": "сервис:n", "class": "loanword"}],
    "ru-domain": [{"term": "узл:n", "domain_cues": "сет, кластер", "slang_cues": "крут", "note": "узел сети"}],
}
#: All five tables.
FULL = SEED | {
    "glossary-en-ru": [
        {"english": "`log`, `log file`", "preferred": "журнал", "also_ok": NONE, "never": "`лог:n`", "note": ""},
        {"english": "`deploy*`", "preferred": "развернуть", "also_ok": "разместить", "never": "`[за]депло:v`, `деплой:n`", "note": ""},
        {"english": "`wait # ms`", "preferred": "подождать", "also_ok": NONE, "never": "`ждун:n`, `ждать у моря`", "note": ""},
        {"english": "`dry run`", "preferred": "пробный запуск", "also_ok": NONE, "never": NONE, "note": ""},
    ],
    "hedges-en-ru": [
        {"english": "`may`, `might`, `could`, `possibly`, `perhaps`", "strength": "possible", "russian": "`может`, `могут`, `возможно`, `возможн:n`"},
        {"english": "`it is possible that`", "strength": "possible", "russian": "`не исключено`"},
        {"english": "`probably`, `likely`, `most likely`", "strength": "probable", "russian": "`вероятно`, `скорее всего`"},
        {"english": "`about #`", "strength": "approx", "russian": "`примерно`, `около #`"},
        {"english": "`should`, `recommend*`", "strength": "advice", "russian": "`следует`, `рекоменду:v`"},
        {"english": "`must`", "strength": "must", "russian": "`должен`, `должн:n`, `нужно`"},
        {"english": "`certainly`, `definitely`, `always`", "strength": "certain", "russian": "`точно`, `определенно`, `всегда`"},
    ],
}


def verb_endings() -> list[str]:
    tails = VERB_TAILS + [b + a for b in PARTICIPLE_BASES for a in ADJECTIVE_ENDINGS]
    return sorted({theme + tail for theme in VERB_THEMES for tail in tails})


def parse_word(pattern: str) -> dict:
    """``prefixes`` (with the empty one), ``stem``, ``classes`` and ``number``; raises ValueError."""
    if pattern == "#":
        return {"prefixes": [""], "stem": "", "classes": "", "number": True}
    m = re.fullmatch(r"(?:\[([^\[\]]*)\])?([^\[\]:]+)(?::([nv]+))?", pattern)
    if not m:
        raise ValueError(f"not a word pattern: {pattern!r}")
    prefixes = [p.strip() for p in (m[1] or "").split(",") if p.strip()]
    fold = lambda s: s.lower().replace("ё", "е")
    return {"prefixes": ["", *map(fold, prefixes)], "stem": fold(m[2]), "classes": "".join(sorted(set(m[3] or ""))), "number": False}


def parse_term(cell: str) -> list[list[dict]]:
    """Phrases of a cell: commas outside brackets part them, spaces part their words."""
    cells = [c.strip().strip("`") for c in re.split(r",(?![^\[]*\])", cell)]
    return [[parse_word(w) for w in c.split()] for c in cells if c]


def ticked(cell: str) -> list[str]:
    """What stands in backticks in a cell."""
    return re.findall(r"`([^`]+)`", cell)


def english_phrases(cell: str) -> list[list[str]]:
    """Phrases of an English cell as lists of words: ``word``, ``stem*`` or ``#``; raises ValueError where there is none."""
    found = [p.split() for p in ticked(cell.lower()) if p.split()]
    if not found:
        raise ValueError(f"no English pattern in {cell!r}")
    return found


def russian_cell(cell: str) -> str:
    """The patterns in backticks of a cell, as a cell of patterns; all of a cell without any."""
    return "" if cell.strip() == NONE else ", ".join(ticked(cell)) or cell


def _checked(name: str, row: dict) -> None:
    for column, known in (("kind", KINDS), ("class", CLASSES), ("strength", STRENGTHS)):
        if column in TABLES.get(name, []) and row[column] not in known:
            raise ValueError(f"{name}: {column} {row[column]!r} is not known")
    for column in ("term", "never", "russian"):
        if column in TABLES.get(name, []):
            parse_term(russian_cell(row[column]) if column != "term" else row[column])
    if "english" in TABLES.get(name, []):
        english_phrases(row["english"])


def read_tables(spark: SparkSession, path: str, complete: bool = False) -> dict[str, list[dict]]:
    """Lexicon tables from JSON files of ``{files: [{name, columns, rows}]}``; columns are found by title or by name.

    Raises ValueError for a table without rows, a missing column, a kind, class or strength
    that is not known, a cell that is no pattern and, if ``complete``, a missing table.
    """
    tables: dict[str, list[dict]] = {}
    for row in spark.read.text(path, wholetext=True).collect():  # lexicons, not documents
        for f in json.loads(row.value)["files"]:
            columns = [TITLES.get(c, c) for c in f["columns"]]
            missing = set(TABLES.get(f["name"], [])) - set(columns)
            if missing or not f["rows"]:
                raise ValueError(f"{f['name']}: " + (f"no column {sorted(missing)}" if missing else "no rows"))
            tables[f["name"]] = [dict(zip(columns, r, strict=True)) for r in f["rows"]]
    if complete and (missing := sorted(set(TABLES) - set(tables))):
        raise ValueError(f"no table {missing}")
    for name, rows in tables.items():
        for r in rows:
            _checked(name, r)
    return tables


def expanded(rows: list[dict], column: str = "term") -> set[str]:
    """All single words that the patterns of a lexicon's rows match: bounded by the lexicon, whatever the documents."""
    ends = {"n": NOUN_ENDINGS, "v": verb_endings()}
    out = set()
    for row in rows:
        for phrase in parse_term(russian_cell(row[column]) if column != "term" else row[column]):
            if len(phrase) == 1:
                w = phrase[0]
                out |= {p + w["stem"] + e for p in w["prefixes"] for e in ([x for c in w["classes"] for x in ends[c]] or [""])}
    return out


def patterns(spark: SparkSession, rows: list[dict], column: str = "term") -> DataFrame:
    """``row_id, phrase, pos, size, prefix, stem, class, number``: a row for each prefix and class of a word."""
    out = []
    for i, row in enumerate(rows):
        for j, phrase in enumerate(parse_term(row["term"] if column == "term" else russian_cell(row[column]))):
            for k, w in enumerate(phrase):
                out += [(i, j, k, len(phrase), p, w["stem"], c, w["number"]) for p in w["prefixes"] for c in w["classes"] or " "]
    return spark.createDataFrame(out, "row_id int, phrase int, pos int, size int, prefix string, stem string, class string, number boolean")


def endings(spark: SparkSession) -> DataFrame:
    rows = [("n", e) for e in NOUN_ENDINGS] + [("v", e) for e in verb_endings()] + [(" ", "")]
    return spark.createDataFrame(rows, "class string, ending string")


def longest_endings(words: DataFrame) -> DataFrame:
    """``word, ending``: the longest verb ending of each distinct ``words(word)`` that has one and is longer: tails meet endings by equality."""
    tails = verb_endings()
    longest = max(map(len, tails))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - 1))
    every = words.select("word").distinct().where(F.length("word") > 1).select("word", F.explode(F.transform(lengths, lambda n: F.right(F.col("word"), n))).alias("ending"))
    own = endings(words.sparkSession).where("class = 'v'").select("ending")
    return every.join(own, "ending").groupBy("word").agg(F.max_by("ending", F.length("ending")).alias("ending"))


def surface_forms(spark: SparkSession, rows: list[dict], column: str = "term") -> DataFrame:
    """``row_id, phrase, pos, size, form``: all that the patterns match but numbers (``form`` null).

    A stored table, so that Spark knows its size: tokens meet a small one by broadcast.
    """
    joined = patterns(spark, rows, column).join(endings(spark), "class")
    form = F.when(~F.col("number"), F.concat("prefix", "stem", "ending"))
    return checkpointed(joined.select("row_id", "phrase", "pos", "size", form.alias("form")).distinct().coalesce(1))


def candidates(docs: DataFrame, of_document: Column | None = None, of_sentence: Column | None = None) -> DataFrame:
    """``doc_id, sent, ord, cand, tok, word, line, col, part``: each token (cand 0) and, if it has several, its parts.

    part: the candidate as it stands, at ``line`` and ``col``.  of_document, of_sentence: row
    numbers over ``text`` and over ``raw``, the sentence with its code, carried along under these names.
    """
    none = F.lit(None).cast("array<int>")
    rows = rules_ru.placed(docs, (none if of_document is None else of_document).alias("of_document"))
    flag = none if of_sentence is None else of_sentence
    rows = rows.select("doc_id", "sent", "line", "of_document", flag.alias("of_sentence"), F.posexplode(rules_ru.tokens_in(rows)).alias("ord", "t"))
    rows = rows.select("*", F.col("t.tok").alias("tok"), F.col("t.col").alias("at")).drop("t")
    whole = F.struct(F.col("tok").alias("part"), F.col("at").cast("int").alias("col"))

    def split(parts: Column) -> Column:
        step = lambda at, x: ((at + F.length(x) + 1).cast("int"), F.array(F.struct(x.alias("part"), at.alias("col"))))
        return F.concat(F.array(whole), T.fold_list(parts, F.col("at").cast("int"), step, "struct<part:string,col:int>"))

    every = T.let(rules_ru.parts_of(F.col("tok")), lambda p: F.when(F.size(p) > 1, split(p)).otherwise(F.array(whole)))
    rows = rows.select("doc_id", "sent", "ord", "tok", "line", "of_document", "of_sentence", F.posexplode(every).alias("cand", "p"))
    return rows.select("doc_id", "sent", "ord", "cand", "tok", T.normalised(F.col("p.part")).alias("word"), "line", "p.col", "p.part", "of_document", "of_sentence")


def _cues(cell: str) -> list[str]:
    return [c.strip().lower().replace("ё", "е") for c in cell.split(",") if c.strip()]


def cue_rows(text: Column, cells: list[str]) -> Column:
    """Indices of the cells with a cue that begins a word of the text.

    All cues are one tree of letters that the text is searched with once, so the cost does not
    grow with the table; a cue that begins a longer one is found with it.
    """
    owners: dict[str, set[int]] = {}
    for i, cell in enumerate(cells):
        for cue in _cues(cell):
            owners.setdefault(cue, set()).add(i)
    if not owners:
        return F.array().cast("array<int>")
    rows = {cue: sorted(set().union(*(own for c, own in owners.items() if cue.startswith(c)))) for cue in owners}
    table = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), "map<string,array<int>>")
    found = F.regexp_extract_all(T.normalised(text), F.lit(r"(?<![\p{L}\p{Nd}_])(?:" + T.trie_pattern(list(owners)) + ")"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(found), lambda c: table[c])))


def sense_flags(domain: list[dict]) -> tuple[Column, Column]:
    """For ``candidates``: the rows of the domain table with a cue in the document, and with a cue of slang in the sentence."""
    return cue_rows(F.col("text"), [r["domain_cues"] for r in domain]), cue_rows(F.col("raw"), [r["slang_cues"] for r in domain])


def flagged(rows: str, row: str) -> Column:
    return F.coalesce(F.array_contains(F.col(rows), F.col(row)), F.lit(False))


def single_words(docs: DataFrame, lexicon: dict[str, list[dict]] = SEED) -> DataFrame:
    """``doc_id, sent, ord, row_id, rule, hard, match, cand, line, col, as_is, slang``: banned words, one finding for each token and row.

    A token that is allowed is skipped, and so is a part allowed as a loanword or Latin word.
    A word of the domain table is soft where the document has a cue of the domain and the
    sentence none of slang.
    """
    spark = docs.sparkSession
    domain = lexicon["ru-domain"]
    classes = spark.createDataFrame([(i, r["class"] in ("loanword", "latin")) for i, r in enumerate(lexicon["ru-allowed"])], "row_id int, part boolean")
    allowed = surface_forms(spark, lexicon["ru-allowed"]).where("size = 1").join(classes, "row_id").select("form", F.lit(True).alias("whole"), "part")
    banned = surface_forms(spark, lexicon["ru-non-approved"]).where("size = 1").select("form", F.col("row_id").alias("row"))
    sense = surface_forms(spark, domain).where("size = 1").select("form", F.col("row_id").alias("domain"))
    # One row for each form that the tables know, so that tokens are joined once.
    known = allowed.unionByName(banned, allowMissingColumns=True).unionByName(sense, allowMissingColumns=True).groupBy(F.col("form").alias("word"))
    known = checkpointed(known.agg(F.max("whole").alias("whole"), F.max("part").alias("fine_part"), F.collect_set("row").alias("rows"), F.min("domain").alias("domain")).coalesce(1))
    of_document, of_sentence = sense_flags(domain)
    of_document = F.col("of_document") if "of_document" in docs.columns else of_document
    met = candidates(docs, of_document, of_sentence).join(known, "word")
    slang = flagged("of_sentence", "domain")
    soft = flagged("of_document", "domain") & ~slang
    hit = F.struct("cand", "word", "fine_part", "rows", soft.alias("soft"), slang.alias("slang"), "line", "col", F.col("part").alias("as_is"))
    found = met.groupBy("doc_id", "sent", "ord").agg(F.max((F.col("cand") == 0) & F.coalesce("whole", F.lit(False))).alias("fine"), F.collect_list(hit).alias("hits"))
    usable = F.filter("hits", lambda h: (h["cand"] == 0) | ~F.coalesce(h["fine_part"], F.lit(False)))
    found = found.where("NOT fine").select("doc_id", "sent", "ord", F.explode(usable).alias("h"))
    found = found.select("doc_id", "sent", "ord", F.explode("h.rows").alias("row_id"), "h.cand", F.struct("h.word", "h.soft", "h.slang", "h.line", "h.col", "h.as_is", "h.cand").alias("x"))
    first = found.groupBy("doc_id", "sent", "ord", "row_id").agg(F.min_by("x", "cand").alias("x"))
    rule = F.when(F.col("x.soft"), "domain").otherwise("lexicon").alias("rule")
    return first.select("doc_id", "sent", "ord", "row_id", rule, (~F.col("x.soft")).alias("hard"), F.col("x.word").alias("match"), "x.cand", "x.line", "x.col", "x.as_is", "x.slang")


def phrases(docs: DataFrame, rows: list[dict]) -> DataFrame:
    """``doc_id, sent, ord, row_id, match``: phrases of words that only spaces part; no word is allowed away."""
    return placed_phrases(docs, rows).select("doc_id", "sent", "ord", "row_id", "match")


def token_words(docs: DataFrame) -> DataFrame:
    """``doc_id, sent, line, ord, tok, col, joined, last, word``: tokens; ``joined`` if only spaces part one from the token before, ``last`` in its sentence."""
    rows = rules_ru.placed(docs)

    def one(t: Column, i: Column, n: Column) -> Column:
        return F.struct(t["tok"].alias("tok"), t["col"].alias("col"), ((i > 0) & t["gap"].rlike(r"^[ \t\x{A0}]+$")).alias("joined"), (i == n - 1).alias("last"))

    each = T.let(rules_ru.tokens_in(rows), lambda ts: F.transform(ts, lambda t, i: one(t, i, F.size(ts))))
    rows = rows.select("doc_id", "sent", "line", F.posexplode(each).alias("ord", "t")).select("doc_id", "sent", "line", "ord", "t.*")
    return rows.withColumn("word", T.normalised(F.col("tok")))


def matched(words: DataFrame, forms: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Phrases of ``forms(row_id, phrase, pos, size, word)`` in ``words`` (as ``token_words``, ``word`` may repeat).

    ``doc_id, sent, ord, row_id, phrase, size, match, line, col, width``: the first token's place and how far the phrase goes.
    """
    at = words.join(forms, "word").withColumn("start", F.col("ord") - F.col("pos")).where("pos = 0 OR joined")
    token = F.struct("pos", "tok", "col")
    found = at.groupBy("doc_id", "sent", "start", "row_id", "phrase", "size", *keep).agg(F.count_distinct("pos").alias("n"), F.min("line").alias("line"), F.sort_array(F.collect_set(token)).alias("w"))
    found = found.where("n = size")
    last = F.element_at("w", -1)
    width = (last["col"] + F.length(last["tok"]) - F.element_at("w", 1)["col"]).alias("width")
    return found.select("doc_id", "sent", F.col("start").alias("ord"), "row_id", "phrase", "size", F.array_join("w.tok", " ").alias("match"), "line", F.element_at("w", 1)["col"].alias("col"), width, *keep)


_IS_NUMBER = r"^\p{Nd}+$"


def under(words: DataFrame, *others: Column) -> DataFrame:
    """``words`` with ``word`` as it is and, in further rows, as each of the others that is not null: one pass over the tokens."""
    return words.withColumn("word", F.explode(F.array_compact(F.array("word", *others))))


def _number_sign(word: Column) -> Column:
    return F.when(word.rlike(_IS_NUMBER), "#")


def with_numbers(words: DataFrame) -> DataFrame:
    """Numbers meet the sign for numbers as well as their own spelling."""
    return under(words, _number_sign(F.col("word")))


def placed_phrases(docs: DataFrame, rows: list[dict], column: str = "term", least: int = 2) -> DataFrame:
    """Phrases of ``least`` words or more: ``doc_id, sent, ord, row_id, phrase, size, match, line, col, width``."""
    forms = surface_forms(docs.sparkSession, rows, column).where(F.col("size") >= least)
    forms = forms.select("row_id", "phrase", "pos", "size", F.coalesce("form", F.lit("#")).alias("word"))
    return matched(with_numbers(token_words(docs)), forms)


def english_forms(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """``row_id, phrase, pos, size, word``: English patterns; a stem keeps its asterisk."""
    out = [(i, j, k, len(p), w) for i, r in enumerate(rows) for j, p in enumerate(english_phrases(r["english"])) for k, w in enumerate(p)]
    return checkpointed(spark.createDataFrame(out, "row_id int, phrase int, pos int, size int, word string").coalesce(1))


def _stems(word: Column, rows: list[dict]) -> list[Column]:
    """A word cut to each of the lengths that stems have, so that a stem joins by equality too."""
    lengths = sorted({len(w) - 1 for r in rows for p in english_phrases(r["english"]) for w in p if w.endswith("*")})
    return [F.when(F.length(word) >= n, F.concat(F.left(word, F.lit(n)), F.lit("*"))) for n in lengths]


def english_phrases_of(docs: DataFrame, rows: list[dict]) -> DataFrame:
    """English phrases of the rows' patterns in the prose, as ``matched`` gives them."""
    words = token_words(docs).withColumn("word", F.lower("tok"))
    return matched(under(words, _number_sign(F.col("word")), *_stems(F.col("word"), rows)), english_forms(docs.sparkSession, rows))


#: Tables in the order of a look-up: the column of Russian patterns, and whether there are English ones too.
LOOKED_UP = {"glossary-en-ru": ("never", True), "hedges-en-ru": ("russian", True), "ru-non-approved": ("term", False), "ru-allowed": ("term", False), "ru-domain": ("term", False)}


def _given(spark: SparkSession, terms: list[str] | DataFrame) -> DataFrame:
    """``term`` of a list or of a table's column."""
    given = terms if isinstance(terms, DataFrame) else spark.createDataFrame([(t,) for t in terms], "term string")
    return given.select("term").where("term IS NOT NULL")


def _terms(spark: SparkSession, terms: list[str] | DataFrame) -> DataFrame:
    """Those of ``_given``, each once."""
    return _given(spark, terms).distinct()


def lookup(spark: SparkSession, terms: list[str] | DataFrame, lexicon: dict[str, list[dict]] = SEED) -> DataFrame:
    """``term, table, row_id``: rows of all tables with a phrase that the term matches word by word.

    terms: a list, or a table with a column ``term``.  English patterns match too, and a row of
    the glossary whose Russian cells hold the term, if it has three letters or more.
    """
    fold = lambda x: x.lower().replace("ё", "е")
    tables = {name: lexicon[name] for name in LOOKED_UP if lexicon.get(name)}
    russian_forms = {name: surface_forms(spark, rows, LOOKED_UP[name][0]).withColumn("word", F.coalesce("form", F.lit("#"))) for name, rows in tables.items()}
    english = {name: (english_forms(spark, rows), rows) for name, rows in tables.items() if LOOKED_UP[name][1]}
    # All that the cells of the glossary hold, so that this too is a join by equality.
    cells = [(fold(r[c]), i) for i, r in enumerate(tables.get("glossary-en-ru", [])) for c in ("preferred", "also_ok")]
    held = sorted({(x[a:b], i) for x, i in cells for a in range(len(x)) for b in range(a + 3, len(x) + 1)})
    within = checkpointed(spark.createDataFrame(held, "folded string, row_id int").coalesce(1)) if held else None
    firsts = [forms.where("pos = 0").select(F.col("word").alias("key")) for forms in (*russian_forms.values(), *(forms for forms, _ in english.values()))]
    firsts += [within.select(F.col("folded").alias("key"))] if held else []
    out = spark.createDataFrame([], "term string, table string, row_id int")
    if not firsts:
        return out
    given = _may_match(_given(spark, terms), checkpointed(functools.reduce(DataFrame.union, firsts).distinct().coalesce(1)), [r for _, rows in english.values() for r in rows])
    asked = given.distinct()
    parts = T.fields(F.col("term"))
    words = asked.select("term", F.size(parts).alias("n"), F.posexplode(parts).alias("pos", "raw"))
    words = words.select("term", "n", "pos", T.normalised(F.col("raw")).alias("word"), F.lower("raw").alias("low"))
    sign = _number_sign(F.col("word"))
    for name in tables:
        # Each word under its spelling and, if it is a number, the sign for numbers: joins by equality.
        found = [(under(words, sign), russian_forms[name])]
        if name in english:
            forms, rows = english[name]
            found.append((under(words.withColumn("word", F.col("low")), sign, *_stems(F.col("low"), rows)), forms))
        for own, forms in found:
            hit = own.join(forms.select("row_id", "phrase", "pos", "size", "word"), ["pos", "word"]).where("n = size")
            hit = hit.groupBy("term", "n", "row_id", "phrase").agg(F.count_distinct("pos").alias("k")).where("k = n")
            out = out.unionByName(hit.select("term", F.lit(name).alias("table"), "row_id"))
    if held:
        out = out.unionByName(asked.withColumn("folded", T.normalised(F.col("term"))).join(within, "folded").select("term", F.lit("glossary-en-ru").alias("table"), "row_id"))
    return out.distinct()


def _may_match(given: DataFrame, firsts: DataFrame, english: list[dict]) -> DataFrame:
    """``term`` of the rows whose first word, or all of whose text, is a ``key`` of ``firsts``: few, so only these are shuffled and made distinct."""
    first = F.regexp_extract("term", T.NOT_WS + "+", 0)
    words = [T.normalised(first), _number_sign(first)]
    words += [F.lower(first), *_stems(F.lower(first), english), T.normalised(F.col("term"))] if english else []  # as tables with English have it
    keyed = given.select("term", F.explode(F.array_distinct(F.array_compact(F.array(*words)))).alias("key"))
    return keyed.join(firsts, "key", "left_semi").select("term")


def lookup_lines(spark: SparkSession, terms: list[str] | DataFrame, lexicon: dict[str, list[dict]] = FULL) -> DataFrame:
    """``term, found, lines, entries``: a look-up as text and as JSON for each term; ``found`` counts its rows.

    The status of a look-up is 1 if the sum of ``found`` is 0.
    """
    cells = []
    for rank, name in enumerate(LOOKED_UP):
        shown = [c for c in TABLES[name] if c not in ("domain_cues", "slang_cues")] + (["example"] if name == "ru-non-approved" else [])
        for i, r in enumerate(lexicon.get(name, [])):
            own = {c: r.get(c, "") for c in shown}
            line = f"[{name}] " + " | ".join(f"{k}: {v}" for k, v in own.items())
            cells.append((rank, name, i, line, json.dumps({"table": name, "cells": own}, ensure_ascii=False)))
    rows = spark.createDataFrame(cells, "rank int, table string, row_id int, line string, entry string")
    hits = lookup(spark, terms, lexicon).join(rows, ["table", "row_id"])
    found = hits.groupBy("term").agg(F.count("*").alias("found"), F.sort_array(F.collect_list(F.struct("rank", "row_id", "line", "entry"))).alias("x"))
    asked = _terms(spark, terms)
    lines = F.coalesce(F.transform("x.line", lambda x: F.concat("term", F.lit(" → "), x)), F.array(F.concat("term", F.lit(": no entry"))))
    entries = F.concat(F.lit("["), F.coalesce(F.array_join("x.entry", ","), F.lit("")), F.lit("]"))
    return asked.join(found, "term", "left").select("term", F.coalesce("found", F.lit(0)).alias("found"), lines.alias("lines"), entries.alias("entries"))


def status(lines: DataFrame) -> DataFrame:
    """``exit_code`` of a look-up: 1 if no term has an entry."""
    return lines.agg((F.coalesce(F.sum("found"), F.lit(0)) == 0).cast("int").alias("exit_code"))
