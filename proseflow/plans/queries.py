"""The query catalogue: Spark queries and, under the same names, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.operators import dictionary, fidelity, gate_ru, glossary, lexicon_ru, rules_en, rules_ru, segments
from proseflow.plans import oracles as O
from proseflow.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir, "doc_id", "text")


_LF = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(f"SELECT doc_id, CAST(length({_LF}) AS INT) AS n_chars, CAST(len(string_split({_LF}, chr(10))) AS INT) AS n_lines FROM ({O.ENGLISH})")
def src_lf_normalised(spark, sf_dir):
    text = T.lf_normalised(F.col("text"))
    return tables.english(spark, sf_dir).select("doc_id", F.length(text).alias("n_chars"), F.size(F.split(text, "\n", -1)).alias("n_lines"))


@query(O.paragraph_ctes(O.ENGLISH) + " SELECT doc_id, CAST(para AS INT) AS para, array_to_string(ls, chr(10)) AS block, is_heading, NOT is_heading AND listy AS is_list FROM paras")
def paragraphs(spark, sf_dir):
    return segments.paragraphs(tables.english(spark, sf_dir))


@query(O.sentence_ctes(O.ENGLISH) + " SELECT doc_id, CAST(para AS INT) AS para, CAST(sent AS INT) AS sent, text FROM sents")
def sentences_en(spark, sf_dir):
    return segments.sentences(tables.english(spark, sf_dir))


@query(O.sentence_ctes(O.DOCUMENTS) + " SELECT doc_id, CAST(para AS INT) AS para, CAST(sent AS INT) AS sent, text FROM sents")
def sentences_documents(spark, sf_dir):
    return segments.sentences(documents(spark, sf_dir))


@query(O.sentence_ctes(O.DOCUMENTS) + f" SELECT doc_id, CAST(sent AS INT) AS sent, CAST({O.words('text')} AS INT) AS n_words FROM sents")
def sentence_word_count(spark, sf_dir):
    return segments.sentences(documents(spark, sf_dir)).select("doc_id", "sent", T.word_count(F.col("text")).alias("n_words"))


@query(O.sentence_ctes(O.DOCUMENTS) + f" SELECT doc_id, count(*) AS n_sentences, count(*) FILTER ({O.words('text')} > 25) AS n_long FROM sents GROUP BY doc_id")
def long_sentences(spark, sf_dir):
    found = segments.sentences(documents(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(T.word_count(F.col("text")) > 25).alias("n_long"))


@query(O.sentence_ctes(O.DOCUMENTS) + " SELECT doc_id, CAST(para AS INT) AS para, count(*) AS n_sentences FROM sents GROUP BY doc_id, para HAVING count(*) > 6")
def paragraph_sentence_count(spark, sf_dir):
    found = segments.sentences(documents(spark, sf_dir))
    return found.groupBy("doc_id", "para").agg(F.count("*").alias("n_sentences")).where("n_sentences > 6")


@query(O.token_ctes(O.ENGLISH) + " SELECT doc_id, CAST(sent AS INT) AS sent, CAST(ord AS INT) AS ord, tok, opaque FROM toks")
def tokens_en(spark, sf_dir):
    return segments.tokens(tables.english(spark, sf_dir))


@query(O.token_ctes(O.DOCUMENTS) + " SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (opaque) AS n_opaque, count(*) FILTER (ord = 1) AS n_first FROM toks GROUP BY doc_id")
def token_counts(spark, sf_dir):
    found = segments.tokens(documents(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if("opaque").alias("n_opaque"), F.count_if(F.col("ord") == 1).alias("n_first"))


def _judged(docs: DataFrame) -> tuple[DataFrame, Column]:
    return dictionary.seed().attached(segments.sentences(docs)), rules_en.judged(segments.tokens_of(F.col("text")))


def _word_findings(docs: DataFrame) -> DataFrame:
    rows, judged = _judged(docs)
    found = T.let(judged, rules_en.token_findings)
    return rows.select("doc_id", "sent", F.explode(found).alias("f")).groupBy("doc_id", "sent", "f.rule", "f.kind", "f.match").agg(F.count("*").alias("n"))


def _counted(docs: str) -> str:
    return O.judged_ctes(docs) + f", found AS ({O.token_findings()}) SELECT doc_id, CAST(sent AS INT) AS sent, rule, kind, match, count(*) AS n FROM found WHERE kind <> 'noun-cluster' GROUP BY ALL"


@query(_counted(O.ENGLISH))
def tense_passive_ing(spark, sf_dir):
    return _word_findings(tables.english(spark, sf_dir))


@query(_counted(O.DOCUMENTS))
def tense_passive_ing_documents(spark, sf_dir):
    return _word_findings(documents(spark, sf_dir))


@query(
    O.sentence_ctes(O.ENGLISH)
    + f", m AS (SELECT *, {O.first_bounded('text', T.LATIN, False)} AS latin, {O.first_bounded('text', T.PRONOUNS, True)} AS pronoun, contains(text, ';') AS semicolon, {O.shouted('text')} AS shouted FROM sents)"
    + " SELECT doc_id, CAST(sent AS INT) AS sent, latin, pronoun, semicolon, shouted FROM m WHERE latin <> '' OR pronoun <> '' OR semicolon OR shouted"
)
def sentence_marks(spark, sf_dir):
    s = F.col("text")
    found = segments.sentences(tables.english(spark, sf_dir)).select(
        "doc_id", "sent", T.latin_abbreviation(s).alias("latin"), T.gender_pronoun(s).alias("pronoun"), s.contains(";").alias("semicolon"), T.is_shouted(s).alias("shouted")
    )
    return found.where("latin <> '' OR pronoun <> '' OR semicolon OR shouted")


@query(
    O.sentence_ctes(O.DOCUMENTS)
    + f" SELECT lower({O.first_bounded('text', T.PRONOUNS, True)}) AS pronoun, count(*) AS n FROM sents WHERE {O.first_bounded('text', T.PRONOUNS, True)} <> '' GROUP BY 1"
)
def gender_pronouns(spark, sf_dir):
    found = segments.sentences(documents(spark, sf_dir)).select(F.lower(T.gender_pronoun(F.col("text"))).alias("pronoun")).where("pronoun <> ''")
    return found.groupBy("pronoun").agg(F.count("*").alias("n"))


@query(
    O.sentence_ctes(O.ENGLISH)
    + f", c AS (SELECT doc_id, sent, unnest({O.every("replace(text, '’', '''')", r"[\pL\pN_]+'(?i:t|s|re|ve|ll|d|m)\b")}) AS m FROM sents)"
    + f" SELECT doc_id, CAST(sent AS INT) AS sent, m AS match, count(*) AS n FROM c WHERE NOT ends_with(lower(m), '''s') OR lower(m) IN {O.listed(T.CONTRACTIONS)} GROUP BY ALL"
)
def contractions(spark, sf_dir):
    found = segments.sentences(tables.english(spark, sf_dir)).select("doc_id", "sent", F.explode(T.contractions(F.col("text"))).alias("match"))
    return found.groupBy("doc_id", "sent", "match").agg(F.count("*").alias("n"))


def _auto(docs: DataFrame) -> DataFrame:
    found = segments.sentences(docs).select("doc_id", F.inline(segments.auto_terms(F.col("text"))))
    return found.groupBy("doc_id", "term", "kind").agg(F.count("*").alias("n"))


def _auto_sql(docs: str) -> str:
    return (
        O.chunk_ctes(docs)
        + f", loud AS (SELECT doc_id, sent, {O.shouted('text')} AS loud FROM sents)"
        + " SELECT k.doc_id, core AS term, kind, count(*) AS n FROM kinds k JOIN loud l ON k.doc_id = l.doc_id AND k.sent = l.sent"
        + " WHERE kind <> '' AND NOT (kind = 'acronym' AND loud) GROUP BY ALL"
    )


@query(_auto_sql(O.ENGLISH))
def code_tokens(spark, sf_dir):
    return _auto(tables.english(spark, sf_dir))


@query(_auto_sql(O.DOCUMENTS))
def code_tokens_documents(spark, sf_dir):
    return _auto(documents(spark, sf_dir))


_RANK = "list_position([" + ", ".join(f"'{k}'" for k in rules_en.KINDS) + "], kind)"


@query(
    O.finding_en_ctes(O.ENGLISH)
    + f" SELECT doc_id, CAST(para AS INT) AS para, CAST(sent AS INT) AS sent, CAST(seq AS INT) AS seq, rule, kind, match, CAST({_RANK} AS INT) AS kind_rank,"
    f" CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, para, sent, seq) AS INT) AS place FROM every"
)
def findings_en_ordered(spark, sf_dir):
    return rules_en.ordered(rules_en.findings(tables.english(spark, sf_dir), own=dictionary.seed()))


@query(O.finding_en_ctes(O.DOCUMENTS) + " SELECT rule, kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM every GROUP BY ALL")
def finding_counts(spark, sf_dir):
    return rules_en.findings(documents(spark, sf_dir), own=dictionary.seed()).groupBy("rule", "kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {O.masked(O.RUSSIAN)} SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM prose_lines GROUP BY doc_id")
def code_blanked(spark, sf_dir):
    """Code and addresses as spaces, every other character in its place."""
    return tables.russian(spark, sf_dir).select("doc_id", rules_ru.prose(F.col("text")).alias("text"))


@query(O.russian_ctes(O.RUSSIAN) + " SELECT doc_id, CAST(sent AS INT) AS sent, text FROM sents")
def ru_sentences(spark, sf_dir):
    return rules_ru.sentences(tables.russian(spark, sf_dir))


@query(
    O.russian_ctes(O.DOCUMENTS)
    + f" SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (len({O.every('text', T.PROSE_TOKEN)}) > 25) AS n_long, CAST(sum(len({O.every('text', T.PROSE_TOKEN)})) AS BIGINT) AS n_tokens FROM sents GROUP BY doc_id"
)
def ru_sentence_lengths(spark, sf_dir):
    rows = rules_ru.sentences(documents(spark, sf_dir)).select("doc_id", rules_ru.length_of(F.col("text")).alias("n"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(F.col("n") > 25).alias("n_long"), F.sum("n").alias("n_tokens"))


@query(
    f"""WITH {O.masked(O.RUSSIAN)},
p AS (SELECT doc_id, n, j, ps[j] AS tok FROM (SELECT doc_id, n, {O.every('line', T.PROSE_TOKEN + '|[^' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}_]+')} AS ps FROM prose_lines), unnest(range(1, len(ps) + 1)) AS t(j)),
o AS (SELECT *, 1 + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id, n ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col FROM p)
SELECT doc_id, CAST(n AS INT) AS line, CAST(col AS INT) AS col, tok FROM o WHERE {O.rx('tok', '[' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}_]')}"""
)
def ru_tokens(spark, sf_dir):
    return rules_ru.tokens(tables.russian(spark, sf_dir))


def _letters(docs: str) -> str:
    latin, cyrillic = f"length({O.sub('text', '[^A-Za-z]')})", f"length({O.sub('text', '[^' + chr(92) + 'p{Cyrillic}]')})"
    return f"SELECT doc_id, CAST({latin} AS INT) AS latin, CAST({cyrillic} AS INT) AS cyrillic, CASE WHEN {latin} > {cyrillic} THEN 'en' ELSE 'ru' END AS lang FROM ({docs})"


def _script(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select("doc_id", T.script_letters(t, "Latin").alias("latin"), T.script_letters(t, "Cyrillic").alias("cyrillic"), T.language(t).alias("lang"))


_PROSE = f"WITH {O.masked(O.RUSSIAN)}, whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM prose_lines GROUP BY doc_id) "


@query(_PROSE + _letters("SELECT * FROM whole"))
def doc_language(spark, sf_dir):
    """Letters of the prose decide, not those of code."""
    return _script(tables.russian(spark, sf_dir).select("doc_id", rules_ru.prose(F.col("text")).alias("text")))


@query(_letters(O.DOCUMENTS))
def script_letters(spark, sf_dir):
    return _script(documents(spark, sf_dir))


_PUNCTUATION = f"len({O.every('text', '[,;]')}) + len({O.every('text', chr(92) + 's[—–]' + chr(92) + 's')})"


@query(O.russian_ctes(O.RUSSIAN) + f" SELECT doc_id, CAST(sent AS INT) AS sent, CAST({_PUNCTUATION} AS INT) AS n FROM sents")
def clause_marks(spark, sf_dir):
    """Commas, semicolons and dashes of every sentence."""
    marks = F.regexp_count("around", F.lit(r"[,;]|(?<=\s)[—–](?=\s)"))
    return rules_ru.placed(tables.russian(spark, sf_dir)).select("doc_id", "sent", marks.alias("n"))


@query(O.finding_ctes(O.RUSSIAN) + " SELECT doc_id, CAST(sent AS INT) AS sent, CAST(n AS INT) AS n FROM breaks")
def clause_breaks(spark, sf_dir):
    """Marks and conjunctions of every sentence."""
    return rules_ru.placed(tables.russian(spark, sf_dir)).select("doc_id", "sent", rules_ru.clause_breaks(F.col("around")).alias("n"))


def _of_rule(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    found = gate_ru.text_findings(tables.russian(spark, sf_dir), lexicon_ru.SEED).where(F.col("rule") == rule)
    return found.groupBy("doc_id", "match").agg(F.count("*").alias("n"))


@query(O.finding_ctes(O.RUSSIAN) + " SELECT doc_id, tok AS match, count(*) AS n FROM glued GROUP BY ALL")
def glued_tokens(spark, sf_dir):
    found = gate_ru.glued_tokens(tables.russian(spark, sf_dir), lexicon_ru.SEED)
    return found.groupBy("doc_id", "match").agg(F.count("*").alias("n"))


@query(O.finding_ctes(O.RUSSIAN) + " SELECT doc_id, tok AS match, count(*) AS n FROM latin GROUP BY ALL")
def latin_prose(spark, sf_dir):
    return _of_rule(spark, sf_dir, "latin-prose")


@query(O.finding_ctes(O.RUSSIAN) + " SELECT rule, hard, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY ALL")
def ru_finding_counts(spark, sf_dir):
    found = gate_ru.text_findings(tables.russian(spark, sf_dir), lexicon_ru.SEED)
    return found.groupBy("rule", "hard").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(
    O.finding_ctes(O.RUSSIAN)
    + f", c AS (SELECT doc_id, count(*) FILTER (hard) AS hard, count(*) FILTER (NOT hard) AS soft FROM found GROUP BY doc_id)"
    f" SELECT d.doc_id, coalesce(hard, 0) AS hard, coalesce(soft, 0) AS soft, CAST(coalesce(hard, 0) > 0 AS INT) AS exit_code FROM ({O.RUSSIAN}) d LEFT JOIN c ON c.doc_id = d.doc_id"
)
def verdict(spark, sf_dir):
    return rules_ru.verdict(tables.russian(spark, sf_dir))


@query()
def gate_findings(spark, sf_dir):
    """Findings of rewrites against their sources, with places and hints."""
    return gate_ru.analyse(tables.pairs(spark, sf_dir))


@query()
def report_ru(spark, sf_dir):
    """The text and JSON reports of rewrites."""
    pairs = tables.pairs(spark, sf_dir)
    docs = pairs.select(F.col("pair_id").alias("doc_id"), F.lit("text").alias("name"), F.lit("source").alias("source"), fidelity.source_language(F.col("src_text")).alias("lang"))
    return gate_ru.reports(docs, gate_ru.analyse(pairs))


def _lost(kind: str) -> Query:
    return lambda spark, sf_dir: fidelity.compare(tables.pairs(spark, sf_dir), (kind,)).select("pair_id", "match")


QUERIES |= {f"fidelity_{k.replace(':', '_')}": _lost(k) for k in ("code", "file:line", "path", "number", "hedge")}
ORACLES |= {
    "fidelity_code": f"WITH p AS ({O.PAIRS}), s AS (SELECT DISTINCT pair_id, out_text, trim(unnest(regexp_extract_all(src_text, '`([^`]+)`', 1))) AS match FROM p)"
    " SELECT pair_id, match FROM s WHERE NOT list_contains(list_transform(regexp_extract_all(out_text, '`([^`]+)`', 1), lambda x: trim(x)), match)",
    "fidelity_file_line": f"WITH p AS ({O.PAIRS}), s AS (SELECT DISTINCT pair_id, out_text, unnest({O.every('src_text', fidelity.FILE_LINE)}) AS match FROM p)"
    " SELECT pair_id, match FROM s WHERE NOT contains(out_text, match)",
    "fidelity_number": f"WITH p AS ({O.PAIRS}), s AS (SELECT DISTINCT pair_id, out_text, unnest({O.every(O.prose('src_text'), fidelity.NUMBER)}) AS match FROM p),"
    " f AS (SELECT *, [match] || CASE WHEN regexp_matches(match, '[.,]') THEN [replace(match, '.', ','), replace(match, ',', '.')] ELSE [] END"
    " || CASE WHEN regexp_matches(match, '^\\d+,\\d{3}$') THEN [replace(match, ',', ''), replace(match, ',', ' '), replace(match, ',', chr(160))] ELSE [] END AS forms FROM s)"
    " SELECT pair_id, match FROM f WHERE len(list_filter(forms, lambda x: regexp_matches(out_text, '(?:^|[^0-9])' || replace(x, '.', '\\.') || '(?:[^0-9]|$)'))) = 0",
    "fidelity_path": O.path_sql(),
    "fidelity_hedge": O.hedge_sql(),
}


_WORDS = "SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents"
_FORMS = "(VALUES " + ", ".join(f"({O.q(f)}, {O.q(b)})" for f, b in sorted(dictionary.seed().forms.items())) + ") AS f(form, base)"


def _words(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


@query(f"SELECT form, base, count(*) AS n FROM ({_WORDS}) w JOIN {_FORMS} ON form = word GROUP BY ALL")
def dict_forms(spark, sf_dir):
    """Forms of the dictionary's words that stand in the documents."""
    return dictionary.forms_used(_words(documents(spark, sf_dir)))


_TYPES = "SELECT DISTINCT lower(unnest(string_split(p_type, ' '))) AS w FROM part"


@query(
    f"WITH n AS ({_TYPES}) SELECT w, w || 's' AS plural FROM n UNION SELECT w, w || 'es' FROM n WHERE regexp_matches(w, '(s|x|z|ch|sh)$')"
    " UNION SELECT w, left(w, length(w) - 1) || 'ies' FROM n WHERE regexp_matches(w, '[^aeiou]y$')"
    " UNION SELECT w, left(w, length(w) - 1) || 'ves' FROM n WHERE regexp_matches(w, '[^f]f$|^f$') UNION SELECT w, left(w, length(w) - 2) || 'ves' FROM n WHERE regexp_matches(w, 'fe$')"
)
def plural_forms(spark, sf_dir):
    nouns = tables.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("w")).distinct()
    return nouns.select("w", F.explode(T.plurals(F.col("w"))).alias("plural"))


@query(
    O.judged_ctes(O.ENGLISH)
    + f""", w AS (SELECT DISTINCT tok FROM toks WHERE NOT opaque AND length(tok) > 1),
c AS (SELECT tok, 0 AS step, tok AS form FROM w UNION ALL SELECT tok, k, left(tok, length(tok) - length(suf)) || rep FROM w, {O.deinflect()} WHERE ends_with(tok, suf) AND length(tok) > length(suf) + 2),
b AS (SELECT tok, step, c.form, base, base IS NOT NULL AS good FROM c LEFT JOIN {_FORMS} ON f.form = c.form WHERE base IS NOT NULL OR c.form IN {O.listed(dictionary.seed().sets['banned'])}
      QUALIFY row_number() OVER (PARTITION BY tok ORDER BY step) = 1)
SELECT w.tok AS word, CASE WHEN b.form IS NULL THEN 'unknown' WHEN NOT good THEN 'non_approved' WHEN step = 0 THEN 'approved' ELSE 'approved-inflected' END AS kind, coalesce(base, b.form, w.tok) AS base
FROM w LEFT JOIN b ON b.tok = w.tok"""
)
def word_lookup(spark, sf_dir):
    words = segments.tokens(tables.english(spark, sf_dir)).where("NOT opaque AND length(tok) > 1").select(F.col("tok").alias("word"))
    return dictionary.looked_up(words)


@query(
    O.judged_ctes(O.ENGLISH)
    + f""", h AS (SELECT doc_id, hit AS base, CASE WHEN maybe THEN 'maybe_noun' ELSE kind END AS kind, sent, ord FROM judged WHERE plain AND kind IN ('non_approved', 'unknown')),
g AS (SELECT doc_id, base, arg_min(kind, sent * 100000 + ord) AS kind, count(*) AS count FROM h GROUP BY ALL)
SELECT doc_id, g.base, g.kind, count, CASE WHEN g.kind = 'unknown' THEN '' ELSE coalesce(alts, '') END AS alts, CASE WHEN g.kind = 'unknown' THEN '' ELSE coalesce(pos, '') END AS pos, hint
FROM g LEFT JOIN {O.bases()} ON b.base = g.base"""
)
def word_hits(spark, sf_dir):
    return rules_en.word_hits(tables.english(spark, sf_dir), dictionary.seed()).select("doc_id", "base", "kind", "count", "alts", "pos", "hint")


@query(O.judged_ctes(O.ENGLISH) + ", g AS (SELECT hit AS base, count(*) AS n FROM judged WHERE plain AND kind IN ('non_approved', 'unknown') GROUP BY hit) SELECT base, n, hint FROM g JOIN " + O.bases() + " USING (base) WHERE hint IS NOT NULL")
def hedge_hints(spark, sf_dir):
    found = rules_en.word_hits(tables.english(spark, sf_dir), dictionary.seed()).where("hint IS NOT NULL")
    return found.groupBy("base", "hint").agg(F.sum("count").alias("n")).select("base", "n", "hint")


@query()
def report_json_en(spark, sf_dir):
    return rules_en.reports(tables.english(spark, sf_dir), dictionary.seed()).select("doc_id", F.col("json").alias("report"))


@query()
def lookup_en(spark, sf_dir):
    """Entries for the words of part types and those of the seed that are not approved."""
    types = tables.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word"))
    more = spark.createDataFrame([(w,) for w in [*(w for w, _, _ in dictionary.NOT_APPROVED), "removing", "may", "thing"]], "word string")
    return dictionary.lookup_entries(types.unionByName(more))


_RU_WORDS = f"SELECT DISTINCT replace(lower(unnest({O.every('text', T.PROSE_TOKEN)})), 'ё', 'е') AS word FROM ({O.RUSSIAN})"


def _ru_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.explode(F.regexp_extract_all("text", F.lit(T.PROSE_TOKEN), F.lit(0)))
    return tables.russian(spark, sf_dir).select(every.alias("w")).select(T.normalised(F.col("w")).alias("word"))


@query(f"SELECT word, arg_max(ending, length(ending)) AS ending FROM ({_RU_WORDS}) w JOIN {O._ENDS} AS e(class, ending) ON class = 'v' AND ends_with(word, ending) AND length(word) > length(ending) GROUP BY word")
def verb_endings(spark, sf_dir):
    """The longest verb ending of each word of the Russian texts that has one."""
    return lexicon_ru.longest_endings(_ru_words(spark, sf_dir))


@query(
    f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT replace(lower(unnest({O.every('text', T.PROSE_TOKEN)})), 'ё', 'е') AS word FROM ({O.RUSSIAN})) GROUP BY word),
ends AS (SELECT * FROM {O._ENDS} AS e(class, ending)), splits AS (SELECT word, left(word, k) AS head, substr(word, k + 1) AS tail FROM w, unnest(range(1, length(word) + 1)) AS u(k)),
m AS ({O.match_sql(lexicon_ru.SEED['ru-non-approved'])}) SELECT CAST(row_id AS INT) AS row_id, word AS form, n FROM m JOIN w USING (word)"""
)
def ru_surface_forms(spark, sf_dir):
    """Forms of banned words that stand in the Russian texts, and how often."""
    forms = lexicon_ru.surface_forms(spark, lexicon_ru.SEED["ru-non-approved"]).where("size = 1").select("row_id", "form").distinct()
    used = _ru_words(spark, sf_dir).groupBy(F.col("word").alias("form")).agg(F.count("*").alias("n"))
    return used.join(forms, "form").select("row_id", "form", "n")


@query(O.finding_ctes(O.RUSSIAN) + " SELECT doc_id, CAST(sent AS INT) AS sent, CAST(ord AS INT) AS ord, row_id, match FROM lexicon")
def ru_lexicon(spark, sf_dir):
    return lexicon_ru.single_words(tables.russian(spark, sf_dir)).select("doc_id", "sent", "ord", "row_id", "match")


@query(O.finding_ctes(O.RUSSIAN) + " SELECT CASE WHEN soft THEN 'domain' ELSE 'lexicon' END AS rule, NOT soft AS hard, row_id, count(*) AS n FROM lex GROUP BY ALL")
def ru_domain_sense(spark, sf_dir):
    found = lexicon_ru.single_words(tables.russian(spark, sf_dir))
    return found.groupBy("rule", "hard", "row_id").agg(F.count("*").alias("n"))


@query(O.finding_ctes(O.RUSSIAN) + " SELECT doc_id, CAST(sent AS INT) AS sent, CAST(n AS BIGINT) AS n FROM phrases WHERE n > 0")
def ru_phrases(spark, sf_dir):
    found = lexicon_ru.phrases(tables.russian(spark, sf_dir), lexicon_ru.SEED["ru-non-approved"])
    return found.groupBy("doc_id", "sent").agg(F.count("*").alias("n"))


@query(
    f"""WITH w AS ({_RU_WORDS}), ends AS (SELECT * FROM {O._ENDS} AS e(class, ending)),
splits AS (SELECT word, left(word, k) AS head, substr(word, k + 1) AS tail FROM w, unnest(range(1, length(word) + 1)) AS u(k)),
m AS (SELECT 'ru-non-approved' AS t, * FROM ({O.match_sql(lexicon_ru.SEED['ru-non-approved'])}) UNION SELECT 'ru-allowed', * FROM ({O.match_sql(lexicon_ru.SEED['ru-allowed'])})
      UNION SELECT 'ru-domain', * FROM ({O.match_sql(lexicon_ru.SEED['ru-domain'])})) SELECT word AS term, t AS "table", CAST(row_id AS INT) AS row_id FROM m"""
)
def lookup_ru(spark, sf_dir):
    """Rows of the lexicon for each word of the Russian texts."""
    return lexicon_ru.lookup(spark, _ru_words(spark, sf_dir).select(F.col("word").alias("term")))


@query()
def lookup_lines_ru(spark, sf_dir):
    """Entries of all five tables for the words of part types and some Russian ones."""
    types = tables.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("term"))
    more = spark.createDataFrame([(t,) for t in ("деплоить", "журн", "wait 5 ms", "recommended", "нет")], "term string")
    return lexicon_ru.lookup_lines(spark, types.unionByName(more))


def _clusters(docs: str) -> str:
    return O.judged_ctes(docs) + " SELECT doc_id, CAST(sent AS INT) AS sent, match AS cluster, count(*) AS n FROM clusters GROUP BY ALL"


def _noun_clusters(docs: DataFrame) -> DataFrame:
    rows, judged = _judged(docs)
    found = F.explode(T.let(judged, rules_en.clusters_of)).alias("cluster")
    return rows.select("doc_id", "sent", found).groupBy("doc_id", "sent", "cluster").agg(F.count("*").alias("n"))


@query(_clusters(O.ENGLISH))
def noun_clusters(spark, sf_dir):
    return _noun_clusters(tables.english(spark, sf_dir))


@query(_clusters(O.DOCUMENTS))
def noun_clusters_documents(spark, sf_dir):
    return _noun_clusters(documents(spark, sf_dir))


@query(O.sentence_ctes(O.ENGLISH) + f" SELECT doc_id, CAST(sent AS INT) AS sent, {O.mode('text', dictionary.seed().sets["verbs"])} AS mode FROM sents")
def sentence_mode(spark, sf_dir):
    rows = dictionary.seed().attached(segments.sentences(tables.english(spark, sf_dir)))
    return rows.select("doc_id", "sent", rules_en.mode_of(F.col("text"), is_verb=lambda word: dictionary.has(word, dictionary.VERB)).alias("mode"))


@query()
def report_text_en(spark, sf_dir):
    return rules_en.reports(tables.english(spark, sf_dir), dictionary.seed()).select("doc_id", F.split("text", "\n").alias("lines"))


@query(
    f"""WITH w AS ({_WORDS.replace('documents', f'({O.ENGLISH})')}), t AS (SELECT unnest({O.array_of(glossary.DEFAULT)}) AS term), f AS (SELECT term, term AS form FROM t UNION SELECT term, term || 's' FROM t
 UNION SELECT term, term || 'es' FROM t WHERE regexp_matches(term, '(s|x|z|ch|sh)$') UNION SELECT term, left(term, length(term) - 1) || 'ies' FROM t WHERE regexp_matches(term, '[^aeiou]y$'))
SELECT form, term, count(*) AS n FROM f JOIN w ON word = form GROUP BY ALL"""
)
def glossary_terms(spark, sf_dir):
    """Terms of one word and their plurals that stand in the English texts."""
    forms = glossary.known_forms(glossary.terms(spark)).where("n_words = 1").select("form", "term")
    return _words(tables.english(spark, sf_dir)).groupBy(F.col("word").alias("form")).agg(F.count("*").alias("n")).join(forms, "form").select("form", "term", "n")


@query(O.never_ctes() + " SELECT pair_id, match, count(*) AS n FROM violations GROUP BY ALL")
def glossary_never(spark, sf_dir):
    return glossary.violations(tables.pairs(spark, sf_dir)).groupBy("pair_id", "match").agg(F.count("*").alias("n"))


@query(O.never_ctes() + " SELECT pair_id, CAST(row_id AS INT) AS row_id, match, count(*) AS n FROM violations GROUP BY ALL")
def glossary_violations(spark, sf_dir):
    return glossary.violations(tables.pairs(spark, sf_dir)).groupBy("pair_id", "row_id", "match").agg(F.count("*").alias("n"))


@query()
def glossary_merge(spark, sf_dir):
    return glossary.merged(tables.pairs(spark, sf_dir))


from proseflow.plans import checks  # noqa: E402, F401  (registers more queries)
