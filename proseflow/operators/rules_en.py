"""The rules for English that need no dictionary, and the findings they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.operators import segments as S

# Word lists of the rules.
PARTICIPLES = (
    "been done given gone made put set shown seen held kept known taken written broken cut let read sent spent left found got worn torn bent "
    "built lost run won begun become come drawn driven fallen flown frozen hidden hit led lit met paid said sold spoken stuck thrown "
    "understood hung shut spread split"
).split()
BE = "is are was were be been being am".split()
HAVE = "have has had".split()
DETERMINERS = (
    "the a an this these its their your our each all some many no of front rear top bottom left right new old primary applicable correct "
    "two three four five six"
).split()
FUNCTION_WORDS = (
    "a an the and or of to in on at for with by from as is are was were be not no if when that this these it you we they than then thus but "
    "also only each all its their"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million half quarter third fourth fifth"
).split()
CONDITION_HEADS = "if when before after while until unless".split()
IMPERATIVE_HEADS = (
    "do make put set remove install connect disconnect turn press push pull open close start stop use apply examine measure tighten loosen "
    "attach hold keep wait read refer record replace discard clean fill drain lift lower move operate energize de-energize obey get go let cut "
    "lubricate tag torque adjust align release engage disengage select touch enter type click tap swipe scroll save download upload reboot "
    "restart update insert mount unscrew screw supply send give show write add count identify compare continue repeat always never only "
    "carefully slowly immediately then first also"
).split()
#: Order of kinds in a report.
KINDS = "length paragraph tense passive ing punctuation contraction noun-cluster latin pronoun".split()
LIMITS = {"procedural": 20, "descriptive": 25}
PARAGRAPH_LIMIT = 6

FINDINGS = "array<struct<seq:int,rule:string,kind:string,match:string>>"


def mode_of(sentence: Column, mode: str = "auto", is_verb=None) -> Column:
    """``procedural`` or ``descriptive``.  is_verb: of a word, whether it is a form of an approved verb, if a dictionary is at hand."""
    if mode != "auto":
        return F.lit(mode)
    is_verb = is_verb or (lambda word: F.lit(False))
    first = F.regexp_replace(F.regexp_replace(sentence, T.LIST_MARKER, ""), T.SAFETY_LABEL, "")
    head = F.lower(F.regexp_extract(first, "[A-Za-z']+", 0))
    after_comma = F.lower(F.regexp_extract(first, f",{T.WS}*([A-Za-z']+)", 1))
    note = sentence.rlike(rf"(?i)^NOTE{T.WS}*:")
    return (
        F.when(note | (head == ""), "descriptive")
        .when(head.isin(CONDITION_HEADS) & is_verb(after_comma), "procedural")
        .when(head.isin(IMPERATIVE_HEADS) | (~head.isin("it", "this", "there") & is_verb(head)), "procedural")
        .otherwise("descriptive")
    )


def judged(tokens: Column, glossary: list[str] = ()) -> Column:
    """Tokens with what the dictionary that is attached says of them in their place.

    ``tok, opaque, plain, phrase, still, prev, prev_bits, next, next_bits, bits, kind, hit, maybe_noun, ends``: ``kind``
    is that of the look-up after the excuse of a noun, ``ends`` whether the token ends a run of nouns.  One probe a
    token; neighbours give what was found for them.
    """
    shown = lambda fields: F.struct(*(c.alias(k) for k, c in fields.items() if c is not None))
    own = F.transform(looked_up(tokens), lambda x: shown(_alone(x, glossary) | {"missing": None}))
    at = lambda ts, i: {"missing": F.get(ts, i).isNull()} | {c: F.get(ts, i)[c] for c in ("tok", "opaque", "plain", "phrase", "still", "bits", "kind", "hit", "of_hit")}
    # Neighbours are taken from the bound array: an unbound one would be made again for each of them.
    return T.let(own, lambda ts: F.transform(ts, lambda t, i: shown(_in_place(at(ts, i), at(ts, i - 1), at(ts, i + 1), i))))


def looked_up(tokens: Column) -> Column:
    """Tokens with what the dictionary that is attached has of them: ``tok, opaque, f``; ``f`` is null for a word that it does not have."""
    from proseflow.operators import dictionary as D

    def one(t: Column) -> Column:
        tok = t["tok"]
        found = F.when(tok.contains("_"), D.probe(F.replace(tok, F.lit("_"), F.lit(" ")))).otherwise(D.probe(tok))
        return F.struct(tok.alias("tok"), t["opaque"].alias("opaque"), found.alias("f"))

    return F.transform(tokens, one)


def _alone(x: Column, glossary: list[str] = ()) -> dict[str, Column]:
    """What is known of a token (``looked_up``) without its neighbours."""
    from proseflow.operators import dictionary as D

    tok, opaque, f = x["tok"], x["opaque"], x["f"]
    bits = F.coalesce(f["bits"], F.lit(0))
    phrase = ~opaque & tok.contains("_")
    still = ~opaque & ((F.length(tok) < 2) | (bits.bitwiseAND(D.IS_STILL) != 0))
    plain = ~opaque & ~phrase & ~still & (bits.bitwiseAND(D.IS_NUMBER) == 0)
    kind, hit, of_hit = F.coalesce(f["kind"], F.lit(D.UNKNOWN)), F.coalesce(f["hit"], tok), F.coalesce(f["of_hit"], F.lit(0))
    if glossary:
        given = tok.isin(sorted(glossary))
        kind, hit, of_hit = F.when(given, D.GLOSSARY).otherwise(kind), F.when(given, tok).otherwise(hit), F.when(given, bits).otherwise(of_hit)
    return {"missing": x.isNull(), "tok": tok, "opaque": opaque, "plain": plain, "phrase": phrase, "still": still, "bits": bits, "kind": kind, "hit": hit, "of_hit": of_hit}


def _in_place(t: dict[str, Column], before: dict[str, Column], after: dict[str, Column], i: Column) -> dict[str, Column]:
    """The fields of ``judged`` for a token between its neighbours."""
    from proseflow.operators import dictionary as D

    prev_bits = F.coalesce(before["bits"], F.lit(0))
    hidden = after["opaque"] | after["phrase"]
    next_bits = F.when(after["missing"] | hidden, 0).otherwise(after["bits"])
    following = F.when(after["missing"], "").when(after["opaque"], "<").otherwise(after["tok"])
    of_hit = lambda bit: t["of_hit"].bitwiseAND(bit) != 0
    of_prev = lambda bit: prev_bits.bitwiseAND(bit) != 0
    known, banned = t["kind"] == D.GLOSSARY, t["plain"] & (t["kind"] == D.NON_APPROVED)
    verb_only, noun, determined = of_hit(D.ALL_VERB), of_hit(D.NOUNISH), of_prev(D.IS_DETERMINER)
    maybe = banned & ~determined & (i > 0) & ~of_prev(D.IS_SLOT) & verb_only & ~of_hit(D.LOOKS_VERB) & (noun | ~of_prev(D.FUNCTION))
    final = F.when(banned & determined & verb_only, F.when(noun, D.APPROVED_KIND).otherwise(D.UNKNOWN)).otherwise(t["kind"])
    ends = F.when(known, of_hit(D.FUNCTION | D.VERB)).otherwise(of_hit(D.FUNCTION_BASE | D.VERB_BASE))
    adverb = ~known & t["tok"].endswith("ly") & (F.length(t["tok"]) > 3) & (t["bits"].bitwiseAND(D.NO_ADVERB) == 0)
    ends = t["plain"] & (ends | adverb | ((final == D.NON_APPROVED) & verb_only & ~maybe))
    return {c: t[c] for c in ("tok", "opaque", "plain", "phrase", "still", "bits", "hit")} | {
        "kind": F.when(t["plain"], final), "prev": F.coalesce(F.replace(before["tok"], F.lit("_"), F.lit(" ")), F.lit("")), "prev_bits": prev_bits,
        "next": following, "next_bits": next_bits, "maybe_noun": maybe, "ends": ends,
    }


_RUN = 4
_FINDING = "struct<rule:string,kind:string,match:string>"


def _finding(rule: Column, kind: str, match: Column) -> Column:
    return F.struct(rule.alias("rule"), F.lit(kind).alias("kind"), match.alias("match"))


def _of_token(t: Column) -> Column:
    """Tense, -ing and passive findings of a judged token."""
    from proseflow.operators import dictionary as D

    tok = t["tok"]
    after_have, after_be = (t["prev_bits"].bitwiseAND(b) != 0 for b in (D.IS_HAVE, D.IS_BE))
    participle = tok.endswith("ed") | (t["bits"].bitwiseAND(D.IS_PARTICIPLE) != 0)
    verbal = (t["next"] == "") | (t["next_bits"].bitwiseAND(D.FUNCTION | D.VERB | D.IS_BE) != 0)
    both = F.concat_ws(" ", t["prev"], tok)
    stilled = ~t["opaque"] & (t["bits"].bitwiseAND(D.IS_STILL) != 0)
    ing = t["plain"] & (t["kind"] != D.GLOSSARY) & T.is_ing_form(tok)
    free = F.when((t["prev_bits"].bitwiseAND(D.IS_DETERMINER) != 0) | ~verbal, "3.5?").otherwise("3.5")
    have = t["plain"] & after_have & participle & (tok != "need")
    passive = t["plain"] & after_be & participle
    found = F.array_compact(F.array(
        F.when(stilled, _finding(F.lit("3.4"), "tense", tok)), F.when(ing, _finding(free, "ing", tok)), F.when(have, _finding(F.lit("3.4"), "tense", both)),
        F.when(passive, _finding(F.when(t["next"] == "by", "3.6").otherwise("3.6?"), "passive", both)),
    ))
    none = F.expr("array()").cast(f"array<{_FINDING}>")
    return F.when(~t["opaque"] & (stilled | tok.endswith("ing") | after_have | after_be), found).otherwise(none)


def token_findings(judged_: Column) -> Column:
    """Those of ``judged_findings`` that need no run of nouns: tense, passive and -ing, in order."""
    return F.flatten(F.transform(judged_, _of_token))


def judged_findings(tokens: Column, glossary: list[str] = ()) -> Column:
    """Tense, passive, -ing and noun cluster findings of ``looked_up`` tokens (bound), in the order of the rules.

    A text of the runs is searched, as in ``clusters_of``; a token that may have findings of its own is noted in it by
    ``\\x04`` and its place.  Words that the dictionary does not have, most of them, need no neighbours.
    """
    from proseflow.operators import dictionary as D

    def placed(i: Column) -> dict[str, Column]:
        return _in_place(*(_alone(F.get(tokens, k), glossary) for k in (i, i - 1, i + 1)), i)

    def piece(x: Column, i: Column) -> Column:
        tok, opaque, f = x["tok"], x["opaque"], x["f"]
        word, bits, t = F.concat(tok, F.lit("\x01")), F.coalesce(f["bits"], F.lit(0)), placed(i)
        whole = F.when(t["phrase"], "\x02").when(t["still"], "").when(t["ends"], "\x03").otherwise(word)
        adverb = tok.endswith("ly") & (F.length(tok) > 3)
        unknown = F.when(opaque, word).when(tok.contains("_"), "\x02").when(F.length(tok) < 2, "").when(adverb, "\x03").otherwise(word)
        after = (tok.endswith("ed") | (bits.bitwiseAND(D.IS_PARTICIPLE) != 0)) & (F.coalesce(F.get(tokens, i - 1)["f"]["bits"], F.lit(0)).bitwiseAND(D.IS_HAVE | D.IS_BE) != 0)
        noted = ~opaque & (tok.endswith("ing") | after | (bits.bitwiseAND(D.IS_STILL) != 0))
        own = whole if glossary else F.when(f.isNull(), unknown).otherwise(whole)
        return F.when(noted, F.concat(F.lit("\x04"), i.cast("string"), F.lit("\x04"), own)).otherwise(own)

    def of(run: Column) -> Column:
        none = F.array().cast(f"array<{_FINDING}>")
        ords = F.regexp_extract_all(run, F.lit(r"\x04(\d+)\x04"), F.lit(1))
        noted = F.when(run.contains("\x04"), F.flatten(F.transform(ords, lambda i: _of_token(placed(i.cast("int")))))).otherwise(none)
        cluster = lambda r: F.when(_is_told(r), F.array(_finding(F.lit("2.1"), "noun-cluster", _nouns(r)))).otherwise(none)
        return F.concat(noted, T.let(F.regexp_replace(run, r"\x04\d+\x04", ""), cluster))

    runs = F.concat(F.array_join(F.transform(tokens, piece), ""), F.lit("\x03"))
    return F.flatten(F.transform(F.regexp_extract_all(runs, F.lit(_A_RUN), F.lit(0)), of))


_A_RUN = r"[^\x02\x03]*+[\x02\x03]"


def _is_told(run: Column) -> Column:
    return run.endswith("\x03") & run.rlike(r"^(?:[^\x01]+\x01){%d}" % _RUN)


def _nouns(run: Column) -> Column:
    return F.translate(F.regexp_replace(run, r"\x01\x03\z", ""), "\x01", " ")


def clusters_of(judged_: Column) -> Column:
    """Runs of four judged tokens (bound) or more that are noun-like, as text.

    A text of the runs is searched: ``\\x01`` stands after a word, ``\\x02`` for the end of a run that is dropped, ``\\x03`` for that of one that is told.
    """
    piece = lambda t: F.when(t["phrase"], "\x02").when(t["still"], "").when(t["ends"], "\x03").otherwise(F.concat(t["tok"], F.lit("\x01")))
    runs = F.concat(F.array_join(F.transform(judged_, piece), ""), F.lit("\x03"))
    return F.transform(F.filter(F.regexp_extract_all(runs, F.lit(_A_RUN), F.lit(0)), _is_told), _nouns)


def hits_of(judged_: Column) -> Column:
    """``ord, base, kind`` for the words that are not approved, may not be as a verb, or are not known."""
    from proseflow.operators import dictionary as D

    kind = lambda t: F.when(t["maybe_noun"], "maybe_noun").when(t["kind"] == D.NON_APPROVED, "non_approved").otherwise("unknown")
    bad = lambda t, i: F.when(t["plain"] & t["kind"].isin(D.NON_APPROVED, D.UNKNOWN), F.struct(i.alias("ord"), t["hit"].alias("base"), kind(t).alias("kind")))
    return F.array_compact(F.transform(judged_, bad))


def word_hits(docs: DataFrame, own, glossary: list[str] = (), terms: list[str] = ()) -> DataFrame:
    """``doc_id, base, kind, count, first, example, alts, pos, hint``: words to change, by base.

    Kind, example and ``first`` (sentence and place) are those of the first use.  Words meet the
    dictionary inside their sentence; only what is to be reported is grouped.
    """
    judged_ = judged(S.tokens_of(F.col("text"), terms), glossary)
    rows = own.attached(S.shown_sentences(docs)).select("doc_id", "sent", short(F.col("shown")).alias("example"), F.inline(T.let(judged_, hits_of)))
    at = F.struct("sent", "ord")
    found = rows.groupBy("doc_id", "base").agg(F.min_by(F.struct("kind", "example"), at).alias("x"), F.count("*").alias("count"), F.min(at).alias("first"))
    found = found.join(own.bases(docs.sparkSession), "base", "left")
    shown = lambda c: F.when(F.col("x.kind") == "unknown", "").otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c)
    return found.select("doc_id", "base", "x.kind", "count", "first", "x.example", shown("alts"), shown("pos"), "hint")


def short(sentence: Column) -> Column:
    """A sentence to show: 87 characters and three dots if it has more than 90."""
    return F.when(F.length(sentence) > 90, F.concat(F.left(sentence, F.lit(87)), F.lit("..."))).otherwise(sentence)


def sentence_findings(sentence: Column, mode: str = "auto", glossary: list[str] = (), terms: list[str] = ()) -> Column:
    """Findings of a sentence, ``rule, kind, match``, in the order of the rules; a dictionary is attached."""

    def of(masked: Column) -> Column:
        return F.concat(_whole(masked, mode), T.let(looked_up(S.plain_tokens(masked, terms)), lambda ts: judged_findings(ts, glossary)))

    return T.let(S.marked(sentence), of)


def _whole(masked: Column, mode: str) -> Column:
    """Findings of a sentence as a whole: length, semicolon, contractions, Latin, pronoun."""
    from proseflow.operators import dictionary as D

    procedural = mode_of(masked, mode, lambda word: D.has(word, D.VERB)) == "procedural"
    finding = lambda rule, kind, match: F.struct(rule.alias("rule"), F.lit(kind).alias("kind"), match.alias("match"))
    limit = F.when(procedural, LIMITS["procedural"]).otherwise(LIMITS["descriptive"])
    long_ = lambda n: F.when(n > limit, finding(F.when(procedural, "5.1").otherwise("6.3"), "length", n.cast("string")))
    first = F.array(T.let(T.word_count(masked), long_), F.when(masked.contains(";"), finding(F.lit("8.1"), "punctuation", F.lit(";"))))
    seen = lambda rule, kind, value: T.let(value, lambda m: F.when(m != "", finding(F.lit(rule), kind, m)))
    last = F.array(seen("GR-6", "latin", T.latin_abbreviation(masked)), seen("GR-7", "pronoun", T.gender_pronoun(masked)))
    short = F.transform(T.contractions(masked), lambda m: finding(F.lit("4.2"), "contraction", m))
    return F.array_compact(F.concat(first, short, last))


def findings(docs: DataFrame, mode: str = "auto", own=None, glossary: list[str] = (), terms: list[str] = ()) -> DataFrame:
    """``doc_id, para, sent, seq, rule, kind, match``: paragraph findings have sentence 0.

    own: a dictionary; without one no runs of nouns are told; glossary: words that count as known; terms:
    those of several words, longest first.
    """
    from proseflow.operators import dictionary

    each = sentence_findings(F.col("text"), mode, glossary, terms)
    if own is None:
        own, each = dictionary.Dictionary([], []), F.filter(each, lambda f: f["kind"] != "noun-cluster")
    numbered = F.transform(each, lambda f, k: F.struct(F.col("sent").alias("sent"), (k + 1).alias("seq"), f["rule"].alias("rule"), f["kind"].alias("kind"), f["match"].alias("match")))
    long_ = F.struct(F.lit(0).alias("sent"), F.lit(0).alias("seq"), F.lit("6.6").alias("rule"), F.lit("paragraph").alias("kind"), F.col("n").cast("string").alias("match"))
    every = F.when(F.col("n") > PARAGRAPH_LIMIT, F.concat(F.array(long_), numbered)).otherwise(numbered)
    rows = own.attached(S.counted_sentences(docs)).select("doc_id", "para", F.explode(every).alias("f"))
    return rows.select("doc_id", "para", "f.*")


def ordered(found: DataFrame) -> DataFrame:
    """With ``place``, the position in the report of the document: by kind, paragraph, sentence, sequence."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    by = Window.partitionBy("doc_id").orderBy("kind_rank", "para", "sent", "seq")
    return found.withColumn("kind_rank", rank).withColumn("place", F.row_number().over(by))


def auto_glossary(docs: DataFrame, own=None) -> DataFrame:
    """``doc_id, term, kind, count, first``: code-like tokens that count as known, the kind that of the first."""
    from proseflow.operators import dictionary as D

    own = own or D.Dictionary([], [])
    terms = S.auto_terms(F.col("text"), lambda word: D.has(word, D.FORM | D.BANNED))
    rows = own.attached(S.sentences(docs)).select("doc_id", "sent", F.posexplode(terms).alias("ord", "x"))
    at = F.struct("sent", "ord")
    return rows.groupBy("doc_id", F.col("x.term").alias("term")).agg(F.min_by("x.kind", at).alias("kind"), F.count("*").alias("count"), F.min(at).alias("first"))


_MESSAGES = {
    "length": "%s words are too many for one sentence", "paragraph": "a paragraph of %s sentences; six are the most", "tense": '"%s" is no simple tense',
    "passive": '"%s" may be passive voice', "ing": '"%s" ends in -ing', "punctuation": "a semicolon (%s)", "contraction": '"%s" is to be written in full',
    "noun-cluster": 'nouns in a row: "%s"', "latin": 'the Latin abbreviation "%s"', "pronoun": 'the pronoun "%s"',
}


def _message(kind: Column, match: Column) -> Column:
    out = match
    for k, m in _MESSAGES.items():
        out = F.when(kind == k, F.format_string(m, match)).otherwise(out)
    return out


def reports(docs: DataFrame, own, mode: str = "auto", glossary: list[str] = (), terms: list[str] = ()) -> DataFrame:
    """``doc_id, text, json``: the report of each document.

    JSON: ``findings`` as they come, ``words`` in the order of their first use, ``auto_glossary``.
    Text: a summary, and sections of words by frequency, hedges, code, and findings by kind.
    """
    found = findings(docs, mode, own, glossary, terms)
    where = F.when(F.col("sent") == 0, F.format_string("para %d", "para")).otherwise(F.format_string("para %d, sentence %d", "para", "sent"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    item = F.struct("rule", "kind", _message(F.col("kind"), F.col("match")).alias("message"), where.alias("where"))
    row = F.struct("para", "sent", "seq", rank.alias("rank"), item.alias("item"))
    by_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("findings"))
    hit = F.struct("first", "base", F.struct("kind", "alts", "count", "example", "pos", "hint").alias("w"))
    words = word_hits(docs, own, glossary, terms).groupBy("doc_id").agg(F.sort_array(F.collect_list(hit)).alias("words"))
    auto = auto_glossary(docs, own).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", F.struct("term", "kind", "count").alias("a")))).alias("auto"))
    rows = docs.select("doc_id").join(by_doc, "doc_id", "left").join(words, "doc_id", "left").join(auto, "doc_id", "left")
    for c in ("findings", "words", "auto"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    pair = lambda x: F.concat(F.regexp_extract(F.to_json(F.struct(x["base"].alias("k"))), r"^\{\"k\":(.*)\}$", 1), F.lit(":"), F.to_json(x["w"]))
    json = F.concat(
        F.lit('{"findings":'), F.to_json(F.transform("findings", lambda x: x["item"])), F.lit(',"words":{'), F.array_join(F.transform("words", pair), ","),
        F.lit('},"auto_glossary":'), F.to_json(F.transform("auto", lambda x: x["a"])), F.lit("}"),
    )

    def of_kind(kind: str) -> Column:
        some = F.filter("words", lambda x: x["w"]["kind"] == kind)
        return F.array_sort(some, lambda a, b: F.when(a["w"]["count"] > b["w"]["count"], -1).when(a["w"]["count"] < b["w"]["count"], 1).when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0))

    rows = rows.withColumns({k: of_kind(k) for k in ("non_approved", "maybe_noun", "unknown")})
    times = lambda x: F.concat(x["base"], F.lit(" x"), x["w"]["count"].cast("string"))
    none = F.array().cast("array<string>")
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title), F.lit("-" * 60)), lines, F.array(F.lit("")))).otherwise(none)
    hedged = F.filter(F.concat("non_approved", "maybe_noun", "unknown"), lambda x: x["w"]["hint"].isNotNull())
    ranked = F.array_sort("findings", lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).when(F.struct(a["para"], a["sent"], a["seq"]) < F.struct(b["para"], b["sent"], b["seq"]), -1).otherwise(1))
    summary = F.format_string("findings %d, words not approved %d, not as a verb %d, not known %d", *(F.size(c) for c in ("findings", "non_approved", "maybe_noun", "unknown")))
    unknown = F.when(F.size("unknown") > 0, F.array(F.concat(F.lit("  "), F.array_join(F.transform("unknown", times), ", ")))).otherwise(none)
    clean = F.when(F.size("findings") + F.size("words") == 0, F.array(F.lit("nothing found"))).otherwise(none)
    lines = F.concat(
        F.array(F.lit("DICTIONARY CHECK"), F.lit("=" * 60), summary, F.lit("")),
        section("WORDS NOT APPROVED", F.transform("non_approved", lambda x: F.concat(F.lit("  "), x["base"], F.lit(" ("), x["w"]["pos"], F.lit(") x"), x["w"]["count"].cast("string"), F.lit("  ->  "), x["w"]["alts"]))),
        section("NOT APPROVED AS A VERB", F.transform("maybe_noun", lambda x: F.concat(F.lit("  "), times(x), F.lit("  ->  "), x["w"]["alts"]))),
        section("NOT IN THE DICTIONARY", unknown),
        section("HEDGES", F.transform(hedged, lambda x: F.concat(F.lit("  "), times(x), F.lit("  ->  "), x["w"]["hint"]))),
        section("CODE-LIKE TOKENS", F.transform("auto", lambda x: F.format_string("  %s (%s) x%d", x["a"]["term"], x["a"]["kind"], x["a"]["count"]))),
        section("STRUCTURE AND GRAMMAR", F.transform(ranked, lambda x: F.format_string("  [%s] %s   (%s)", x["item"]["rule"], x["item"]["message"], x["item"]["where"]))),
        clean,
    )
    return rows.select("doc_id", F.array_join(lines, "\n").alias("text"), json.alias("json"))
