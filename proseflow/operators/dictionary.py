"""The dictionary as tables: forms, lookup by de-inflection, and reports of words.

Dictionaries are parameters; the seed is a small one of facts that users replace.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseflow.functions import text as T
from proseflow.operators import rules_en

# (word, part of speech, other forms)
APPROVED = [
    ("remove", "v", "removes removed"), ("tool", "n", ""), ("make sure", "v", ""), ("be", "v", "is are was were"), ("the", "art", ""),
    ("cover", "n", ""), ("do", "v", "does did"), ("test", "n", ""), ("clean", "v", "cleans cleaned"), ("connect", "v", "connects connected"),
    ("unit", "n", ""), ("can", "v", ""), ("must", "v", ""), ("divide", "v", ""), ("record", "v", ""), ("install", "v", ""), ("error", "n", ""),
    ("change", "n", ""), ("code", "n", ""), ("value", "n", ""), ("interface", "n", ""), ("possible", "adj", ""), ("it", "pron", ""),
]
# (word, part of speech, instead)
NOT_APPROVED = [
    ("ensure", "v", "MAKE SURE (v)"), ("should", "v", "MUST (v), IF (conj)"), ("lose", "v", "DECREASE (v)"), ("fail", "v", ""), ("call", "v", ""),
    ("request", "n", ""), ("fix", "v", ""), ("process", "v", ""), ("approve", "v", ""),
]
#: Suffixes that are undone in this order, and what takes their place.
DEINFLECT = [("ies", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("er", ""), ("est", ""), ("ly", "")]


# Words of a form or note cell that are no forms, parts of speech that end a run of nouns,
# verbs that are nothing else, words that a verb follows, and endings of verbs.
FORM_STOP = (
    "no other verb forms also for example use this word only as an adjective or the a in of not to do with that is it you and when but form same plural "
    "noun singular adverb these words before after used meaning meanings sense context refer"
).split()
FUNCTION_POS = "prep conj art pron adv".split()
ALWAYS_VERB = (
    "may might should would could shall ought ensure take perform provide obtain require allow enable indicate occur avoid achieve verify confirm assure "
    "determine establish maintain prevent proceed remain become seem appear consist contain possess acquire utilize utilise employ conduct carry commence "
    "cease terminate initiate activate deactivate locate relocate accomplish facilitate eliminate exceed persist arise happen depend rely refer reinstall retighten"
).split()
VERB_SLOT = "to you we they it can will must not do does did and then or always never carefully slowly immediately also only".split()
VERB_ENDINGS = ("ize", "ise", "ify", "ate", "en")
BE_FORMS = "is was are were be".split()
#: What keeps the strength of a hedge, in words of our own.
HEDGE_HINTS = {
    "may": "POSSIBLY; it stays a possibility", "might": "POSSIBLY; it stays a possibility", "perhaps": "POSSIBLY; it stays a possibility",
    "likely": "VERY POSSIBLE; it does not become a fact", "probably": "VERY POSSIBLE; it does not become a fact", "probable": "VERY POSSIBLE; it does not become a fact",
    "unlikely": "NOT VERY POSSIBLE; it can occur", "should": "advice is WE RECOMMEND, an obligation is MUST",
}


#: What is known of a word, as bits: whether it is a form or not approved, is (or its base is) a verb or function word, ...
(FORM, BANNED, VERB, FUNCTION, VERB_BASE, FUNCTION_BASE, ALL_VERB, NOUNISH, LOOKS_VERB, NO_ADVERB, IS_DETERMINER, IS_HAVE, IS_BE, IS_PARTICIPLE, IS_NUMBER, IS_SLOT, IS_STILL) = (
    1 << k for k in range(17)
)
#: Kinds of a look-up.
UNKNOWN, APPROVED_KIND, NON_APPROVED, INFLECTED, GLOSSARY = range(5)
KIND_NAMES = ("unknown", "approved", "non_approved", "approved-inflected", "glossary")
#: The column that ``Dictionary.attached`` adds, and words of a bucket of it, about.
COLUMN, BUCKET_WORDS = "__dictionary", 2
_ENTRY = "struct<w:string,bits:int,kind:int,hit:string,of_hit:int>"


class Dictionary:
    """A dictionary on the driver: its entries, the index of their forms, and sets of words that rules ask for.

    Its size is that of the word lists, whatever the documents.  Of words that share a form the
    first in order wins, but forms of BE are always BE's.  A word that is not approved is known
    with and without what stands in parentheses.

    Rules meet it as data: ``attached`` adds one hash relation of all words it can recognise,
    inflected ones included, as a scalar subquery, and ``probe`` looks a word up in it, so the
    size of a plan does not depend on that of the dictionary.
    """

    def __init__(self, approved: list[dict], not_approved: list[dict]):
        self.approved: dict[str, list[dict]] = {}
        self.banned: dict[str, list[dict]] = {}
        for e in approved:
            self.approved.setdefault(e["word"].lower(), []).append(e)
        for e in not_approved:
            whole = e["word"].lower()
            bare = re.sub(r"\s*\(.*?\)\s*", " ", whole).strip()
            for key in dict.fromkeys([bare, whole]):
                self.banned.setdefault(key, []).append(e)
        self.forms: dict[str, str] = {}
        for base, entries in self.approved.items():
            for e in entries:
                listed = re.findall(r"[a-z][a-z'\-]*", f"{e.get('forms') or ''} {e.get('note') or ''}".lower())
                own = [base, *(w for w in listed if w not in FORM_STOP and len(w) > 1)]
                if e["pos"] == "n":
                    own += plural_list(base)
                if e["pos"] == "v" and not e.get("forms"):
                    own += [base + "s", base + "ed"]
                for form in own:
                    self.forms.setdefault(form, base)
        self.forms |= dict.fromkeys(BE_FORMS, "be")
        for form in ("makes sure", "made sure"):
            self.forms.setdefault(form, "make sure")

    def has_pos(self, word: str, *pos: str) -> bool:
        return any(e["pos"] in pos for e in self.approved.get(word, []))

    def is_verb(self, word: str) -> bool:
        return self.has_pos(self.forms.get(word, word), "v")

    def is_function(self, word: str) -> bool:
        return word in rules_en.FUNCTION_WORDS or self.has_pos(word, *FUNCTION_POS)

    def all_verb(self, word: str) -> bool:
        return all(e["pos"] == "v" for e in self.banned.get(word, []))

    def nounish(self, word: str) -> bool:
        return self.has_pos(word, "n") or any(x.endswith("(TN)") for e in self.banned.get(word, []) for x in e.get("use_instead") or [])

    def looks_verb(self, word: str) -> bool:
        return word in ALWAYS_VERB or word.endswith(VERB_ENDINGS) or word.startswith("re") and word[2:] in self.approved

    @functools.cached_property
    def sets(self) -> dict[str, list[str]]:
        """Sorted lists for ``isin``: forms and words not approved, and those of both that rules treat alike."""
        every = {*self.forms, *self.approved, *self.banned, *rules_en.FUNCTION_WORDS}
        base = lambda w: self.forms.get(w, w)
        noun = lambda es: any(e["pos"] in ("n", "adj") for e in es)
        chosen = {
            "forms": self.forms, "banned": self.banned,
            "verbs": [w for w in every if self.is_verb(w)], "functions": [w for w in every if self.is_function(w)],
            "verb_bases": [w for w in every if self.is_verb(base(w))], "function_bases": [w for w in every if self.is_function(base(w))],
            "all_verb": [w for w in self.banned if self.all_verb(w)], "nounish": [w for w in self.banned if self.nounish(w)],
            "looks_verb": [w for w in self.banned if self.looks_verb(w)],
            "no_adverbs": [w for w in every if noun(self.approved.get(self.forms.get(w, ""), [])) or noun(self.banned.get(w, []))],
            "acronyms": {*self.forms, *self.banned},
        }
        return {k: sorted(v) or ["\0"] for k, v in chosen.items()}

    @functools.cached_property
    def bits(self) -> dict[str, int]:
        """The bits of each word that some rule asks for."""
        named = {
            FORM: self.sets["forms"], BANNED: self.sets["banned"], VERB: self.sets["verbs"], FUNCTION: self.sets["functions"], VERB_BASE: self.sets["verb_bases"],
            FUNCTION_BASE: self.sets["function_bases"], ALL_VERB: self.sets["all_verb"], NOUNISH: self.sets["nounish"], LOOKS_VERB: self.sets["looks_verb"],
            NO_ADVERB: self.sets["no_adverbs"], IS_DETERMINER: rules_en.DETERMINERS, IS_HAVE: rules_en.HAVE, IS_BE: rules_en.BE, IS_PARTICIPLE: rules_en.PARTICIPLES,
            IS_NUMBER: rules_en.NUMBER_WORDS, IS_SLOT: VERB_SLOT, IS_STILL: ["been", "being"],
        }
        out: dict[str, int] = {}
        for bit, words in named.items():
            for w in words:
                out[w] = out.get(w, 0) | bit
        return out

    @functools.cached_property
    def entries(self) -> dict[str, tuple[int, int, str, int]]:
        """Of each word that a look-up can find or a rule asks for: its bits, kind, what the dictionary has, and the bits of that.

        Endings are put on the dictionary's words once, instead of being taken off each token.
        """
        found: dict[str, tuple[int, int, str]] = {}

        def offer(word: str, step: int, kind: int, hit: str) -> None:
            if word not in found or (step, kind) < found[word][:2]:
                found[word] = step, kind, hit

        for words, plain, inflected in ((self.forms, APPROVED_KIND, INFLECTED), (self.banned, NON_APPROVED, NON_APPROVED)):
            for w in words:
                offer(w, 0, plain, w)
                for step, (suffix, instead) in enumerate(DEINFLECT, 1):
                    if w.endswith(instead) and len(w) - len(instead) > 2:
                        # Of both tables in one step the approved word comes first.
                        offer(w[: len(w) - len(instead)] + suffix, step, inflected if plain == APPROVED_KIND else NON_APPROVED + 2, w)
        out = {}
        for w in {*found, *self.bits}:
            _, kind, hit = found.get(w, (0, UNKNOWN, w))
            out[w] = self.bits.get(w, 0), NON_APPROVED if kind == NON_APPROVED + 2 else kind, hit, self.bits.get(hit, 0)
        return out

    def relation(self, spark: SparkSession) -> DataFrame:
        """``word, bits, kind, hit, of_hit``: ``entries`` as a table."""
        return spark.createDataFrame([(w, *x) for w, x in sorted(self.entries.items())], "word string, bits int, kind int, hit string, of_hit int")

    def buckets(self, spark: SparkSession) -> DataFrame:
        """``relation`` as one row: an array of buckets by the hash of the word."""
        n = max(1, len(self.entries) // BUCKET_WORDS)
        item = F.struct(F.col("word").alias("w"), "bits", "kind", F.when(F.col("hit") != F.col("word"), F.col("hit")).alias("hit"), "of_hit")
        filled = self.relation(spark).groupBy(F.pmod(F.xxhash64("word"), F.lit(n)).cast("int").alias("at")).agg(F.collect_list(item).alias("own"))
        every = spark.range(n).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
        return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "own"))), lambda x: x["own"]).alias(COLUMN))

    def attached(self, df: DataFrame) -> DataFrame:
        """``df`` with the dictionary as a column, for ``probe``."""
        return df.withColumn(COLUMN, self.buckets(df.sparkSession).scalar())

    def bases(self, spark: SparkSession) -> DataFrame:
        """``base, alts, pos, hint``: what to show for a word that is not approved, and hints for hedges."""
        rows = []
        for w in dict.fromkeys([*self.banned, *HEDGE_HINTS]):
            es = self.banned.get(w, [])
            alts = [", ".join(e.get("use_instead") or []) or e.get("note") or "" for e in es]
            rows.append((w, "; ".join(alts), "/".join(e["pos"] for e in es), HEDGE_HINTS.get(w)))
        return spark.createDataFrame(rows, "base string, alts string, pos string, hint string")

    def entry_lines(self) -> list[tuple[int, str, int, list[str]]]:
        """Of each entry: its table (0 approved, 1 not), the word it is under, its place there and its lines in a look-up."""
        out = []
        for word, entries in self.approved.items():
            for k, e in enumerate(entries):
                lines = [f"  APPROVED  {e['word']} ({e['pos']}): " + "; ".join(e.get("meaning") or [])]
                lines += [f"    {title}: {e[key]}" for title, key in (("forms", "forms"), ("note", "note"), ("for other meanings use", "for_other_meanings_use")) if e.get(key)]
                out.append((0, word, k, lines + [f"    e.g. {x}" for x in (e.get("examples") or [])[:2]]))
        for word, entries in self.banned.items():
            for k, e in enumerate(entries):
                wrong = e.get("incorrect_example") or []
                lines = [f"  NOT APPROVED  {e['word']} ({e['pos']})  ->  {', '.join(e.get('use_instead') or [])} {e.get('note') or ''}".rstrip()]
                for j, x in enumerate((e.get("example") or [])[: len(wrong) or 3]):
                    lines += [f"    Example: {x}", *([f"    not: {wrong[j]}"] if j < len(wrong) and wrong[j] else [])]
                out.append((1, word, k, lines))
        return out

    @functools.cached_property
    def shown(self) -> dict[tuple[int, str], list[str]]:
        out: dict[tuple[int, str], list[str]] = {}
        for table, word, _, lines in self.entry_lines():
            out.setdefault((table, word), []).extend(lines)
        return out

    def lookup_lines(self, word: str, deeper: bool = True) -> list[str]:
        """Entries of a word as lines: two approved examples, three others or as many as have a wrong counterpart."""
        w = word.strip().lower()
        base = self.forms.get(w, w)
        keys = [(0, base), (1, w), *([(1, base)] if base != w else [])]
        out = [line for key in keys for line in self.shown.get(key, [])]
        if not out and deeper:
            for suffix, instead in DEINFLECT[:7]:
                stem = w[: len(w) - len(suffix)] + instead
                if not out and w.endswith(suffix) and len(w) > len(suffix) + 2 and (stem in self.approved or stem in self.banned):
                    out = [f'  (see "{stem}")', *self.lookup_lines(stem, deeper=False)]
        if not out:
            out = [NOT_THERE]
        if deeper and w in HEDGE_HINTS:
            out.append(f"  keep the strength: {HEDGE_HINTS[w]}")
        return [f"== {w} ==", *out]


def plural_list(noun: str) -> list[str]:
    """As ``text.plurals``, for words on the driver."""
    out = [noun + "s"]
    out += [noun + "es"] if noun.endswith(("s", "x", "z", "ch", "sh")) else []
    out += [noun[:-1] + "ies"] if len(noun) > 1 and noun[-1] == "y" and noun[-2] not in "aeiou" else []
    out += [noun[:-1] + "ves"] if noun.endswith("f") else []
    return out + ([noun[:-2] + "ves"] if noun.endswith("fe") else [])


def read(spark: SparkSession, path: str) -> Dictionary:
    """A dictionary of ``{approved: [...], non_approved: [...]}`` from a JSON file; keys that are not known are ignored."""
    rows = spark.read.text(path, wholetext=True).collect()  # a word list, not documents
    raw = json.loads(rows[0].value)
    return Dictionary(raw.get("approved") or [], raw.get("non_approved") or [])


@functools.cache
def seed() -> Dictionary:
    given = [{"word": w, "pos": p, "forms": f} for w, p, f in APPROVED]
    return Dictionary(given, [{"word": w, "pos": p, "use_instead": [i] if i else []} for w, p, i in NOT_APPROVED])


NOT_THERE = "  not in the dictionary: a technical noun or verb, or to be replaced"


def lookup_entries(words: DataFrame, own: Dictionary | None = None) -> DataFrame:
    """``word, lines``: a look-up for each distinct ``words(word)``, as ``Dictionary.lookup_lines`` gives it, by joins.

    A word's own entries come first: those of the approved word it is a form of, then those that
    are not approved.  A word without any is tried without its ending, and the first ending that
    hits is followed one step.  Blanks around a word and capitals do not count; null words have no row.
    """
    own = own or seed()
    spark = words.sparkSession
    asked = words.select(F.lower(T.trimmed(F.col("word"))).alias("word")).where("word IS NOT NULL").distinct()
    forms = spark.createDataFrame(sorted(own.forms.items()), "word string, base string")
    entries = spark.createDataFrame(own.entry_lines(), "banned int, key string, place int, entry array<string>")
    heads = entries.select(F.col("key").alias("stem")).distinct()

    def of(given: DataFrame) -> DataFrame:
        based = given.join(forms, "word", "left").withColumn("base", F.coalesce("base", "word"))
        keys = F.array(
            F.struct(F.lit(0).alias("banned"), F.col("base").alias("key"), F.lit(0).alias("rank")), F.struct(F.lit(1).alias("banned"), F.col("word").alias("key"), F.lit(1).alias("rank")),
            F.when(F.col("base") != F.col("word"), F.struct(F.lit(1).alias("banned"), F.col("base").alias("key"), F.lit(2).alias("rank"))),
        )
        found = based.select("word", F.inline(F.array_compact(keys))).join(entries, ["banned", "key"])
        return found.groupBy("word").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place", "entry"))), lambda x: x["entry"])).alias("lines"))

    first = asked.join(of(asked), "word", "left")
    missing = first.where("lines IS NULL").select("word")
    word = F.col("word")
    tries = [
        F.when(word.endswith(suffix) & (F.length(word) > len(suffix) + 2), F.struct(F.lit(k).alias("step"), F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(instead)).alias("stem")))
        for k, (suffix, instead) in enumerate(DEINFLECT[:7])
    ]
    stems = missing.select("word", F.inline(F.array_compact(F.array(*tries)))).join(heads, "stem").groupBy("word").agg(F.min_by("stem", "step").alias("stem"))
    followed = of(stems.select(F.col("stem").alias("word")).distinct()).withColumnsRenamed({"word": "stem", "lines": "further"})
    further = F.concat(F.array(F.concat(F.lit('  (see "'), "stem", F.lit('")')), F.concat(F.lit("== "), "stem", F.lit(" =="))), "further")
    hints = spark.createDataFrame(sorted(HEDGE_HINTS.items()), "word string, hint string")
    out = first.join(stems.join(followed, "stem").select("word", further.alias("further")), "word", "left").join(hints, "word", "left")
    hint = F.when(F.col("hint").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("  keep the strength: "), "hint")))
    head = F.array(F.concat(F.lit("== "), "word", F.lit(" ==")))
    return out.select("word", F.concat(head, F.coalesce("lines", "further", F.array(F.lit(NOT_THERE))), hint).alias("lines"))


def lookup_report(spark: SparkSession, words: list[str], own: Dictionary | None = None) -> DataFrame:
    """``place, word, lines``: a look-up for each word, in order."""
    own = own or seed()
    return spark.createDataFrame([(i, w, own.lookup_lines(w)) for i, w in enumerate(words)], "place int, word string, lines array<string>")


def looked_up(words: DataFrame, own: Dictionary | None = None, glossary: list[str] = ()) -> DataFrame:
    """``word, kind, base`` for distinct ``words(word)``: glossary, approved, non_approved, approved-inflected or unknown.

    One join with the relation of all words that the dictionary can recognise; ``base`` is the
    approved word of a form, and the word itself where there is none.
    """
    own = own or seed()
    kinds = F.array(*map(F.lit, KIND_NAMES))
    known = own.relation(words.sparkSession).where(F.col("kind") != UNKNOWN).select("word", F.get(kinds, "kind").alias("kind"), "hit")
    forms = words.sparkSession.createDataFrame(sorted(own.forms.items()), "hit string, base string")
    given = F.col("word").isin(sorted(glossary) or ["\0"])
    base = F.coalesce(F.when(F.col("kind") != "non_approved", F.col("base")), "hit", "word")
    rows = words.select("word").distinct().join(known.join(forms, "hit", "left"), "word", "left")
    return rows.select("word", F.when(given, "glossary").otherwise(F.coalesce("kind", F.lit("unknown"))).alias("kind"), F.when(given, F.col("word")).otherwise(base).alias("base"))


def forms_used(words: DataFrame, own: Dictionary | None = None) -> DataFrame:
    """``form, base, n``: forms of approved words that stand among ``words(word)``, and how often."""
    own = own or seed()
    forms = words.sparkSession.createDataFrame(sorted(own.forms.items()), "form string, base string")
    return words.groupBy(F.col("word").alias("form")).agg(F.count("*").alias("n")).join(forms, "form").select("form", "base", "n")


def probe(word: Column) -> Column:
    """``w, bits, kind, hit, of_hit`` of a word in the dictionary that is attached, null if it does not have it; ``hit`` is null for the word itself."""
    bucket = lambda own: F.get(own, F.pmod(F.xxhash64(word), F.size(own)).cast("int"))
    return F.get(F.filter(bucket(F.col(COLUMN)), lambda e: e["w"] == word), F.lit(0))


def has(word: Column, bits: int) -> Column:
    """Whether the dictionary that is attached has one of the bits for the word."""
    return F.coalesce(probe(word)["bits"].bitwiseAND(bits) != 0, F.lit(False))
