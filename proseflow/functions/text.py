"""Scalar functions over prose, as Spark column expressions.

Everything here stays inside one row and one stage: no UDF, no shuffle.  Patterns avoid
bare ``\\b`` and ``\\w`` on text that may hold more than ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space class, list markers, labels, units and abbreviations of the rules.
WS = r"[\s\x0B\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0B\x{85}\p{Z}]"
#: The characters of that class.
WS_CHARS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LIST_MARKER = rf"^{WS}*(\(?(\d{{1,3}}[a-z]?|[A-Za-z]|[ivxIVX]{{2,4}})[.)]|[-•*–]|\p{{Nd}}+\.){WS}+"
LABEL = rf"(?i)^(WARNING|CAUTION|NOTE|DANGER|NOTICE){WS}*:{WS}*"
SAFETY_LABEL = rf"(?i)^(WARNING|CAUTION|DANGER){WS}*:{WS}*"
HEADING = rf"^{WS}*#{{1,6}}{WS}"
ABBREVIATIONS = "e.g. i.e. etc. No. Fig. fig. a.m. p.m. vs. approx. max. min.".split()
UNITS = (
    "°C °F % mm cm m km in ft kg g lb lbs oz psi kpa mpa bar nm n v kv mv a ma ka w kw mw hz khz mhz ghz "
    "ohm ohms Ω s ms min h hr hrs l ml gal rpm db c f k"
).split()
LATIN = ["e.g.", "i.e.", "etc.", "etc", "et al.", "et al", "vs.", "viz."]
PRONOUNS = "he she him her his hers himself herself".split()
APPROVED_ING = "lighting opening routing servicing mating missing remaining something during".split()
CONTRACTIONS = "it's let's that's there's what's here's who's".split()


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_at(text: Column, pattern: str) -> Column:
    """``text`` (bound) cut at a pattern of one character or more: a split by pattern compiles it for each row, a replacement once."""
    mark = "\x01"
    return F.when(text.contains(mark), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, mark), mark, -1))


#: Items that a fold takes at once, and pieces of text that are cut at once.
FOLD_BLOCK, CUT_BLOCK = 64, 512


def in_blocks(items: Column, size: int) -> Column:
    """The array (bound) cut into arrays of ``size`` elements, the last one shorter."""
    begins = F.filter(F.sequence(F.lit(0), F.size(items), F.lit(size)), lambda at: at < F.size(items))
    return F.transform(begins, lambda at: F.transform(F.sequence(at, F.least(at + size, F.size(items)) - 1), lambda i: F.get(items, i)))


def fold_list(items: Column, start: Column, step, element: str) -> Column:
    """The arrays that a fold over ``items`` gives, one after the other, in time linear in the items.

    step: (state, item) -> (next state, array of elements), columns both; state is like
    ``start`` and element the type of an element.  A fold copies all that it carries at each
    item.  So a first fold carries the state alone and notes it at the start of each block,
    and then each block is folded by itself and carries no more than its own elements.
    """
    none = F.expr("array()").cast(f"array<{element}>")

    def of_block(block: Column, begin: Column) -> Column:
        def merged(a: Column, x: Column) -> Column:
            state, out = step(a["state"], x)
            return F.struct(state.alias("state"), F.concat(a["out"], out).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("state"), none.alias("out")), merged, lambda a: a["out"])

    def over(blocks: Column) -> Column:
        first = F.struct(start.alias("state"), F.filter(F.array(start), lambda s: F.lit(False)).alias("starts"))
        after = lambda block, state: F.aggregate(block, state, lambda s, x: step(s, x)[0])
        noted = F.aggregate(blocks, first, lambda a, b: F.struct(after(b, a["state"]).alias("state"), F.array_append(a["starts"], a["state"]).alias("starts")), lambda a: a["starts"])
        starts = F.when(F.size(blocks) > 1, noted).otherwise(F.slice(F.array(start), F.lit(1), F.size(blocks)))
        return F.flatten(F.zip_with(blocks, starts, of_block))

    return let(items, lambda xs: let(in_blocks(xs, FOLD_BLOCK), over))


def cut_like(text: Column, pieces: Column) -> Column:
    """``text`` cut into pieces as long as those given.

    A place in a string is found by counting from its front, so text is cut for CUT_BLOCK
    pieces at once, and these from that cut.
    """
    length = lambda ps: F.aggregate(ps, F.lit(0), lambda n, p: (n + F.length(p)).cast("int"))

    def cut(whole: Column, sizes: Column) -> Column:
        return fold_list(sizes, F.lit(1), lambda at, n: ((at + n).cast("int"), F.array(F.substr(whole, at, n))), "string")

    def of(blocks: Column) -> Column:
        parts = cut(text, F.transform(blocks, length))
        return F.flatten(F.zip_with(blocks, parts, lambda ps, whole: cut(whole, F.transform(ps, lambda p: F.length(p)))))

    return let(in_blocks(pieces, CUT_BLOCK), of)


def first_of_each(found: Column) -> Column:
    """Of structs with the same ``match`` the first in order of the other fields, in that order.

    ``found``: bound (``let``) structs of ``match, line, col``.
    """
    by_match = F.array_sort(found)
    firsts = let(by_match, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["match"] != x["match"])))
    placed = F.array_sort(F.transform(firsts, lambda x: F.struct(x["line"].alias("line"), x["col"].alias("col"), x["match"].alias("match"))))
    return F.transform(placed, lambda x: F.struct(x["match"].alias("match"), x["line"].alias("line"), x["col"].alias("col")))


def escaped(literal: str) -> str:
    """A literal as a pattern that Java and RE2 read alike."""
    return "".join("\\" + c if c in r"\.+*?()[]{}|^$" else c for c in literal)


def trie_pattern(words: list[str]) -> str:
    """A pattern for the longest of ``words`` at a place: one way through a tree of letters, however many there are."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(node: dict) -> str:
        ways = [escaped(c) + of(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return inner + "?" * ("" in node)

    return of(tree)


NUMBER = r"[+\-−]?\d[\d,.:/]*"
WORD_UNIT = (
    r"\([^()]*\)|\"[^\"]+\"|“[^”]+”|"
    + NUMBER
    + WS
    + r"?(?:"
    + "|".join(map(escaped, UNITS))
    + r")\b|"
    + NUMBER
    + r"|\b[A-Z0-9][A-Z0-9\-/.]*\d[A-Z0-9\-/.]*\b|\b[A-Z]{2,}(?:[-/][A-Z0-9]+)*\b|\b\w+(?:-\w+)+\b|\b[\w']+\b"
)


def lf_normalised(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def fields(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NOT_WS + "+"), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Every letter and number outside ASCII becomes ``a``."""
    return F.regexp_replace(text, r"[[^\x00-\x7F]&&[\p{L}\p{N}]]", "a")


def without_marks(sentence: Column) -> Column:
    """Without a list marker and a safety label in front."""
    return F.regexp_replace(F.regexp_replace(trimmed(sentence), LIST_MARKER, ""), LABEL, "")


def word_count(sentence: Column) -> Column:
    """Words as counted by the length rules: a parenthesis, quotation, number with unit, identifier or hyphenated word is one."""
    unit = F.lit(WORD_UNIT)

    def of(text: Column) -> Column:  # only what is in parentheses or quotation marks can be without a word
        some = F.size(F.filter(F.regexp_extract_all(text, unit, F.lit(0)), lambda u: u.rlike("[A-Za-z0-9_]")))
        return F.when(text.rlike("[(\"“]"), some).otherwise(F.regexp_count(text, unit))

    return let(ascii_words(without_marks(sentence)), of)


def is_upper_word(word: Column) -> Column:
    return word.rlike(r"\p{Lu}") & ~word.rlike(r"[\p{Ll}\p{Lt}]")


def is_title_case(text: Column) -> Column:
    """Each word starts with a capital and goes on in lower case; text without cased letters counts."""
    return ~text.rlike(r"(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]")


def is_heading(line: Column) -> Column:
    title = (F.size(fields(line)) <= 8) & is_title_case(trimmed(line)) & ~trimmed(line).endswith(".")
    return line.rlike(HEADING) | title


def is_shouted(sentence: Column) -> Column:
    """At least three words of two bytes or more, most of them in capitals."""
    found = F.filter(F.regexp_extract_all(sentence, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.octet_length(w) >= 2)
    return let(found, lambda words: (F.size(words) >= 3) & (F.size(F.filter(words, is_upper_word)) * 2 > F.size(words)))


def is_ing_form(token: Column) -> Column:
    return token.endswith("ing") & ~token.isin(APPROVED_ING) & ~token.endswith("thing") & token.rlike("[aeiouy].*ing$")


def bounded(alternatives: list[str], tail: bool) -> str:
    """Pattern for the first of ``alternatives``, in any case, from a word boundary and, with ``tail``, to one."""
    word = r"[\p{L}\p{N}_]"

    def one(alternative: str) -> str:
        ends_in_word = alternative[-1].isalnum()
        return escaped(alternative) + ((rf"(?!{word})" if ends_in_word else rf"(?={word})") if tail else "")

    heads = "".join(sorted({a[0] for a in alternatives}))  # asked first: most places have another letter
    return rf"(?iu)(?=[{heads}])(?<!{word})(?:" + "|".join(map(one, alternatives)) + ")"


def latin_abbreviation(sentence: Column) -> Column:
    """The first Latin abbreviation, or ''; only its start needs a boundary."""
    return F.regexp_extract(sentence, bounded(LATIN, tail=False), 0)


def gender_pronoun(sentence: Column) -> Column:
    return F.regexp_extract(sentence, bounded(PRONOUNS, tail=True), 0)


def contractions(sentence: Column) -> Column:
    """Every contraction that is reported; a possessive is not one."""
    plain = F.replace(sentence, F.lit("’"), F.lit("'"))
    found = F.regexp_extract_all(plain, F.lit(r"(?iu)[\p{L}\p{N}_]+'(?:t|s|re|ve|ll|d|m)(?![\p{L}\p{N}_])"), F.lit(0))
    told = F.filter(found, lambda m: ~F.lower(m).endswith("'s") | F.lower(m).isin(CONTRACTIONS))
    return F.when(sentence.contains("'") | sentence.contains("’"), told).otherwise(F.array().cast("array<string>"))


def plurals(noun: Column) -> Column:
    """Possible plural forms, additive."""
    forms = F.array(
        F.concat(noun, F.lit("s")),
        F.when(noun.rlike("(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es"))),
        F.when(noun.rlike("[^aeiou]y$"), F.regexp_replace(noun, "y$", "ies")),
        F.when(noun.rlike("[^f]f$|^f$"), F.regexp_replace(noun, "f$", "ves")),
        F.when(noun.rlike("fe$"), F.regexp_replace(noun, "fe$", "ves")),
    )
    return F.array_compact(forms)


# Scripts -------------------------------------------------------------------------------

PROSE_TOKEN = r"[\p{L}\p{Nd}_]+(?:[-'’][\p{L}\p{Nd}_]+)*"
#: The same for Java, whose stack a token of thousands of parts would otherwise fill.
TOKEN = r"[\p{L}\p{Nd}_]++(?:[-'’][\p{L}\p{Nd}_]++)*+"


def script_letters(text: Column, script: str) -> Column:
    """How many letters of ``Latin`` (A to Z) or ``Cyrillic`` script."""
    pattern = {"Latin": "[^A-Za-z]+", "Cyrillic": r"[^\p{IsCyrillic}]+"}[script]
    return F.length(F.regexp_replace(text, pattern, ""))


def language(text: Column) -> Column:
    """``en`` if Latin letters outnumber Cyrillic ones, else ``ru``."""
    return F.when(script_letters(text, "Latin") > script_letters(text, "Cyrillic"), "en").otherwise("ru")


def normalised(text: Column) -> Column:
    return F.translate(F.lower(text), "ё", "е")


def number_forms(number: Column) -> Column:
    """Spellings of an English number that count as the same: comma or point, and thousands with or without a mark."""
    head, tail = F.regexp_extract(number, r"^(\d+)[.,]", 1), F.regexp_extract(number, r"[.,](\d+)$", 1)
    either = F.array(number, F.concat(head, F.lit(","), tail), F.concat(head, F.lit("."), tail))
    thousands = F.array(F.concat(head, tail), F.concat(head, F.lit(" "), tail), F.concat(head, F.lit("\u00a0"), tail))
    several = F.when(number.rlike(r"^\d+,\d{3}$"), F.concat(either, thousands)).otherwise(either)
    return F.array_distinct(F.when(number.rlike(r"^\d+[.,]\d+$"), several).otherwise(F.array(number)))


# Code-like tokens ----------------------------------------------------------------------

#: File name endings and grammar suffixes.
FILE_ENDINGS = (
    "go|mod|sum|py|ts|tsx|js|jsx|mjs|cjs|json|ya?ml|toml|ini|cfg|conf|env|md|txt|csv|sql|sh|bash|zsh|rs|java|kt|rb|php|c|h|cc|cpp|hpp|"
    "proto|html|css|xml|lock|log|tf"
)
SUFFIX_MENTIONS = "-ing -ed -er -est -ly -s -es -ies".split()
LABEL_WORDS = "WARNING CAUTION NOTE DANGER NOTICE".split()


#: A chunk may be code-like, as no word with punctuation behind it is.
MAYBE_CODE = r"(?![A-Z]?[a-z]+[.,;:!?]*(?![^\s\x0B\x{85}\p{Z}]))[^\s\x0B\x{85}\p{Z}]*?[._/:(A-Z-]"


def core_of(chunk: Column) -> Column:
    """A chunk without the punctuation around it and a possessive; the closing parenthesis of a call stays."""
    front = F.regexp_replace(chunk, "^[(\"'“‘<\\[{]+", "")
    closed = r"^(.*\([^()]*\))[.,;:!?)\]}\"'>”’]*$"
    core = let(front, lambda x: F.when(x.contains("("), F.regexp_replace(x, closed, "$1")).otherwise(x))
    core = let(core, lambda x: F.when(x.rlike(r"\([^()]*\)$"), x).otherwise(F.regexp_replace(x, "[.,;:!?)\\]}\"'>”’]+$", "")))
    return F.regexp_replace(core, "(?<=.)['’]s$", "")


def code_kind(core: Column) -> Column:
    """flag, url, path, file, dotted, snake_case, mixed_case, call, acronym, or ''."""
    return let(core, lambda c: let(F.regexp_replace(c, r"\(\)$", ""), lambda b: _kind(c, b)))


def _kind(core: Column, base: Column) -> Column:
    slash = core.contains("/") & core.rlike(r"^[A-Za-z0-9_.~/@:+-]+$")
    slash &= core.rlike(r"^.+\.") | core.rlike(r"^(/|\.|~/)") | core.endswith("/")
    short = base.rlike(r"(^|\.)[A-Za-z0-9_](\.|$)") & ~base.rlike(r"[A-Za-z0-9_]{3}") & (base == core)
    return (
        F.when(core.rlike("^[A-Z]?[a-z]+$") | (F.octet_length(core) < 2) | ~core.rlike(r"\p{L}"), "")
        .when(core.rlike(r"^--?[A-Za-z][A-Za-z0-9_-]*(=\S*)?$") & ~core.isin(SUFFIX_MENTIONS), "flag")
        .when(core.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$"), "url")
        .when(core.rlike(r"^[A-Za-z0-9_./~-]*\.[A-Za-z0-9]+(:[0-9]+)+$"), "path")
        .when(slash, "path")
        .when(core.rlike(rf"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*\.({FILE_ENDINGS})$") | core.rlike(r"^\.[A-Za-z][A-Za-z0-9_.-]*$"), "file")
        .when(base.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+$"), F.when(short, "").otherwise("dotted"))
        .when(base.contains("_") & base.rlike("^_*[A-Za-z0-9]+(_+[A-Za-z0-9]+)*_*$"), "snake_case")
        .when(base.rlike("^[A-Za-z][A-Za-z0-9]*$") & base.rlike("[a-z]") & base.rlike("^.[A-Za-z0-9]*[A-Z]"), "mixed_case")
        .when((base != core) & base.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "call")
        .when(core.rlike("^[A-Z][A-Z0-9]{1,5}$") & ~core.isin(LABEL_WORDS), "acronym")
        .otherwise("")
    )
