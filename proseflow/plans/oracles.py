"""DuckDB twins of the queries: RE2 without look-around, rows and windows where Spark has arrays."""

from __future__ import annotations

from proseflow.functions import text as T
from proseflow.operators import dictionary as D
from proseflow.operators import fidelity as FI
from proseflow.operators import glossary as G
from proseflow.operators import lexicon_ru as L
from proseflow.operators import rules_en as E
from proseflow.operators import rules_ru
from proseflow.operators import segments as S
from proseflow.sources import tables

WORD = r"[\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def array_of(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def deinflect() -> str:
    return "(VALUES " + ", ".join(f"({k}, {q(a)}, {q(b)})" for k, (a, b) in enumerate(D.DEINFLECT, 1)) + ") AS v(k, suf, rep)"


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"


def every(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {q(pattern)})"


def trim(text: str) -> str:
    return sub(text, rf"^{T.WS}+|{T.WS}+$")


ENGLISH = f"SELECT * FROM ({tables.corpus_sql(tables.ENGLISH)})"
RUSSIAN = f"SELECT * FROM ({tables.corpus_sql(tables.RUSSIAN)})"
PAIRS = f"SELECT * FROM ({tables.pairs_sql()})"
DOCUMENTS = "SELECT doc_id, text FROM documents"


_LF_TEXT = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def upper(w: str) -> str:
    return f"({rx(w, '[[:upper:]]|' + chr(92) + 'p{Lu}')} AND NOT {rx(w, r'[\p{Ll}\p{Lt}]')})"


def heading(line: str) -> str:
    bad = r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"
    return f"({rx(line, T.HEADING)} OR (len({every(line, T.NOT_WS + '+')}) <= 8 AND NOT {rx(trim(line), bad)} AND NOT ends_with({trim(line)}, '.')))"


def plain(docs: str) -> str:
    """Line breaks and code settled: bare fences and spans of one backtick only."""
    text = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    text = sub(text, r"(?ms)^[ \t]*```[^`\n]*\n.*?^[ \t]*```[ \t]*$")
    return f"SELECT doc_id, {sub(text, '`[^`' + chr(92) + 'n]+`', 'CODESPAN')} AS text FROM ({docs})"


def paragraph_ctes(docs: str) -> str:
    return f"""
WITH docs AS ({plain(docs)}),
lines AS (SELECT doc_id, i AS n, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs), unnest(range(1, len(ls) + 1)) AS t(i)),
marked AS (SELECT *, sum(CASE WHEN {rx('line', T.NOT_WS)} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM lines),
blocks AS (SELECT doc_id, g, count(*) AS n_lines, list(line ORDER BY n) AS ls, count(*) FILTER ({rx('line', T.LIST_MARKER)}) AS n_list
           FROM marked WHERE {rx('line', T.NOT_WS)} GROUP BY doc_id, g),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS para, n_lines, ls,
                 n_lines = 1 AND {heading('ls[1]')} AS is_heading, n_list >= greatest(1, n_lines // 2) AS listy FROM blocks)"""


def protected(text: str) -> str:
    for a in T.ABBREVIATIONS:
        text = sub(text, rf"(^|[^\pL\pN_]){T.escaped(a)}", "\\1" + a.replace(".", "<DOT>"))
    return text


def sentence_ctes(docs: str) -> str:
    split = sub(protected("u"), rf"([.!?:]){T.WS}+([\"“(]?[A-Z0-9])", "\\1\x01\\2")
    return paragraph_ctes(docs) + f""",
units AS (SELECT doc_id, para, k, ls[k] AS u FROM paras, unnest(range(1, len(ls) + 1)) AS t(k) WHERE NOT is_heading AND listy
          UNION ALL SELECT doc_id, para, 1, array_to_string(list_transform(ls, lambda x: {trim('x')}), ' ') FROM paras WHERE NOT is_heading AND NOT listy),
cut AS (SELECT doc_id, para, k, string_split({split}, chr(1)) AS ss FROM units),
pieces AS (SELECT doc_id, para, k, j, {trim("replace(ss[j], '<DOT>', '.')")} AS text FROM cut, unnest(range(1, len(ss) + 1)) AS t(j)),
sents AS (SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY para, k, j) AS sent, text FROM pieces WHERE text <> '')"""


def words(text: str) -> str:
    clean = sub(sub(trim(text), T.LIST_MARKER), T.LABEL)
    ascii_ = sub(sub(clean, r"[^\x00-\x7F\P{L}]", "a"), r"[^\x00-\x7F\P{N}]", "a")
    return f"len(list_filter({every(ascii_, T.WORD_UNIT)}, lambda u: {rx('u', '[A-Za-z0-9_]')}))"


def core(chunk: str) -> str:
    front = f"regexp_replace({chunk}, {q('^[(' + chr(34) + chr(39) + '“‘<' + chr(92) + '[{]+')}, '')"
    tail = "[.,;:!?)\\]}\"'>”’]"
    call = f"regexp_extract({front}, {q(r'^(.*\([^()]*\))' + tail + '*$')}, 1)"
    bare = sub(front, tail + "+$")
    return f"regexp_replace(CASE WHEN {call} <> '' THEN {call} ELSE {bare} END, {q('(.)[' + chr(39) + '’]s$')}, {q(chr(92) + '1')})"


def kind(c: str) -> str:
    b = f"regexp_replace({c}, '\\(\\)$', '')"
    slash = f"contains({c}, '/') AND {rx(c, r'^[A-Za-z0-9_.~/@:+-]+$')} AND ({rx(c, r'^.+\.')} OR {rx(c, r'^(/|\.|~/)')} OR ends_with({c}, '/'))"
    short = f"{rx(b, r'(^|\.)[A-Za-z0-9_](\.|$)')} AND NOT {rx(b, '[A-Za-z0-9_]{3}')} AND {b} = {c}"
    return f"""CASE WHEN strlen({c}) < 2 OR NOT {rx(c, r'\p{L}')} THEN ''
 WHEN {rx(c, r'^--?[A-Za-z][A-Za-z0-9_-]*(=\S*)?$')} AND {c} NOT IN {listed(T.SUFFIX_MENTIONS)} THEN 'flag'
 WHEN {rx(c, r'^[A-Za-z][A-Za-z0-9+.-]*://\S+$')} THEN 'url'
 WHEN {rx(c, r'^[A-Za-z0-9_./~-]*\.[A-Za-z0-9]+(:[0-9]+)+$')} THEN 'path'
 WHEN {slash} THEN 'path'
 WHEN {rx(c, rf'^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*\.({T.FILE_ENDINGS})$')} OR {rx(c, r'^\.[A-Za-z][A-Za-z0-9_.-]*$')} THEN 'file'
 WHEN {rx(b, r'^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+$')} THEN CASE WHEN {short} THEN '' ELSE 'dotted' END
 WHEN contains({b}, '_') AND {rx(b, '^_*[A-Za-z0-9]+(_+[A-Za-z0-9]+)*_*$')} THEN 'snake_case'
 WHEN {rx(b, '^[A-Za-z][A-Za-z0-9]*$')} AND {rx(b, '[a-z]')} AND {rx(b, '^.[A-Za-z0-9]*[A-Z]')} THEN 'mixed_case'
 WHEN {b} <> {c} AND {rx(b, '^[A-Za-z_][A-Za-z0-9_]*$')} THEN 'call'
 WHEN {rx(c, '^[A-Z][A-Z0-9]{1,5}$')} AND {c} NOT IN {listed(T.LABEL_WORDS)} THEN 'acronym' ELSE '' END"""


def chunk_ctes(docs: str) -> str:
    return sentence_ctes(docs) + f""",
chunks AS (SELECT doc_id, para, sent, i, cs[i] AS chunk FROM (SELECT doc_id, para, sent, {every("replace(text, '’', '''')", f"{T.NOT_WS}+|{T.WS}+")} AS cs FROM sents), unnest(range(1, len(cs) + 1)) AS t(i)),
cores AS (SELECT *, {core('chunk')} AS core FROM chunks),
kinds AS (SELECT *, {kind('core')} AS kind FROM cores),
masked AS (SELECT doc_id, para, sent, string_agg(CASE WHEN kind IN ('', 'acronym') THEN chunk ELSE replace(chunk, core, 'GLOSSARYAUTO') END, '' ORDER BY i) AS text
           FROM kinds GROUP BY doc_id, para, sent)"""


def shouted(text: str) -> str:
    ws = f"list_filter({every(text, r'\p{L}+')}, lambda w: strlen(w) >= 2)"
    return f"(len({ws}) >= 3 AND 2 * len(list_filter({ws}, lambda w: {upper('w')})) > len({ws}))"


def token_ctes(docs: str) -> str:
    work = sub(sub("text", r"\([^()]*\)", " "), '"[^"]+"|“[^”]+”', " ")
    work = sub(sub(work, T.LIST_MARKER), T.LABEL)
    for p in S.PHRASES:
        work = sub(work, rf"(?i)(^|[^\p{{L}}\p{{N}}_]){p}($|[^\p{{L}}\p{{N}}_])", "\\1" + p.replace(" ", "_") + "\\2")
    return chunk_ctes(docs) + f""",
raw AS (SELECT doc_id, sent, i, ts[i] AS tok FROM (SELECT doc_id, sent, {every(work, r"[A-Za-z][A-Za-z'\-_]*")} AS ts FROM masked), unnest(range(1, len(ts) + 1)) AS t(i)),
bare AS (SELECT *, split_part(tok, '''', 1) AS b FROM raw WHERE NOT (contains(tok, '''') AND (ends_with(lower(tok), 'n''t') OR lower(tok) IN {listed(T.CONTRACTIONS)}))),
flagged AS (SELECT *, b = 'GLOSSARYAUTO' AS auto, {upper('b')} AS up FROM bare),
toks AS (SELECT doc_id, sent, row_number() OVER (PARTITION BY doc_id, sent ORDER BY i) AS ord, CASE WHEN auto THEN '<code>' ELSE lower(b) END AS tok,
                auto OR (i > 1 AND {rx('b', '^[A-Z]')} AND NOT up AND NOT contains(b, '_')) AS opaque
         FROM flagged WHERE auto OR NOT (up AND length(b) > 1)),
near AS (SELECT *, coalesce(replace(lag(tok) OVER w, '_', ' '), '') AS prev, lead(tok) OVER w AS nxt, lead(opaque) OVER w AS nxt_opaque
         FROM toks WINDOW w AS (PARTITION BY doc_id, sent ORDER BY ord))"""


def judged_ctes(docs: str) -> str:
    """Tokens with what the seed dictionary says of them: candidates of de-inflection meet its words by a join."""
    own = D.seed()
    has = lambda x, name: f"{x} IN {listed(own.sets[name])}"
    return token_ctes(docs) + f""",
shaped AS (SELECT *, NOT opaque AND contains(tok, '_') AS phrase, NOT opaque AND (length(tok) < 2 OR tok IN ('been', 'being')) AS still,
                  NOT opaque AND tok IN {listed(E.NUMBER_WORDS)} AS number FROM near),
plain AS (SELECT *, NOT opaque AND NOT phrase AND NOT still AND NOT number AS plain FROM shaped),
tries AS (SELECT tok, 0 AS step, tok AS form FROM (SELECT DISTINCT tok FROM plain WHERE plain) UNION ALL
          SELECT tok, k, left(tok, length(tok) - length(suf)) || rep FROM (SELECT DISTINCT tok FROM plain WHERE plain), {deinflect()} WHERE ends_with(tok, suf) AND length(tok) > length(suf) + 2),
hits AS (SELECT tok, step, form, {has('form', 'forms')} AS good FROM tries WHERE {has('form', 'forms')} OR {has('form', 'banned')} QUALIFY row_number() OVER (PARTITION BY tok ORDER BY step) = 1),
looked AS (SELECT p.*, CASE WHEN h.form IS NULL THEN 'unknown' WHEN NOT good THEN 'non_approved' WHEN step = 0 THEN 'approved' ELSE 'approved-inflected' END AS kind0, coalesce(h.form, p.tok) AS hit
           FROM plain p LEFT JOIN hits h ON h.tok = p.tok AND p.plain),
excused AS (SELECT *, plain AND kind0 = 'non_approved' AND prev IN {listed(E.DETERMINERS)} AND {has('hit', 'all_verb')} AS noun,
                   plain AND kind0 = 'non_approved' AND prev NOT IN {listed(E.DETERMINERS)} AND ord > 1 AND prev NOT IN {listed(D.VERB_SLOT)} AND {has('hit', 'all_verb')}
                   AND NOT {has('hit', 'looks_verb')} AND ({has('hit', 'nounish')} OR NOT {has('prev', 'functions')}) AS maybe FROM looked),
judged AS (SELECT *, CASE WHEN noun THEN CASE WHEN {has('hit', 'nounish')} THEN 'approved' ELSE 'unknown' END ELSE kind0 END AS kind FROM excused),
ended AS (SELECT *, plain AND ({has('hit', 'function_bases')} OR {has('hit', 'verb_bases')} OR (kind = 'non_approved' AND {has('hit', 'all_verb')} AND NOT maybe)
                 OR (ends_with(tok, 'ly') AND length(tok) > 3 AND NOT {has('tok', 'no_adverbs')})) AS ends FROM judged),
runs AS (SELECT *, CASE WHEN phrase THEN 2 WHEN ends THEN 1 ELSE 0 END AS brk,
                coalesce(sum(CASE WHEN phrase OR ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ended WHERE NOT still),
clusters AS (SELECT doc_id, sent, coalesce(max(ord) FILTER (brk = 1), 1000000) AS ord, string_agg(tok, ' ' ORDER BY ord) FILTER (brk = 0) AS match FROM runs GROUP BY doc_id, sent, g
             HAVING count(*) FILTER (brk = 0) >= 4 AND max(brk) < 2)"""


_ING = f"(ends_with(tok, 'ing') AND tok NOT IN {listed(T.APPROVED_ING)} AND NOT ends_with(tok, 'thing') AND {rx('tok', '[aeiouy].*ing$')})"
_PART = f"(ends_with(tok, 'ed') OR tok IN {listed(E.PARTICIPLES)})"


def token_findings() -> str:
    """Findings of judged tokens, with the order of those of one token."""
    own = D.seed()
    after = f"(nxt IS NULL OR (NOT nxt_opaque AND nxt IN {listed(sorted({*own.sets['functions'], *own.sets['verbs'], *E.BE}))}))"
    return f"""SELECT doc_id, sent, ord, 0 AS sub, '3.4' AS rule, 'tense' AS kind, tok AS match FROM ended WHERE NOT opaque AND tok IN ('been', 'being')
UNION ALL SELECT doc_id, sent, ord, 1, CASE WHEN prev IN {listed(E.DETERMINERS)} OR NOT {after} THEN '3.5?' ELSE '3.5' END, 'ing', tok FROM ended WHERE plain AND {_ING}
UNION ALL SELECT doc_id, sent, ord, 2, '3.4', 'tense', prev || ' ' || tok FROM ended WHERE plain AND prev IN {listed(E.HAVE)} AND {_PART} AND tok <> 'need'
UNION ALL SELECT doc_id, sent, ord, 3, CASE WHEN nxt = 'by' AND NOT nxt_opaque THEN '3.6' ELSE '3.6?' END, 'passive', prev || ' ' || tok FROM ended WHERE plain AND prev IN {listed(E.BE)} AND {_PART}
UNION ALL SELECT doc_id, sent, ord, 4, '2.1', 'noun-cluster', match FROM clusters"""


def finding_en_ctes(docs: str) -> str:
    """All findings with the seed dictionary: ``every(doc_id, para, sent, seq, rule, kind, match)``."""
    verbs = D.seed().sets["verbs"]
    plain_text = f"replace(text, '’', {q(chr(39))})"
    apostrophe = every(plain_text, r"[\pL\pN_]+'(?i:t|s|re|ve|ll|d|m)\b")
    first = lambda words, tail: first_bounded("text", words, tail)
    possessive = q("'s")
    return judged_ctes(docs) + f""",
whole AS (SELECT doc_id, para, sent, text, {mode('text', verbs)} AS mode, {words('text')} AS n FROM masked),
shorts AS (SELECT doc_id, sent, i, ms[i] AS m FROM (SELECT doc_id, sent, {apostrophe} AS ms FROM masked), unnest(range(1, len(ms) + 1)) AS u(i)),
marks AS (SELECT doc_id, sent, 0 AS stage, 0 AS ord, 0 AS sub, CASE mode WHEN 'procedural' THEN '5.1' ELSE '6.3' END AS rule, 'length' AS kind, CAST(n AS VARCHAR) AS match
          FROM whole WHERE n > CASE mode WHEN 'procedural' THEN {E.LIMITS['procedural']} ELSE {E.LIMITS['descriptive']} END
  UNION ALL SELECT doc_id, sent, 1, 0, 0, '8.1', 'punctuation', ';' FROM whole WHERE contains(text, ';')
  UNION ALL SELECT doc_id, sent, 2, i, 0, '4.2', 'contraction', m FROM shorts WHERE NOT ends_with(lower(m), {possessive}) OR lower(m) IN {listed(T.CONTRACTIONS)}
  UNION ALL SELECT doc_id, sent, 3, 0, 0, 'GR-6', 'latin', {first(T.LATIN, False)} FROM whole WHERE {first(T.LATIN, False)} <> ''
  UNION ALL SELECT doc_id, sent, 4, 0, 0, 'GR-7', 'pronoun', {first(T.PRONOUNS, True)} FROM whole WHERE {first(T.PRONOUNS, True)} <> ''
  UNION ALL SELECT doc_id, sent, 5, ord, sub, rule, kind, match FROM ({token_findings()})),
every AS (SELECT m.doc_id, s.para, m.sent, row_number() OVER (PARTITION BY m.doc_id, m.sent ORDER BY stage, ord, sub) AS seq, rule, kind, match FROM marks m JOIN sents s ON s.doc_id = m.doc_id AND s.sent = m.sent
  UNION ALL SELECT doc_id, para, 0, 0, '6.6', 'paragraph', CAST(k AS VARCHAR) FROM (SELECT s.doc_id, s.para, count(*) AS k FROM sents s JOIN paras p ON p.doc_id = s.doc_id AND p.para = s.para WHERE NOT listy GROUP BY s.doc_id, s.para) WHERE k > {E.PARAGRAPH_LIMIT})"""


def bases() -> str:
    """``base, alts, pos, hint`` of the seed dictionary as DuckDB values."""
    own, rows = D.seed(), []
    for w in {*own.banned, *D.HEDGE_HINTS}:
        es = own.banned.get(w, [])
        hint = q(D.HEDGE_HINTS[w]) if w in D.HEDGE_HINTS else "NULL"
        rows.append(f"({q(w)}, {q('; '.join(', '.join(e['use_instead']) for e in es))}, {q('/'.join(e['pos'] for e in es))}, {hint})")
    return "(VALUES " + ", ".join(sorted(rows)) + ") AS b(base, alts, pos, hint)"


def first_bounded(text: str, alternatives: list[str], tail: bool) -> str:
    after = "($|[^\\p{L}\\p{N}_])" if tail else ""
    return f"regexp_extract({text}, {q('(?i)(?:^|[^\\p{L}\\p{N}_])(' + '|'.join(map(T.escaped, alternatives)) + ')' + after)}, 1)"


def masked(docs: str, column: str = "text", key: str = "doc_id") -> str:
    """CTEs ``ls`` and ``prose_lines(key, n, raw, line)``: lines with code and addresses blank, every character in its place.

    A line is in a fence if it is one or an odd number of fences stand before it; spans have one
    backtick, so every second piece between backticks of a line is code.
    """
    fence = rx("raw", r"^\s*```")
    parts = "string_split(raw, '`')"
    span = f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 AND i < len({parts}) THEN repeat(' ', CAST(length(p) + 2 AS BIGINT)) ELSE p END), '')"
    http = r"https?://[^\s)>\]]+"
    address = "array_to_string(list_transform(" + every("span", http + "|h|[^h]+") + f", lambda p: CASE WHEN {rx('p', '^' + http)} THEN repeat(' ', CAST(length(p) AS BIGINT)) ELSE p END), '')"
    return f"""raw_lines AS (SELECT {key}, n, xs[n] AS raw FROM (SELECT {key}, string_split({column}, chr(10)) AS xs FROM ({docs})), unnest(range(1, len(xs) + 1)) AS t(n)),
fenced AS (SELECT *, {fence} AS is_fence, coalesce(sum(CASE WHEN {fence} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM raw_lines),
spanned AS (SELECT *, CASE WHEN is_fence OR before % 2 = 1 THEN repeat(' ', CAST(length(raw) AS BIGINT)) WHEN contains(raw, '`') THEN {span} ELSE raw END AS span FROM fenced),
prose_lines AS (SELECT {key}, n, raw, CASE WHEN contains(span, '://') THEN {address} ELSE span END AS line FROM spanned)"""


def prose(text: str) -> str:
    """A text for one that has no need of places: fences gone, a span one character, an address a space."""
    return sub(sub(sub(text, r"(?ms)^[ \t]*```[^\n]*\n.*?^[ \t]*```[^\n]*$"), "`[^`\n]+`", rules_ru.SPAN), r"https?://[^\s)>\]]+", " ")


def russian_ctes(docs: str) -> str:
    ends = sub("line", r"([.!?…][.!?…»\")*]*)\s+([^\p{Ll}\s])", "\\1\x01\\2")
    return f"""
WITH docs AS (SELECT doc_id, {prose('text')} AS text FROM ({docs})),
lines AS (SELECT doc_id, i AS n, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs), unnest(range(1, len(ls) + 1)) AS t(i)),
pieces AS (SELECT doc_id, n, j, {sub('ss[j]', r'^\s+|\s+$')} AS text FROM (SELECT doc_id, n, string_split({ends}, chr(1)) AS ss FROM lines), unnest(range(1, len(ss) + 1)) AS t(j)),
sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, j) AS sent, text FROM pieces WHERE {rx('text', r'[\p{L}\p{Nd}_]')})"""


_ENDS = "(VALUES " + ", ".join(f"({q(c)}, {q(e)})" for c, e in [("n", e) for e in L.NOUN_ENDINGS] + [("v", e) for e in L.verb_endings()] + [(" ", "")]) + ")"


def values(rows: list[dict], column: str = "term") -> str:
    """Patterns of single words as DuckDB values: row_id, head (prefix and stem), class."""
    cell = lambda r: r[column] if column == "term" else L.russian_cell(r[column])
    out = [(i, p + w["stem"], c) for i, r in enumerate(rows) for phrase in L.parse_term(cell(r)) if len(phrase) == 1 for w in phrase for p in w["prefixes"] for c in w["classes"] or " "]
    return "(VALUES " + ", ".join(f"({i}, {q(h)}, {q(c)})" for i, h, c in out) + ")"


def match_sql(rows: list[dict], column: str = "term") -> str:
    """Distinct words split into head and tail wherever possible: another algorithm than expansion."""
    return f"SELECT DISTINCT w.word, p.row_id FROM splits w JOIN {values(rows, column)} AS p(row_id, head, class) ON w.head = p.head JOIN ends e ON e.class = p.class AND e.ending = w.tail"


_LOANS = [i for i, r in enumerate(L.SEED["ru-allowed"]) if r["class"] in ("loanword", "latin")]
_GLUED = [i for i, r in enumerate(L.SEED["ru-allowed"]) if r["class"] in ("loanword", "glued")]


def word_ctes(sents: str) -> str:
    """From ``sents(doc_id, sent, text)``: tokens, their candidates, and which words the seed's tables have."""
    return f"""{sents},
ends AS (SELECT * FROM {_ENDS} AS e(class, ending)),
t AS (SELECT doc_id, sent, i - 1 AS ord, ts[i] AS tok FROM (SELECT doc_id, sent, {every('text', T.PROSE_TOKEN)} AS ts FROM sents), unnest(range(1, len(ts) + 1)) AS u(i)),
parts AS (SELECT *, regexp_split_to_array(tok, '[-''’]') AS ps FROM t),
cands AS (SELECT doc_id, sent, ord, 0 AS cand, tok AS raw FROM parts UNION ALL SELECT doc_id, sent, ord, i, ps[i] FROM parts, unnest(range(1, len(ps) + 1)) AS u(i) WHERE len(ps) > 1),
words AS (SELECT *, replace(lower(raw), 'ё', 'е') AS word FROM cands),
splits AS (SELECT word, left(word, n) AS head, substr(word, n + 1) AS tail FROM (SELECT DISTINCT word FROM words), unnest(range(1, length(word) + 1)) AS u(n)),
allowed AS ({match_sql(L.SEED['ru-allowed'])}), banned AS ({match_sql(L.SEED['ru-non-approved'])}),
left_over AS (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM words v JOIN allowed a ON a.word = v.word WHERE v.cand = 0 AND v.doc_id = w.doc_id AND v.sent = w.sent AND v.ord = w.ord)
              AND NOT (cand > 0 AND word IN (SELECT word FROM allowed WHERE row_id IN ({', '.join(map(str, _LOANS))})))),
lexicon AS (SELECT doc_id, sent, ord, row_id, arg_min(l.word, cand) AS match FROM left_over l JOIN banned b ON b.word = l.word GROUP BY ALL)"""


_W = "[" + r"\p{L}\p{Nd}_" + "]"


def finding_ctes(docs: str) -> str:
    """All findings of a text by itself with the seed: ``found(doc_id, rule, hard)``."""
    low = "replace(lower(text), 'ё', 'е')"
    cue = lambda cell: rf"(^|[^\p{{L}}\p{{Nd}}_])(" + "|".join(c.strip() for c in cell.split(",")) + ")"
    row = L.SEED["ru-domain"][0]  # the seed's only row; its words are those of row 2 of the banned table
    conj = (
        "list_count(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN (ps[i] IN ('а', 'но') OR (ps[i] = 'при' AND ps[i + 2] = 'этом'))"
        f" AND NOT coalesce({rx('ps[i - 1]', '[,;—–]' + chr(92) + 's*$')}, false) THEN 1 END))"
    )
    phrase = (
        "list_count(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN "
        + rx("replace(lower(ps[i]), 'ё', 'е')", "^код(" + "|".join(L.NOUN_ENDINGS) + ")$") + " AND " + rx("ps[i + 1]", "^[ \t]+$") + " AND "
        + rx("replace(lower(ps[i + 2]), 'ё', 'е')", "^написан(" + "|".join(L.NOUN_ENDINGS) + ")$") + " THEN 1 END))"
    )
    fine = rf"(len(list_filter(ps, lambda p: NOT (length(p) = 1 OR {rx('p', r'^(\p{Nd}+|[A-Za-z]{1,2}[0-9]+)$')} OR lower(p) IN {listed(sorted(rules_ru.ALLOWED | {'api'}))}))) = 0)"
    glued = f"{rx('tok', '[A-Za-z]')} AND {rx('tok', chr(92) + 'p{Cyrillic}')} AND NOT (starts_with(lower(tok), 'не-') AND NOT {rx('substr(tok, 4)', chr(92) + 'p{Cyrillic}')})"
    return f"""{word_ctes(russian_ctes(docs))},
cover AS (SELECT doc_id, sent, text, {every('text', T.PROSE_TOKEN + '|[^' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}_]+')} AS ps FROM sents),
breaks AS (SELECT doc_id, sent, len({every('text', '[,;]')}) + len({every('text', chr(92) + 's[—–]' + chr(92) + 's')}) + {conj} AS n FROM cover),
phrases AS (SELECT doc_id, sent, {phrase} AS n FROM cover),
in_domain AS (SELECT DISTINCT doc_id FROM ({docs}) WHERE {rx(low, cue(row['domain_cues']))}),
slang AS (SELECT doc_id, sent FROM sents WHERE {rx(low, cue(row['slang_cues']))}),
lex AS (SELECT l.*, row_id = 2 AND d.doc_id IS NOT NULL AND s.doc_id IS NULL AS soft FROM lexicon l LEFT JOIN in_domain d ON d.doc_id = l.doc_id LEFT JOIN slang s ON s.doc_id = l.doc_id AND s.sent = l.sent),
glued AS (SELECT doc_id, sent, tok FROM parts WHERE {glued} AND replace(lower(tok), 'ё', 'е') NOT IN (SELECT word FROM allowed WHERE row_id IN ({', '.join(map(str, _GLUED))}))),
latin AS (SELECT doc_id, sent, tok FROM parts p WHERE {rx('tok', '[A-Za-z]')} AND NOT {rx('tok', chr(92) + 'p{Cyrillic}')} AND NOT {fine} AND lower(tok) NOT IN {listed(sorted(rules_ru.ALLOWED | {'api'}))}
          AND NOT EXISTS (SELECT 1 FROM lex l WHERE l.doc_id = p.doc_id AND l.sent = p.sent AND l.ord = p.ord)),
long AS (SELECT doc_id, sent FROM sents WHERE len({every('text', T.PROSE_TOKEN)}) + length({sub('text', f'[^{rules_ru.SPAN}]')}) > {rules_ru.SENTENCE_LIMIT}),
found AS (SELECT doc_id, CASE WHEN soft THEN 'domain' ELSE 'lexicon' END AS rule, NOT soft AS hard FROM lex
  UNION ALL SELECT doc_id, 'lexicon', true FROM phrases, unnest(range(n)) AS u(k) UNION ALL SELECT doc_id, 'glued', true FROM glued
  UNION ALL SELECT doc_id, 'latin-prose', false FROM latin UNION ALL SELECT doc_id, 'length', false FROM long UNION ALL SELECT doc_id, 'facts', false FROM breaks WHERE n > {rules_ru.CLAUSE_LIMIT})"""


def never_ctes() -> str:
    """What the bilingual seed rules out in targets: ``violations(pair_id, row_id, match)``."""
    demand = [f"{rx('src', '(?i)(^|[^a-z0-9_])(' + p + ')($|[^a-z0-9_])')}" for p in ("log", "deploy[a-z0-9_]*", "wait [0-9]+ ms")]
    wanted = " UNION ALL ".join(f"SELECT pair_id AS doc_id, {i} AS row_id FROM sources WHERE {d}" for i, d in enumerate(demand))
    sents = f"WITH sources AS (SELECT pair_id, {prose('src_text')} AS src, {prose('out_text')} AS out FROM ({PAIRS})), sents AS (SELECT pair_id AS doc_id, 1 AS sent, out AS text FROM sources)"
    return f"""{word_ctes(sents)},
wanted AS ({wanted}), never AS ({match_sql(G.BILINGUAL, 'never')}),
skipped AS (SELECT DISTINCT doc_id, ord FROM words w JOIN allowed a ON a.word = w.word WHERE cand = 0),
hits AS (SELECT w.doc_id, w.ord, n.row_id, w.cand, w.word FROM words w JOIN never n ON n.word = w.word JOIN wanted x ON x.doc_id = w.doc_id AND x.row_id = n.row_id
         WHERE NOT EXISTS (SELECT 1 FROM skipped s WHERE s.doc_id = w.doc_id AND s.ord = w.ord)),
violations AS (SELECT doc_id AS pair_id, row_id, word AS match FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY row_id, cand, word) = 1)"""


def hedge_sql() -> str:
    """Strengths lost by a rewrite, or certainty added, with the small table of hedges."""
    words = lambda text: every(f"replace(lower({text}), 'ё', 'е')", _W + "+")
    out = []
    for strength, (english, russian) in FI.HEDGES.items():
        count = lambda text, ws: f"len(list_filter({words(text)}, lambda x: x IN {listed([w.replace('ё', 'е') for w in ws])}))"
        a, b = count("src", english), count("out", russian)
        out.append(f"SELECT pair_id, {q(strength)} AS match FROM p WHERE {b} {'>' if strength == 'certain' else '<'} {a}")
    return f"WITH p AS (SELECT pair_id, {prose('src_text')} AS src, {prose('out_text')} AS out FROM ({PAIRS})) " + " UNION ALL ".join(out)


def path_sql() -> str:
    last = "list_extract(string_split(match, '/'), -1)"
    return f"""WITH p AS (SELECT * FROM ({PAIRS})),
s AS (SELECT DISTINCT pair_id, src_text, out_text, {sub('m', r'[.]+$')} AS match FROM (SELECT *, unnest({every(prose('src_text'), FI.PATH)}) AS m FROM p))
SELECT pair_id, match FROM s WHERE (starts_with(match, '/') OR starts_with(match, './') OR {rx(last, FI.FILE_NAME)}) AND {rx('match', '[A-Za-z]')}
  AND len(list_filter({every('src_text', FI.FILE_LINE)}, lambda x: contains(x, match))) = 0 AND NOT contains(out_text, match)"""


def mode(text: str, verbs: list[str]) -> str:
    first = sub(sub(text, T.LIST_MARKER), T.SAFETY_LABEL)
    head = f"lower(regexp_extract({first}, {q("[A-Za-z']+")}, 0))"
    after = f"lower(regexp_extract({first}, {q(f",{T.WS}*([A-Za-z']+)")}, 1))"
    return f"""CASE WHEN {rx(text, rf'(?i)^NOTE{T.WS}*:')} OR {head} = '' THEN 'descriptive'
 WHEN {head} IN {listed(E.CONDITION_HEADS)} AND {after} IN {listed(verbs)} THEN 'procedural'
 WHEN {head} IN {listed(E.IMPERATIVE_HEADS)} OR ({head} IN {listed(verbs)} AND {head} NOT IN ('it', 'this', 'there')) THEN 'procedural' ELSE 'descriptive' END"""
