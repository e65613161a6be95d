"""Overlaps against all pairs, places by character, labels, roll-ups, look-ups by join."""

import random

import pytest
from pyspark.sql import functions as F

from proseflow.operators import dictionary, intervals, rollups, rules_en

SPANS = "doc_id long, start int, end int, name string"


def spans(seed, n, docs=4, size=900, longest=60):
    rng = random.Random(seed)
    return [(rng.randrange(docs), a, a + rng.choice([0, 1, 5, longest, 7 * longest]), f"s{i}") for i in range(n) for a in [rng.randrange(size)]]


@pytest.mark.parametrize("width", [1, 16, 256, 10_000])
def test_overlaps(spark, width):
    left, right = spans(1, 80), [*spans(2, 70), (None, 0, 10, "x")]
    df, other = spark.createDataFrame([*left, (None, 0, 9, "y")], SPANS), spark.createDataFrame(right, SPANS)
    meet = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]
    got = sorted((r.name, r.r_name) for r in intervals.overlaps(df, other, ["doc_id"], width).collect())
    assert got == sorted((x[3], y[3]) for x in left for y in right if meet(x, y))
    alone = sorted(r.name for r in intervals.without_overlap(df, other, ["doc_id"], width).collect())
    assert alone == sorted([x[3] for x in left if not any(meet(x, y) for y in right)] + ["y"])
    scores = {r.doc_id: tuple(r)[1:] for r in intervals.span_scores(df.where("doc_id IS NOT NULL"), other.where("doc_id IS NOT NULL"), ["doc_id"], width).collect()}
    for d, got in scores.items():
        own, others = [x for x in left if x[0] == d], [y for y in right if y[0] == d]
        assert got == (len(own), sum(any(meet(x, y) for y in others) for x in own), len(others), sum(any(meet(x, y) for x in own) for y in others))


def test_places_by_character(spark):
    text = "ab\n\ncé d\nend"
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 1, 2, 1), (1, 3, 2, 1), (1, 4, 1, 3), (2, 1, 1, 0)], "doc_id long, line int, col int, width int")
    rows = {(r.doc_id, r.line): text[r.start : r.end] if r.doc_id == 1 else (r.start, r.end) for r in intervals.by_character(found, docs).collect()}
    assert rows == {(1, 1): "b", (1, 3): "é", (1, 4): "end", (2, 1): (0, 0)}


def test_occurrences(spark):
    docs = spark.createDataFrame([(1, "лог, логи; лог-лог лог"), (2, "лог")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "лог"), (1, "лог"), (1, "нет")], "doc_id long, item string")
    assert sorted((r.doc_id, r.start, r.end) for r in intervals.occurrences(docs, items).collect()) == [(1, 0, 3), (1, 11, 14), (1, 15, 18), (1, 19, 22)]


def test_rollups(spark):
    docs = spark.createDataFrame([(i, "x", [None, "en", "de"][i % 3], "s" + str(i % 2)) for i in range(600)], "doc_id long, text string, lang string, source string")
    found = docs.select("doc_id", F.explode(F.expr("sequence(0, doc_id % 5)")).alias("k")).selectExpr("doc_id", "concat('r', k % 2) AS rule", "concat('m', doc_id % 37) AS match")
    key = lambda r: (r.level, r.rule, r.lang, r.source)
    exact = {key(r): (r.n, r.n_docs, r.n_matches) for r in rollups.exact(found, docs).collect()}
    rows = [(r.doc_id, r.rule, r.match) for r in found.collect()]
    of = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    assert exact[7, None, None, None] == (len(rows), len({d for d, *_ in rows}), len({m for *_, m in rows}))
    null = [(d, r, m) for d, r, m in rows if of[d][0] is None and r == "r0"]
    assert exact[1, "r0", None, None] == (len(null), len({d for d, *_ in null}), len({m for *_, m in null}))
    sketched = {key(r): (r.n, r.n_docs, r.n_matches) for r in rollups.sketched(found, docs).collect()}
    assert sketched.keys() == exact.keys()
    for k, (n, d, m) in exact.items():
        assert sketched[k][0] == n
        assert abs(sketched[k][1] - d) <= 0.05 * d + 1 and abs(sketched[k][2] - m) <= 0.05 * m + 1


def test_lookups_by_join(spark):
    own = dictionary.Dictionary(
        [{"word": "remove", "pos": "v", "forms": "removes removed", "meaning": ["take away"], "examples": ["a", "b", "c"]}, {"word": "test", "pos": "n"}, {"word": "test", "pos": "v", "note": "also tests"}],
        [{"word": "test (out)", "pos": "v", "use_instead": ["TEST (n)"], "example": ["p", "q", "r", "s"], "incorrect_example": ["w", ""]}, {"word": "carry", "pos": "v", "example": ["1", "2", "3", "4"]}, {"word": "may", "pos": "v"}],
    )
    words = ["remove", "Removed", " tests ", "test", "test out", "test (out)", "carries", "carrying", "removing", "removings", "may", "might", "thing", "", "ies"]
    df = spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string")
    got = {r.word: r.lines for r in dictionary.lookup_entries(df, own).collect()}
    assert got == {w.strip().lower(): own.lookup_lines(w) for w in words}


def big(n):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    pos = ["n", "v", "adj", "prep"]
    return dictionary.Dictionary([{"word": word(), "pos": rng.choice(pos)} for _ in range(n)], [{"word": word(), "pos": rng.choice(pos), "use_instead": ["X (TN)"] * (rng.random() < 0.5)} for _ in range(n)])


def test_plan_does_not_grow_with_the_dictionary(spark):
    import time

    docs = spark.createDataFrame([(1, "He tests the unit. Remove it quickly.")], "doc_id long, text string")
    rules_en.findings(docs, own=big(3)).collect()
    plans, times = [], []
    for n in (10, 1000):
        own = big(n)
        start = time.perf_counter()
        found = rules_en.findings(docs, own=own)
        plan = found._jdf.queryExecution().optimizedPlan().treeString()
        times.append(time.perf_counter() - start)
        plans.append(len(plan))
    assert times[1] - times[0] < 2, times
    assert abs(plans[1] - plans[0]) < 200 + 0.02 * plans[0]


def test_entries_agree_with_taking_endings_off():
    own = big(300)
    kinds = dictionary.KIND_NAMES
    rng = random.Random(2)
    base = [*own.forms, *own.banned]
    words = {rng.choice(base)[: rng.choice([None, -1])] + rng.choice(["", "s", "es", "ies", "ed", "ing", "er", "est", "ly"]) for _ in range(4000)}
    for w in words:
        want = next(((k, w) for k, table in (("approved", own.forms), ("non_approved", own.banned)) if w in table), None)
        for suffix, instead in dictionary.DEINFLECT:
            stem = w[: len(w) - len(suffix)] + instead
            if want is None and w.endswith(suffix) and len(w) > len(suffix) + 2:
                want = next(((k, stem) for k, table in (("approved-inflected", own.forms), ("non_approved", own.banned)) if stem in table), None)
        _, kind, hit, _ = own.entries.get(w, (0, 0, w, 0))
        assert (kinds[kind], hit) == (want or ("unknown", w)), w
