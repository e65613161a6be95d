"""Operator 13 against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from proseflow.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    found = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    found = [(i, c, c.total()) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        times = Counter(TERM.findall((text or "").translate(UPPER)))
        scores = []
        for i, c, n in found:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in times.items() if c[t])
            scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 0.5, "x", 3) for i, t in docs], "doc_id long, text string, score double, item_id string, n int").repartition(5)
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, rank int")
    return sorted((tuple(r) for r in lexical.search(d, q, **options).collect()), key=repr)


def corpus(seed, n=300, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Élan", "straße", "the", "THE"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(i * 3, text(rng.randint(0, 60))) for i in range(n)] + [(7, docs_text := text(2000)), (8, docs_text), (8, docs_text), (None, text(20)), (10, None), (11, ""), (13, " .,")]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(1, "w1 w1 w1"), (None, "w2 the The"), (90, None), (91, ""), (92, "unheard"), (93, docs[5][1]), (94, docs_text)]
    return docs, items


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"tiers": (5, 20)}), (3, {"tiers": (0, 0)}), (4, {"tiers": (30, 5000), "k": 3})])
def test_against_plain(spark, seed, options):
    docs, items = corpus(seed)
    assert run(spark, docs, items, **options) == plain(docs, items, options.get("k", 10))


def test_blocks_and_joins_without_broadcast(spark, monkeypatch):
    for name, value in (("BLOCK_TERMS", 50), ("BLOCK_ITEMS", 4), ("PAIRS", 60), ("MOST_BROADCAST", 1), ("BITS", 64)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(5)
    assert run(spark, docs, items, tiers=(3, 10)) == plain(docs, items)


def test_ties_stand_by_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(99, "other")]
    got = run(spark, docs, [(1, "words")])
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(i, i) for i in range(1, 11)]
    assert got == plain(docs, [(1, "words")])


def test_each_tier_is_used(spark, monkeypatch):
    seen = []
    true = lexical._seen

    def spy(*a):
        out = true(*a)
        seen.append((out[0].count(), out[1].count()))
        return out

    monkeypatch.setattr(lexical, "_seen", spy)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices([f"r{j}" for j in range(800)], k=30))) for i in range(2000)]
    items = [(1, "r1"), (2, "r1 r2 r3 r4"), (3, " ".join(f"r{j}" for j in range(60)))]
    assert run(spark, docs, items, tiers=(12, 40)) == plain(docs, items)
    assert all(p > 0 for p, _ in seen) or seen[0][1] > 0
    assert len(seen) == 2


def test_empty_tables(spark):
    docs, items = corpus(6, 5)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == []


def test_terms():
    text = "AZ az09 Ünï-é_x@y[z]{q}\x7f٣  ß"
    assert len(lexical.terms(text.encode())) == len(TERM.findall(text))
    assert np.array_equal(lexical.terms(b"ABC abc"), lexical.terms(b"abc ABC"))
    assert not np.array_equal(lexical.terms("É".encode()), lexical.terms("é".encode()))
