"""Operator 7 against brute force."""

import math

import numpy as np
import pytest

from proseflow.llm import embeddings


def brute(rows, threshold):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8}
    good = {i: v / abs(v).max() for i, v in good.items()}
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (links[i], root(i), root(i) == i) for i, _ in rows}


@pytest.mark.parametrize("tile", [4, 4096])
def test_near_duplicates(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        c = rng.normal(size=8)
        rows += [c + rng.normal(size=8) * s for s in rng.uniform(0, 0.5, 9)] + [c, c, 3 * c]
    rows = [v.tolist() for v in rows] + [None, [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] * 8, [None] + [1.0] * 7, [], [1.0] * 7, [1e-200] * 8, [1e200] * 8]
    rows = [(7 * i, v) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS node", "3 AS tile")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=tile).collect()}
    assert got == brute(rows, 0.95)


def test_empty_and_null(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], schema)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


def test_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = []
    for d, n in ((1, 2), (3, 12), (8, 20), (5, 1)):
        for _ in range(n):
            c = rng.normal(size=d)
            rows += [c.tolist(), (2 * c).tolist(), (c + rng.normal(size=d) * 0.1).tolist()]
    rows += [[1.0] * 6, [1.0] * 6, [0.5] * 7, None, [0.0] * 3]
    rows = [(3 * i, v) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=8).collect()}
    want = {}
    for d in {len(v or []) for _, v in rows}:  # brute takes vectors of length 8: zeros after the others keep all cosines
        own = [(i, v and v + [0.0] * (8 - d)) for i, v in rows if len(v or []) == d]
        want |= brute(own, 0.95)
    assert got == want and got[len(rows) * 3 - 15][0] == 1


@pytest.mark.parametrize("why", ["asked for", "layouts do not do"])
def test_every_two_tiles(spark, monkeypatch, why):
    """Where the layouts cannot promise the share, no link is lost."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.12).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    if why == "asked for":
        got = embeddings.near_duplicates(df, tile=16, exact=True)
    else:
        monkeypatch.setattr(embeddings.Layouts.__init__, "__defaults__", (1, embeddings.RECALL))
        assert embeddings.Layouts(np.array([v for _, v in rows]), 5, 0.95).estimate < embeddings.RECALL
        got = embeddings.near_duplicates(df, tile=16)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == brute(rows, 0.95)


def test_no_link_is_left_to_the_layouts(spark, monkeypatch):
    """However few pairs the layouts would bring together, the result is that of brute force."""
    monkeypatch.setattr(embeddings.Layouts.__init__, "__defaults__", (embeddings.MOST_LAYOUTS, 0.2))
    monkeypatch.setattr(embeddings, "RECALL", 0.2)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=16).collect()}
    assert got == brute(rows, 0.95)
