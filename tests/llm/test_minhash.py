"""Operator 1 against brute force."""

import random
import re

import pytest

from proseflow.llm import minhash


def brute(docs, words, threshold):
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    docs = []
    for _ in range(8):
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
        docs.append("\t".join(base).upper())
    docs += [None, "", " \n", "a", "A", "a b", "a  b", "b a", "a b c", "É b c", "é b c", " ".join(word() for _ in range(30000))]
    docs.append(docs[-1] + " end")
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("words", "threshold", "tile"), [(3, 85, 1024), (5, 80, 4)])
def test_near_duplicates(documents, monkeypatch, words, threshold, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    docs = corpus()
    rows = minhash.near_duplicates(documents(docs), words, threshold).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == brute(docs, words, threshold)


def test_odd_rows(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    assert minhash.near_duplicates(documents([(1, None), (2, "")])).count() == 2
    rows = minhash.near_duplicates(documents([(3, "a b"), (3, "a b"), (3, "c d"), (4, "c d"), (None, "a b")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("3", "3", True)] * 3 + [("4", "3", False), ("None", "None", True)]


@pytest.mark.parametrize(("threshold", "wanted"), [(85, (22, 6)), (80, (35, 6)), (100, None), (95, None), (60, None), (30, None), (1, None)])
def test_banding(threshold, wanted):
    bands, rows = minhash.banding(threshold)
    assert wanted in (None, (bands, rows))
    assert bands * rows <= len(minhash._A) and (1 - (threshold / 100) ** rows) ** bands <= 3e-5
    keys, sketch, _ = minhash.signature(minhash.shingle_set("a b c d e", 2), bands, rows)
    assert len(keys) == bands and len(sketch) == minhash.SKETCH_BITS // 64


def test_default_bands_follow_the_threshold(documents, monkeypatch):
    seen = []
    monkeypatch.setattr(minhash, "odd_bits", lambda similarity, samples: seen.append(samples) or 0)
    monkeypatch.setattr(minhash, "banding", lambda threshold: seen.append(threshold) or (2, 3))
    minhash.near_duplicates(documents([(1, "a b c d e f"), (2, "a b c d e f")]))
    assert seen[0] == 80 and seen[1] == 6


def test_texts_of_no_cluster_are_not_shuffled(spark):
    """The filter keeps every document that is asked for, negative ids too, and few others."""
    rows = spark.range(-20_000, 20_000).withColumnRenamed("id", "node")
    wanted = rows.where("node % 40 = 0")
    kept = {r.node for r in minhash.maybe_in(rows, wanted, 1000).collect()}
    assert kept >= set(range(-20_000, 20_000, 40)) and len(kept) < 6000
    assert minhash.maybe_in(rows, wanted.limit(0), 0).count() == 0
