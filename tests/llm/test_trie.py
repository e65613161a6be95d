"""Operator 11 against a plain version, and its parts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from proseflow.llm import trie
from proseflow.llm.trie import Louds

SCHEMA = "conv_id long, turn long, role string, text string, total long, p1 string, depth int"


def plain(rows):
    """rows: (conv_id, turn, role, text); no two of one turn."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        path = tuple(base[:h] + v[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    out = {}
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c, last in of if last)))
        up = min(c for c, _ in members[path[:-1]]) if path else None
        out[min(c for c, _ in of), len(path)] = (up, len(of), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    assert len(out) == len(members)
    return out


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], SCHEMA)
    got = trie.rebuilt_trie(df, **sizes).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(found) == len(got)
    return found


def conversations(seed, n, turns, words=3):
    rng = random.Random(seed)
    ids = rng.sample(range(-120, 420), n) + [0, 100, 200]
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "long text", "", "x" * 40][:words])) for c in sorted(set(ids)) for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize(("seed", "n", "turns", "words", "sizes"), [
    (1, 60, 5, 2, {}), (2, 80, 9, 1, {"shard": 2, "step": 3}), (3, 40, 30, 1, {"shard": 1, "step": 2, "block": 4}), (4, 90, 7, 5, {"shard": 5, "step": 4, "block": 2}),
])
def test_against_plain(spark, seed, n, turns, words, sizes):
    rows = conversations(seed, n, turns, words)
    random.Random(seed).shuffle(rows)
    assert run(spark, rows, **sizes) == plain(rows)


def test_copies_long_and_odd_rows(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1030) for t in range(40)]  # one chain of many members
    rows += [(2000, t, "user", f"t{t}") for t in range(7)] + [(c, t, None, None) for c in (2100, 2101) for t in (None, 3)]
    rows += [(2205, 0, "user", "x"), (2301, 9, "é", "\U0001f600" * 3), (None, 0, "user", "nobody")]
    assert run(spark, rows, shard=4, step=2, block=8) == plain(rows)


def test_conversation_without_turns(spark):
    """A conversation all of whose turns are replaced by none is a member of the root alone."""
    c = next(i for i in range(101, 199) if zlib.crc32(str(i).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    found = run(spark, rows)
    assert found == plain(rows) == {(c, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_no_conversations(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 1, "user", "a")]) == {}


def test_repeated_rows_are_turns(spark):
    rows = [(100, 1, "user", "a")] * 3 + [(100, 1, "user", "b")]
    found = run(spark, rows)
    assert sorted(d for _, d in found) == [0, 1, 2, 3, 4]


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 10)
    ids = list(range(-50, 900))
    df = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 7)], "p1 long, p2 long, conv_id long").repartition(7)
    got = {(r.p1, r.p2): r.ends_sha256 for r in trie.ends_of(df).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}


def test_louds():
    #      3          5
    #    /   \        |
    #   0     1       4
    #         |
    #         2
    parent = np.array([3, 3, 1, -1, 5, -1])
    tree = Louds(parent, np.array([20, 10, 0, 1, 0, 2]))
    assert tree.order.tolist() == [3, 5, 1, 0, 4, 2]
    assert tree.levels == [0, 2, 5, 6]
    assert np.unpackbits(tree.bits, count=tree.size).tolist() == [1, 1, 0, 1, 1, 0, 1, 0, 1, 0, 0, 0, 0]
    assert tree.parents().tolist() == [-1, -1, 0, 0, 1, 2]
    assert tree.rollup(np.array([1, 2, 4, 8, 16, 32]))[0].tolist() == [1, 6, 4, 15, 16, 48]


def test_louds_random():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        parent = np.array([rng.integers(-1, i) if i else -1 for i in range(n)])
        shuffled = rng.permutation(n)
        up = np.full(n, -1)
        up[shuffled] = np.where(parent < 0, -1, shuffled[parent])
        values = rng.integers(0, 100, n)
        want = values.copy()
        for i in shuffled[::-1]:
            if up[i] >= 0:
                want[up[i]] += want[i]
        assert Louds(up, rng.integers(0, 5, n)).rollup(values)[0].tolist() == want.tolist()
