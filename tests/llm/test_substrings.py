"""Operator 8 and its suffix arrays against brute force."""

import random

import pytest

from proseflow.llm import substrings
from proseflow.llm.suffixes import suffix_array


@pytest.mark.parametrize("letters", ["a", "ab", "abcd"])
def test_suffix_array(letters):
    for seed in range(500):
        rng = random.Random(seed)
        text = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array("ab" * 2000) == sorted(range(4000), key=lambda i: ("ab" * 2000)[i:])


def brute(docs, n=50):
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - n + 1):
            w = raw[k : k + n]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            if first[raw[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        spans, at = [], 0
        while (s := gone.find(1, at)) >= 0:
            at = gone.find(0, s) if gone.find(0, s) >= 0 else len(raw)
            spans.append((s, at))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeéß ", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(6, 40)) for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [text(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts += [p[a:b] if rng.random() < 0.6 else p, text(rng.randint(0, 5))]
        docs.append((i, "".join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(10)]  # exact copies
    docs += [(300 + i, docs[i][1][:40] + "X" + docs[i][1][41:]) for i in range(20)]  # near ones
    docs += [(400, None), (401, ""), (402, "a" * 49), (403, "a" * 50), (404, "a" * 500), (405, "b" + "a" * 60), (406, "ab" * 300), (407, "ba" * 40), (408, "z" * 120 + "q" + "z" * 49)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("large", "slice_"), [(20_000, 4_000_000), (3, 4_000_000), (20_000, 100)])
def test_dedup_substrings(documents, monkeypatch, large, slice_):
    monkeypatch.setattr(substrings, "LARGE", large)
    monkeypatch.setattr(substrings, "SLICE", slice_)
    docs = corpus()
    rows = substrings.dedup_substrings(documents(docs)).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in rows)
    assert got == brute(docs)


def test_odd_rows(documents):
    t = "one two three four five six seven eight nine ten eleven twelve"
    assert substrings.dedup_substrings(documents([])).count() == 0
    rows = substrings.dedup_substrings(documents([(1, t), (1, t), (1, t + " more"), (None, t), (2, t)])).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in rows) == [(0, 62, 0), (1, 62, 0), (1, 62, 0), (1, 67, 0), (2, 62, 62)]
