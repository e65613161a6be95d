"""Operators 2, 5 and 6 against the tokenizers library and brute force."""

import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from proseflow.llm import bpe, chunk_table, packing, token_file

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "the", " ", "  ", "\n", "\t", " \n", "\n ", "é", "É", "Σ", "1", "23", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "!", "...", " ", "　", "漢字", "²", "\x1c", "🙂", "İ", "Word", "."]
TEXTS = [None, "", " ", "word", "word", "One. Two! Three?\n" * 900, "x" * 5000, *("".join(random.Random(k).choices(BITS, k=k % 40)) for k in range(300))]


library = functools.cache(Tokenizer.from_file)


def ids_of(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "own"), [(BYTE, False), (BYTE, True), (WORD, False)])
def test_encoder_equals_library(path, own):
    encode = bpe.Encoder(path, own)
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(path, text), text


@pytest.mark.parametrize(("path", "own"), [(BYTE, False), (BYTE, True), (WORD, False)])
@pytest.mark.parametrize("block", [1, 50, 1 << 20])
def test_many_equals_library(path, own, block, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", block)
    texts = TEXTS + ["many words of " * 200 + "z" * 300 + " " + "漢" * 90, "a " * 30 + "b" * 64 + " " + "b" * 63]
    texts += ["One.\nTwo\nÉté\n\nx\n", "\nx\n", "a\n\u00a0b\u00a0\nc\n\u3000d\n\u2028\ne\n\u0085f\n's\n"]
    encode = bpe.Encoder(path, own)
    for _ in range(2):
        got = list(encode.many(texts))
        assert len(got) == len(texts)
        for text, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(path, text), text
    assert list(encode.many([])) == []


def test_full_chunk_table_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 60)
    monkeypatch.setattr(chunk_table, "ENTRIES", 40)
    monkeypatch.setattr(chunk_table, "SLOT_BITS", 6)
    encode = bpe.Encoder(BYTE)
    texts = [" ".join(random.Random(k).choices("abcdefgh", k=3)) + f" {k} w{k % 50}." for k in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.many(texts)] == [ids_of(BYTE, x) for x in texts]
    assert encode.table.n <= 40


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 9)
    encode = bpe.Encoder(BYTE)
    text = "one two three four five one two, three."
    assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(BYTE, text)
    assert len(encode.words) <= 3


def test_encode_decode(documents):
    rows = bpe.encode_decode(documents(enumerate(TEXTS)), BYTE).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = ids_of(BYTE, TEXTS[r.doc_id])
        text = library(BYTE).decode(want, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), text)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([0, *(int(1.6**k) + 1 for k in range(25))])
    n = token_file.code_lengths(counts, 25)
    assert n[0] == 0 and abs(sum(2.0 ** -n[1:].astype(float)) - 1) < 1e-12
    import heapq

    heap, cost = sorted(counts[1:].tolist()), 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (counts * n).sum() == cost
    short = token_file.code_lengths(counts, 6)
    assert short.max() <= 6 and sum(2.0 ** -short[1:].astype(float)) <= 1
    assert token_file.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_bits_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 3000
    lengths = token_file.code_lengths(np.bincount(ids, minlength=3000))
    made = token_file.pack_bits(ids, lengths, token_file.canonical(lengths))
    out = token_file.unpack_bits([(n, *made), (n, *made)], token_file.decoding_table(lengths))
    assert all((x == ids).all() for x in out)


def test_token_files(documents, monkeypatch):
    monkeypatch.setattr(token_file, "SHARD", 500)
    order = random.Random(1).sample(range(len(TEXTS)), len(TEXTS))
    rows = {r.doc_id: r for r in token_file.round_trip(documents((i, TEXTS[i]) for i in order), BYTE).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        want = [*ids_of(BYTE, text), 0]
        r = rows[i]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(want), want)
        start += len(want)


def test_no_rows(documents):
    assert token_file.round_trip(documents([]), BYTE).count() == 0
    assert packing.pack(documents([]), WORD).count() == 0
    assert bpe.encode_decode(documents([]), BYTE).count() == 0


def test_packing_covers_every_id(documents, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 9000)
    texts = dict(enumerate(TEXTS + ["A word here. " * 300] * 30))
    pieces = packing.pack(documents(texts.items()), WORD).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, text in texts.items():
        want, at = [*ids_of(WORD, text), 2], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            own = np.frombuffer(p.ids, "<u4").tolist()
            assert p.start == at and p.length == len(own) > 0 and p.doc_tokens == len(want)
            assert own == want[at : at + p.length]
            at += p.length
        assert at == len(want)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.06 * total  # each partition's last window is open


def test_plan_is_optimal():
    for seed in range(40):
        rng = random.Random(seed)
        cuts, penalty = [0], [0]
        for _ in range(rng.randint(1, 14)):
            cuts.append(cuts[-1] + rng.randint(1, 20))
            penalty.append(rng.choice([0, 4, 32]))
        window = 32
        cost = [0] + [10**9] * (len(cuts) - 1)
        for i in range(1, len(cuts)):
            for j in range(i):
                size = cuts[i] - cuts[j]
                if size <= window:
                    pad = 0 if size in (4, 8, 16, 32) else window - size
                    cost[i] = min(cost[i], cost[j] + pad + penalty[i])
        got, at = 0, 0
        for e in packing.plan(cuts, penalty, window):
            size = e - at
            got += (0 if size in (4, 8, 16, 32) else window - size) + penalty[cuts.index(e)]
            at = e
        assert got == cost[-1]
