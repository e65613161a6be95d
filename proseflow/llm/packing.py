"""Operator 2: packing token ids into sequences by order-preserving dynamic programming.

Documents keep their order.  Windows are cut at document ends, sentence ends or, at a
higher price, elsewhere; the plan minimises padding plus cut penalties.  With positions
P, a window from cut j to cut i costs ``window - (P[i] - P[j])`` padding, so
``cost[i] = window - P[i] + penalty[i] + min(cost[j] + P[j])`` over the cuts j that lie
at most a window before i: a sliding minimum, kept in a monotone queue.  A window whose
length is a power of two needs no padding and is tried besides.

Each partition is packed by itself, in blocks; the last, open window of a block goes on
in the next.  A partition's last window is split into powers of two where that is cheaper.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.llm.bpe import encoder

WINDOW = 4096
#: Ids planned at once.
BLOCK = 1 << 17
#: Penalties in tokens of padding for a cut at a sentence's end and elsewhere inside a document.
SENTENCE, INSIDE = 4, 32
#: Distance of the cuts offered inside a sentence that is longer.
STEP = 256

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def plan(cuts: list[int], penalty: list[int], window: int) -> list[int]:
    """Positions at which the cheapest windows end.  cuts: ascending, from 0 to the end, at most a window apart."""
    n = len(cuts)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost[j] + cuts[j], j), ascending in both
    where = {p: i for i, p in enumerate(cuts)}
    powers = [1 << k for k in range(window.bit_length() - 4, window.bit_length()) if 1 << k < window]
    for i in range(1, n):
        p = cuts[i]
        while cuts[queue[0][1]] < p - window:
            queue.popleft()
        value, j = queue[0]
        best = window - p + value
        for size in powers:
            k = where.get(p - size)
            if k is not None and cost[k] < best:
                best, j = cost[k], k
        cost[i], back[i] = best = best + penalty[i], j
        value = best[0] + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    ends, i = [], n - 1
    while i:
        ends.append(cuts[i])
        i = back[i]
    return ends[::-1]


def cut_positions(ids: np.ndarray, doc_ends: np.ndarray, is_end: np.ndarray) -> tuple[list[int], list[int]]:
    """Cuts offered and their penalties."""
    sentence = np.flatnonzero(is_end[ids]) + 1
    at = np.unique(np.concatenate([[0], sentence, doc_ends]))
    gaps = np.diff(at)
    far = np.flatnonzero(gaps > STEP)
    inside = [np.arange(at[k] + STEP, at[k + 1], STEP) for k in far]
    cuts = np.unique(np.concatenate([at, *inside])).astype(np.int64)
    penalty = np.full(len(cuts), INSIDE)
    penalty[np.searchsorted(cuts, sentence)] = SENTENCE
    penalty[np.searchsorted(cuts, doc_ends)] = 0
    return cuts.tolist(), penalty.tolist()


def power_parts(size: int, window: int) -> list[int]:
    """Lengths into which the last window is split: powers of two, if cheaper than its padding."""
    parts = [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
    return parts if (len(parts) - 1) * INSIDE < window - size else [size]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most ``window`` ids, as the pieces of documents in them.

    Returns ``doc_id, start, length, ids`` (unsigned 32-bit, little-endian), ``doc_tokens,
    sequence_id, offset``.  A document's ids are those of ``tokenizer`` and ``end_id``; a
    null text counts as empty, so that its document is ``end_id`` alone.  Each row is a
    document of its own, whatever its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        marks = [enc.vocab.get(m + enc.end) for m in (".", "!", "?", "...", "…")]
        is_end = np.zeros(max(end_id, *enc.vocab.values(), *enc.special.values()) + 1, bool)
        is_end[[m for m in marks if m is not None]] = True
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) not yet in a sequence

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal held, sequence
            raw = b"".join(x[2] for x in held)
            ids = np.frombuffer(raw, "<u4")
            doc_ends = np.cumsum([len(x[2]) // 4 for x in held])
            ends = plan(*cut_positions(ids, doc_ends, is_end), window)
            starts = [0, *ends[:-1]]
            if last:
                a = starts.pop()
                ends.pop()
                for size in power_parts(len(ids) - a, window):
                    starts.append(a)
                    ends.append(a := a + size)
            elif len(ends) > 1:  # the last window stays open
                starts.pop()
                ends.pop()
            firsts, rows = [0, *doc_ends.tolist()], []
            for s, e in zip(starts, ends, strict=True):
                k = bisect_right(firsts, s) - 1
                while k < len(held) and firsts[k] < e:
                    doc_id, start, _, total = held[k]
                    a, b = max(s, firsts[k]), min(e, firsts[k + 1])
                    rows.append((doc_id, start + a - firsts[k], b - a, raw[4 * a : 4 * b], total, sequence, a - s))
                    k += 1
                sequence += 1
            done = ends[-1]
            k = bisect_right(firsts, done) - 1
            rest = []
            for i in range(k, len(held)):
                doc_id, start, own, total = held[i]
                skip = max(0, done - firsts[i])
                if 4 * skip < len(own):
                    rest.append((doc_id, start + skip, own[4 * skip :], total))
            held = rest
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), enc.many(x.as_py() for x in batch.column(1)), strict=True):
                own += end
                held.append((doc_id, 0, own, len(own) // 4))
                size += len(own) // 4
                if size >= BLOCK:
                    yield cut(False)
                    size = sum(len(x[2]) // 4 for x in held)
        if held:
            yield cut(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
