"""Operator 9: quality rules by calibrated logistic regression over hashed n-grams.

Features of a text are its relative frequencies of hashed single words, word pairs and
character n-grams.  The score of a text is then a mean of weights, so scoring needs no
sparse vectors: weights are looked up for every n-gram and averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.llm.common import GROUP_BYTES, in_arrow, stored
from proseflow.llm.words import PLACES, char_grams, characters, windows, word_hashes

BITS = 16
#: Kinds of features: words, word pairs, and n-grams of these numbers of characters.
GRAMS = (3, 4)
KINDS = 2 + len(GRAMS)
#: Labelled texts that the model is fitted on, at most, of each class, and bytes of them (more only if one text has more).
SAMPLE, SAMPLE_BYTES = 1000, 16_000_000
#: Texts with a lower probability of good quality are rejected.
THRESHOLD = 0.35
#: Words of a window that counts as a repeat, least words, most per cent of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

_SPACE = np.zeros(256, np.uint8)
_SPACE[[32, *range(9, 14)]] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1


def repeat_words(hashes: np.ndarray, n: int = WINDOW) -> int:
    """Words covered by windows of n words found twice or more."""
    found = windows(hashes, n)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    if not same.any():
        return 0
    marks = np.zeros(len(hashes) + 1, np.int64)
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    marks[at] += 1
    marks[at + n] -= 1
    return int((np.cumsum(marks) > 0).sum())


def counts_of(raw: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    data = np.frombuffer(raw, np.uint8)
    chars = int(((data & 0xC0) != 0x80).sum()) - int(_SPACE[data].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(hashes), chars, int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeat_words(hashes)


def grams_of(text: str, hashes: np.ndarray):
    """(kind, buckets) in portions of bounded size."""
    shift = np.uint64(64 - BITS)
    yield 0, (hashes * PLACES[40]) >> shift
    yield 1, windows(hashes, 2) >> shift
    longest = max(GRAMS) - 1
    for at in range(0, len(text), GROUP_BYTES):
        points = characters(text[at : at + GROUP_BYTES + longest])
        for k, n in enumerate(GRAMS):
            yield 2 + k, char_grams(points[: GROUP_BYTES + n - 1], n, BITS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and relative frequencies; those of each kind add up to 1."""
    raw = (text or "").encode(errors="replace")
    total = np.zeros((KINDS, 1 << BITS), np.float32)
    for kind, buckets in grams_of(text or "", word_hashes(raw)):
        total[kind] += np.bincount(buckets.astype(np.int64), minlength=1 << BITS)
    total /= np.maximum(total.sum(1, keepdims=True), 1)
    flat = total.reshape(-1)
    used = np.flatnonzero(flat)
    return used.astype(np.int32), flat[used]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, share: float, rounds: int = 80, l2: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """Weights, and slope and offset of the calibration.

    Fitted on four fifths of the rows, each class with equal weight; calibrated on the
    rest, each class with its share among all labelled rows (``share`` is that of good ones).
    """
    held = np.arange(len(rows)) % 5 == 0
    if len(set(good[held].tolist())) < 2:
        held[:] = False
    buckets = np.concatenate([b for b, _ in rows])
    used, buckets = np.unique(buckets, return_inverse=True)
    values = np.concatenate([v for _, v in rows]).astype(np.float64)
    sizes = np.array([len(b) for b, _ in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    # Frequencies are small: their root brings rare and common n-grams nearer to each other,
    # but the score must stay a mean of weights, so only the step sizes use it.
    step = np.sqrt(np.bincount(buckets, values, minlength=len(used)) / len(rows)) + 1e-4
    fit = (~held).astype(float)
    weight = np.where(good, 0.5 / max(fit[good].sum(), 1), 0.5 / max(fit[~good].sum(), 1)) * fit
    w, b, m, v, mb, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam over all rows
        p = logistic(np.bincount(row, w[buckets] * values, minlength=len(rows)) + b)
        g = weight * (p - good)
        grad = np.bincount(buckets, values * g[row], minlength=len(used)) / step + l2 * w * step
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        w -= 0.3 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) / step * step.mean()
        b -= 0.05 * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    score = np.bincount(row, w[buckets] * values, minlength=len(rows)) + b
    use = held if held.any() else ~held
    x, y = score[use], good[use].astype(float)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method, with a small penalty so that separable rows have a solution
        p = logistic(slope * x + offset)
        h = weight * p * (1 - p)
        grad = np.array([(weight * (p - y) * x).sum() + 1e-3 * (slope - 1), (weight * (p - y)).sum() + 1e-3 * offset])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, grad)
        slope, offset = slope - move[0], offset - move[1]
        if abs(move).max() < 1e-9:
            break
    full = np.zeros(KINDS << BITS, np.float32)
    full[used] = w
    return full, max(float(slope), 1e-3), float(slope * b + offset)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text"):
    """The model, from at most ``sample`` labelled texts of each class, those first in order of a hash of the id.

    ``sample_bytes`` bounds their sizes together, so that the features on the driver are
    bounded too: a class stops before the text that would exceed it, but has one at least.
    Of labels that contradict each other the lower one counts, and of rows with one id the
    first text.  Features come from whole texts, on the executors.  None if a class has no text.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = dict(known.groupBy("quality").count().collect())
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("id"), "quality"))  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    texts, drop = stored(texts.groupBy("id", "quality").agg(F.min("text").alias("text")))
    left, chosen = {0: sample_bytes, 1: sample_bytes}, {0: [], 1: []}
    for r in sorted(texts.select("id", "quality", F.xxhash64("id").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect(), key=lambda r: (r.h, r.id)):
        left[r.quality] -= r["size"]
        if left[r.quality] >= 0 or not chosen[r.quality]:
            chosen[r.quality].append(r.id)
    texts = texts.where(F.col("id").isin([*chosen[0], *chosen[1]])).select("quality", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["quality", "buckets", "shares"])

    rows = in_arrow(texts, run, "quality int, buckets binary, shares binary").toArrow().to_pylist()
    drop()
    rows.sort(key=lambda r: (r["buckets"], r["shares"], r["quality"]))
    good = np.array([r["quality"] == 1 for r in rows], bool)
    if not good.any() or good.all():
        return None
    return train([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows], good, n[1] / (n[0] + n[1]))


def judge(text: str | None, model, threshold: float) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept."""
    raw = (text or "").encode(errors="replace")
    hashes = word_hashes(raw)
    counts = counts_of(raw, hashes)
    failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
    p = 1.0
    if model is not None:
        weights, slope, offset = model
        sums, ns = np.zeros(KINDS), np.zeros(KINDS)
        for kind, buckets in grams_of(text or "", hashes):
            sums[kind] += weights[kind << BITS : (kind + 1) << BITS].take(buckets.astype(np.int64)).sum(dtype=np.float64)
            ns[kind] += len(buckets)
        p = float(logistic(slope * (sums / np.maximum(ns, 1)).sum() + offset))
    return *counts, failed, p, not failed and p >= threshold


def assess(docs: DataFrame, model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept``.

    A null text has no words and fails.  Without a model (None) the base rules alone decide.
    A line is compared whole; one without a word never counts as repeated.  Every row gives a
    row, repeated ones and those with a null id too; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(text, held.value, threshold) for text in batch.column(1).to_pylist()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(known, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that ``assess`` keeps."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([judge(text, held.value, threshold)[-1] for text in batch.column(place).to_pylist()], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
