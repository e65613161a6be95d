"""Operator 3: language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; ASCII characters other than letters and white space become
spaces and runs of spaces become one, so n-grams see word ends but neither digits nor marks.
A batch of texts is one sparse matrix of n-gram buckets by text; its product with the matrix
of log-probabilities is a look-up and a sum over each text's stretch of buckets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.llm.common import GROUP_BYTES, groups, in_arrow
from proseflow.llm.words import char_grams, characters

LENGTHS = (1, 2, 3)
BITS = 14
SIZE = len(LENGTHS) << BITS
#: Added to each count.
SMOOTHING = 0.5


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def prepared(text: str) -> np.ndarray:
    """Code points in lower case; runs of white space and of ASCII characters other than letters are one space, and so are the ends."""
    points = characters(f" {text.lower()} ")
    space = (points < 128) & ~_letters()[points] | np.isin(points, (0x85, 0xA0, 0x2028, 0x2029, 0x3000))
    points = np.where(space, np.uint32(32), points)
    return points[~(space & np.append(False, space[:-1]))]


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Slices of a long text that share no n-gram and lose none but at their ends' overlap."""
    most = GROUP_BYTES
    for at in range(0, max(len(points), 1), most):
        yield points[at : at + most + max(LENGTHS) - 1]


def buckets(points: np.ndarray) -> np.ndarray:
    """All n-grams of a slice, each length with buckets of its own."""
    grams = [char_grams(points[: GROUP_BYTES + n - 1], n, BITS) + np.uint32(k << BITS) for k, n in enumerate(LENGTHS)]
    return np.concatenate(grams)


def features(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    total = np.zeros(SIZE, np.int64)
    for part in pieces(prepared(text)):
        total += np.bincount(buckets(part), minlength=SIZE)
    return total


def scores(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log-probabilities, a row for each text and a column for each language."""
    out = np.repeat(matrix[None, :, SIZE].astype(np.float64), len(texts), 0)
    for start, end in groups([len(t) for t in texts]):
        parts, owner = [], []
        for i in range(start, end):
            for part in pieces(prepared(texts[i])):
                if len(found := buckets(part)):
                    parts.append(found)
                    owner.append(i)
        if not parts:
            continue
        every = np.concatenate(parts)
        starts = np.append(0, np.cumsum([len(x) for x in parts])[:-1])
        for j in range(matrix.shape[0]):
            np.add.at(out[:, j], owner, np.add.reduceat(matrix[j].take(every), starts, dtype=np.float64))
    return out


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and for each the log prior and the log probability of each bucket.

    Counts cover all rows with a text and a language, repeated ones as often as they come;
    ids are not read.  The result has a row for each language, whatever the number of texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = totals.setdefault(lang, np.zeros(SIZE + 1, np.int64))
                total[:SIZE] += features(text)
                total[SIZE] += 1
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used])], ["lang", "bucket", "n"])

    known = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    total = np.zeros((len(langs), SIZE + 1))
    place = {lang: k for k, lang in enumerate(langs)}
    total[[place[x] for x in counts["lang"].to_pylist()], counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    grams = total[:, :SIZE] + SMOOTHING
    for k in range(len(LENGTHS)):
        part = grams[:, k << BITS : (k + 1) << BITS]
        part /= part.sum(1, keepdims=True)
    prior = total[:, SIZE:] / max(total[:, SIZE].sum(), 1)
    return langs, np.concatenate([np.log(grams), np.log(prior)], 1).astype(np.float32)


def predict(rows: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``doc_id, lang_pred, score``: the likeliest language and its posterior probability.

    ``und`` and 0 for a null text, one without letters, or a model without languages.
    Of languages that are equally likely, the first in order of name.  Every row gives a row,
    repeated ones and those with a null id too; other columns are not read.  Long texts are
    read whole, in slices.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, matrix = held.value
        texts = batch.column(1).to_pylist()
        preds, found = ["und"] * len(texts), [0.0] * len(texts)
        usable = [i for i, t in enumerate(texts) if langs and t and _letters()[characters(t)].any()]
        sums = scores([texts[i] for i in usable], matrix) if usable else np.zeros((0, 1))
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        for i, k, p in zip(usable, best.tolist(), share.tolist(), strict=True):
            preds[i], found[i] = langs[k], p
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(found, pa.float64())], ["doc_id", "lang_pred", "score"])

    known = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(known, run, "doc_id long, lang_pred string, score double")
