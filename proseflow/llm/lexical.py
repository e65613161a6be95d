"""Operator 13: ranked lexical search over a tiered index, exact.

Items are the queries, documents what is ranked.  A posting's impact is the part of the score
that its term gives per unit of weight.

1. Documents become rows of term digests and frequencies, of the terms that an item may have
   (a bit vector of fixed size tells), and are stored.
2. Postings are counted by term and level of impact.  The highest levels of a term, up to
   TIERS[0] postings of it, are the first tier, those up to TIERS[1] the second; the rest
   stay in the documents' rows.  A term's residual bound is its highest impact below a tier.
3. Items meet the first tier by join.  The tenth best sum is a floor of the tenth best score.
   An unseen document reaches at most the sum of the residual bounds, a seen one its sum and
   the bounds of the terms it was not seen with.  If the bound of unseen documents is below
   the floor, the result is among the documents seen whose own bound reaches it, and these are
   scored exactly.
4. Items lacking that proof fall through to both tiers together, and those still lacking it
   to all postings: the items, in blocks of bounded size, against all documents' rows, where
   each task keeps ten documents of an item and drops what is below the floor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseflow.llm.common import groups, join_skewed, stored
from proseflow.llm.words import word_hashes

#: Postings of a term in the first tier, and in the first two, at most (whole levels of impact).
TIERS = (200, 2000)
#: Impacts of one level; impacts are below a million.
LEVEL = 1 << 14
#: Bits of the vector that tells terms of items.
BITS = 1 << 23
#: Rows that are broadcast, at most.
MOST_BROADCAST = 200_000
#: Terms of items, and items, that are compared with all documents at once, about.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 20, 2048
#: Products of postings and items that a task works out at once.
PAIRS = 1 << 21

_LETTERS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def terms(raw: bytes) -> np.ndarray:
    """Digests of the terms of a text in UTF-8: maximal runs of ASCII letters, digits and all beyond ASCII, A-Z as a-z."""
    return word_hashes(raw.translate(_LETTERS))


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, frequency) of each distinct term of each text, and terms with repeats by text."""
    found = [terms(t) for t in texts]
    n = np.array([len(x) for x in found], np.int64)
    term, text = np.concatenate([*found, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((term, text))
    term, text = term[order], text[order]
    new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (text[1:] != text[:-1]))) if len(term) else np.zeros(0, np.int64)
    return text[new], term[new], np.diff(np.append(new, len(term))), n


def _postings(rows: DataFrame, id_: str, wanted: np.ndarray | None) -> DataFrame:
    """``row, id, n, terms, tfs``: a number for each row, its id and terms with repeats, and its distinct terms if ``wanted`` has them."""
    schema = "row long, id long, n long, terms array<long>, tfs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            raws = [x or b"" for x in batch.column(1).to_pylist()]
            for s, e in groups([len(x) for x in raws]):
                text, term, tf, n = counted(raws[s:e])
                if wanted is not None:
                    at = term & np.uint64(BITS - 1)
                    keep = wanted[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0
                    text, term, tf = text[keep], term[keep], tf[keep]
                ends = np.searchsorted(text, np.arange(e - s + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term.view(np.int64), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(e - s)), batch.column(0)[s:e], pa.array(n), *lists], ["row", "id", "n", "terms", "tfs"])
                row += e - s

    return rows.select(F.col(id_).cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def _listed(postings: DataFrame, *columns: str | Column) -> DataFrame:
    return postings.select(*columns, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))


def _join_checked(rows: DataFrame, few: DataFrame, keys: list[str], size: str, n: int) -> DataFrame:
    """An inner join; ``few`` (n rows) is broadcast if it is small, else only its thousand commonest keys are."""
    return rows.join(F.broadcast(few), keys) if n <= MOST_BROADCAST else join_skewed(rows, few, keys, size)


def _seen(tier: DataFrame, asked: DataFrame, residual: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of a tier met with the terms of items.

    Returns the items that are proven and those that are not (``item, floor``), and the
    candidates of the former (``item, row``).
    """
    met = tier.join(asked.select("item", "term", "weight", (F.col("weight") * F.col(residual)).alias("bound")), "term")
    sums, _ = stored(met.groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("low"), F.sum("bound").alias("known")))
    best = sums.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("place") <= k)
    floor = best.groupBy("item").agg(F.max(F.when(F.col("place") == k, F.col("low"))).alias("floor"))
    items = asked.groupBy("item").agg(F.sum(F.col("weight") * F.col(residual)).alias("rest")).join(floor, "item", "left").fillna(0, ["floor"])
    items, _ = stored(items)
    proof = (F.col("rest") < F.col("floor")) | (F.col("rest") == 0)
    proven = items.where(proof)
    candidates = sums.join(proven, "item").where(F.col("low") + F.col("rest") - F.col("known") >= F.col("floor")).where("low + rest > 0").select("item", "row")
    return proven.select("item"), items.where(~proof).select("item", "floor"), candidates


class _Best:
    """The k best documents of each item so far, equal scores by id (null last), then row."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.floors, self.k = floors.copy(), k
        self.kept = [np.zeros(0, np.int64)] * 4

    def add(self, *found: np.ndarray) -> None:
        item, score, id_, row = (np.concatenate(x) for x in zip(self.kept, found, strict=True))
        order = np.lexsort((row, id_, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        score_of = score[last]
        at = np.flatnonzero(place == self.k - 1)
        self.floors[item[at]] = np.maximum(self.floors[item[at]], score_of)
        self.kept = [x[keep] for x in (np.concatenate([self.kept[0], found[0]]), score, id_, row)]


_NO_ID = np.iinfo(np.int64).max


def _scored(postings: DataFrame, block: pa.Table, floors: dict[int, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, row, id, score`` of the documents that can be among the k best of the items in ``block`` (item, term, weight)."""
    items, item = np.unique(np.asarray(block["item"]), return_inverse=True)
    term, weight = np.asarray(block["term"]), np.asarray(block["weight"])
    order = np.argsort(term, kind="stable")
    known, start = np.unique(term[order], return_index=True)
    item, weight, start = item[order], weight[order], np.append(start, len(term))
    floor = np.maximum(np.array([floors[i] for i in items.tolist()], np.int64), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, wide = _Best(floor, k), len(items)

        def chunk(row: np.ndarray, id_: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms_: np.ndarray, tf: np.ndarray) -> None:
            doc = np.repeat(np.arange(len(row)), sizes)
            at = np.minimum(np.searchsorted(known, terms_), len(known) - 1)
            hit = known[at] == terms_
            doc, at, tf = doc[hit], at[hit], tf[hit]
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n[doc] * n_docs // n_terms))
            many = start[at + 1] - start[at]
            ends = np.append(0, np.cumsum(many))
            cuts = np.append(0, np.cumsum(np.bincount(doc, many, len(row)).astype(np.int64)))
            for s, e in groups(np.maximum(np.diff(cuts), wide).tolist(), PAIRS):
                p, q = np.searchsorted(doc, (s, e))
                pair = np.repeat(start[at[p:q]] - ends[p:q], many[p:q]) + np.arange(ends[p], ends[q])
                score = np.zeros((e - s) * wide, np.int64)
                np.add.at(score, np.repeat((doc[p:q] - s) * wide, many[p:q]) + item[pair], weight[pair] * np.repeat(impact[p:q], many[p:q]))
                score = score.reshape(e - s, wide)
                d, i = np.nonzero(score >= best.floors)
                if len(d):
                    best.add(i, score[d, i], id_[s + d], row[s + d])

        for batch in batches:
            row, id_, n = np.asarray(batch.column(0)), np.asarray(batch.column(1).fill_null(_NO_ID)), np.asarray(batch.column(2))
            sizes = np.asarray(batch.column(3).value_lengths()).astype(np.int64)
            chunk(row, id_, n, sizes, np.asarray(batch.column(3).flatten()), np.asarray(batch.column(4).flatten()))
        item_, score, id_, row = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(items[item_]), pa.array(row), pa.array(id_, mask=id_ == _NO_ID), pa.array(score)], ["item", "row", "id", "score"])

    return postings.mapInArrow(run, "item long, row long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, tiers: tuple[int, int] = TIERS, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest score above 0 for each item.

    Both tables have an id and ``text``; other columns are not read.  Equal scores stand by
    id, null last.  Null and empty texts have no terms: such items have no rows, such
    documents do not count.  Rows of one id are documents (items) of their own, repeated or
    not.  Texts are read whole.  If either table has no terms the result is empty.
    """
    spark = docs.sparkSession
    asked_rows, _ = stored(_postings(items, item_id, None))
    asked, _ = stored(_listed(asked_rows, F.col("row").alias("item")).withColumnRenamed("tf", "times"))
    place = F.col("term").bitwiseAND(BITS - 1)
    bits = asked.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(term & 63L AS INT))")).alias("bits"))
    wanted = np.zeros(BITS >> 6, np.uint64)
    for word, value in bits.collect():  # BITS / 64 rows at most
        wanted[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    postings, _ = stored(_postings(docs, doc_id, wanted).where("n > 0"))
    n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).head()
    if not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    m = F.lit(25) + F.expr(f"(75L * n * {n_docs}L) div {n_terms}L")
    listed = _listed(postings, "row", m.alias("m")).select("row", "term", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("impact"))
    levels = listed.groupBy("term", F.expr(f"impact div {LEVEL}L").alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    levels = levels.join(asked.select("term").distinct(), "term", "left_semi")
    so_far = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("level")))
    df = F.sum("n")
    known = levels.withColumn("so_far", so_far).groupBy("term").agg(
        df.alias("df"), *(F.coalesce(F.max(F.when(F.col("so_far") > t, F.col("most"))), F.lit(0)).alias(f"rest_{i}") for i, t in enumerate(tiers))
    )
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    known, _ = stored(known.withColumn("w", w))
    high = _join_checked(listed, known.select("term", "df", "rest_0", "rest_1"), ["term"], "df", known.count()).where("impact > rest_1")
    index, _ = stored(high.select("term", "row", "impact", F.when(F.col("impact") > F.col("rest_0"), 0).otherwise(1).alias("tier")), partition_by="tier")
    asked, _ = stored(asked.join(known, "term").select("item", "term", (F.col("times") * F.col("w")).alias("weight"), "rest_0", "rest_1"))

    _, open_0, candidates_0 = _seen(index.where("tier = 0"), asked, "rest_0", k)
    left = asked.join(open_0.select("item"), "item", "left_semi")
    _, open_1, candidates_1 = _seen(index, left, "rest_1", k)
    candidates, _ = stored(candidates_0.unionByName(candidates_1))
    of_docs = candidates.select("row").distinct()
    found_docs = postings.join(F.broadcast(of_docs), "row", "left_semi") if candidates.count() <= MOST_BROADCAST else postings.join(of_docs, "row", "left_semi")
    exact = _listed(found_docs, "row", "id", m.alias("m")).join(candidates, "row").join(asked.select("item", "term", "weight"), ["item", "term"])
    exact = exact.groupBy("item", "row").agg(F.any_value("id").alias("id"), F.sum(F.expr("weight * ((1000000000L * tf) div (1000L * tf + 8L * m))")).alias("score")).where("score > 0")

    last = asked.join(open_1, "item")
    n_last, n_items = last.agg(F.count("*"), F.count_distinct("item")).head()
    parts = [exact.select("item", "row", "id", "score")]
    if n_last:
        blocks = max(-(-n_last // BLOCK_TERMS), -(-n_items // BLOCK_ITEMS))
        last, _ = stored(last.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), partition_by="block")
        for b in range(blocks):
            block = last.where(F.col("block") == b).select("item", "term", "weight", "floor").toArrow()
            if block.num_rows:
                floors = dict(zip(block["item"].to_pylist(), block["floor"].to_pylist(), strict=True))
                parts.append(_scored(postings, block, floors, n_docs, n_terms, k))
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked_rows.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH t AS (SELECT 'd' AS kind, rowid_ AS r, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
           UNION ALL
           SELECT 'i', rowid_, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
           FROM (SELECT *, row_number() OVER () AS rowid_ FROM benchmark)),
c AS (SELECT kind, r, id, term, count(*) AS tf FROM t GROUP BY ALL),
docs AS (SELECT r, sum(tf)::BIGINT AS n FROM c WHERE kind = 'd' GROUP BY r),
g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM c, g WHERE kind = 'd' GROUP BY term, nn),
p AS (SELECT c.r, c.id, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS part
      FROM c JOIN docs USING (r) JOIN w USING (term), g WHERE kind = 'd'),
s AS (SELECT i.r, i.id AS item_id, p.id AS doc_id, p.r AS doc, sum(i.tf * part)::BIGINT AS score FROM c i JOIN p USING (term) WHERE i.kind = 'i' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST, doc)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
