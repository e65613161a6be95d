"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proseflow.sources.storage import checkpointed, release, run_dir, shared_dir, stored  # noqa: F401

#: Bytes of text that the numpy code works on at once; longer texts come alone.
GROUP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that ``join_skewed`` takes out of the shuffle, at most: what it broadcasts does not grow with the data.
HOT_KEYS = 1000


def join_skewed(rows: DataFrame, few: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, which has a row for each key and, in ``size``, how many of ``rows`` have it.

    Rows of the HOT_KEYS commonest keys meet theirs by broadcast, so that no task gets all rows
    of one; after them, a key has at most a HOT_KEYS-th of all rows.  ``few`` is read twice: a stored table.
    """
    hot = few.orderBy(F.desc(size), *keys).limit(HOT_KEYS)
    names = hot.select(*keys, F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    own = [c for c in few.columns if c not in keys]
    cold = few.join(F.broadcast(names), keys, "left_anti")
    met = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot IS NULL").drop("__hot", *own).join(cold, keys, how)
    return met.unionByName(rest.select(*met.columns))


def in_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``function`` over Arrow batches."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def groups(sizes: list[int], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to ``most`` at most (one row at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: returns ``node, component`` (the smallest node).

    Contraction: each node points to its smallest neighbour, pointers are followed until
    they are roots, edges are moved to the roots, and the loop ends when none joins two
    roots.  Only the count of edges reaches the driver.  Each round at least halves the
    nodes that still have edges.
    """
    edges, drop = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    levels = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents, drop_parents = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        while True:  # smaller at each step, so there is no cycle
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            shorter, drop_shorter = stored(parents.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            drop_parents()
            parents, drop_parents = shorter, drop_shorter
            if parents.where("moved").isEmpty():
                break
        parents = parents.select("a", "p")
        levels.append(parents)
        of_b = parents.select(F.col("a").alias("b"), F.col("p").alias("q"))
        fewer, drop_fewer = stored(
            edges.join(parents, "a").join(of_b, "b").where("p <> q")
            .select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
        )
        drop()
        edges, drop = fewer, drop_fewer
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = levels[0].select(F.col("a").alias("node"), F.col("p").alias("component"))
    for parents in levels[1:]:
        up = parents.select(F.col("a").alias("component"), F.col("p").alias("next"))
        out = out.join(up, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
