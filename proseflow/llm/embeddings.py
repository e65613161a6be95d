"""Operator 7: near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned to the axes of a principal component analysis,
largest first.  Equal vectors are one node with a count.  Nodes are dealt into tiles of
bounded size, once in each of several layouts: a layout cuts along a few directions among
the leading axes, each near the median, and a tile is a cell of these cuts.  Two linked
vectors must share a tile in one layout.  A tile is compared from the leading axes on:
partial products are bounded by the norms of the suffixes, and a pair is dropped as soon as
the threshold is out of reach.  What survives is decided on all components in double
precision.  A pair counts in the first layout that brings it together, and nowhere else.

Every two tiles are compared: no link is lost, in bounded memory, and the work grows with the
square of the rows.  Up to TILE_VALUES components of all vectors together there is one tile.

Only where ``exact=False`` asks for it, layouts take the place of all pairs of tiles, and links
near the threshold can be lost.  Their number follows from the data: sampled vectors are moved
by random steps to the threshold exactly, and layouts are added until a share of RECALL of
them meets its origin; pairs that are closer meet more often.  So work grows with rows times
layouts times the size of a tile, and the layouts grow with the logarithm of the rows.  Where
MOST_LAYOUTS do not reach that share, every two tiles are compared after all.

A cell that holds more than twice a tile is cut into parts, and every two parts are a task:
exact, in bounded memory, but the work in one such cell grows with its square.
A task gives sums of links and a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.llm.common import components, in_arrow, join_skewed, stored

#: Components of the vectors of a tile, about: 16,384 vectors of 64.
TILE_VALUES = 1 << 20
#: Rows that the cuts and the number of layouts are taken from, at most; half of them are moved to the threshold.
SAMPLE = 20_000
#: Share of pairs at the threshold that must meet, as estimated, and layouts at most.
RECALL, MOST_LAYOUTS = 0.995, 64  # beyond these layouts, every two tiles are compared
#: Parts of the axes, leading ones first, after which pairs are bounded.
STEPS = (0.25, 0.5)
#: Axes that cuts are made of, for each cut.
CUT_AXES = 4
#: Components of vectors that axes are worked out for, at most: longer ones are ordered by variance only.
MOST_AXES = 4096
#: More than rounding can change in a bound.
SLACK = 1e-9


def roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """For each of n, the smallest that links ``a, b`` (and those known to ``parent``) connect it with."""
    parent = np.arange(n) if parent is None else parent
    while True:
        p, q = parent[a], parent[b]
        open_ = p != q
        if not open_.any():
            return parent
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent[parent] != parent).any():
            parent = parent[parent]


class Layouts:
    """Cuts of several layouts: ``keys`` gives the cell of each vector in each."""

    def __init__(self, points: np.ndarray, bits: int, threshold: float, most: int = MOST_LAYOUTS, recall: float = RECALL):
        rng = np.random.default_rng(11)
        n, d = points.shape
        self.axes = min(d, max(16, CUT_AXES * bits))
        own = points[: max(1, n // 2)]
        step = rng.normal(size=own.shape)
        step -= (step * own).sum(1, keepdims=True) * own
        step /= np.maximum(np.sqrt((step * step).sum(1, keepdims=True)), 1e-300)
        moved = threshold * own + math.sqrt(max(0.0, 1 - threshold * threshold)) * step
        self.cuts: list[tuple[np.ndarray, np.ndarray]] = []
        met = np.zeros(len(own), bool)
        while bits and len(self.cuts) < most and met.mean() < recall:
            turn = np.linalg.qr(rng.normal(size=(self.axes, self.axes)))[0][:, : min(bits, self.axes)]
            if bits > self.axes:
                turn = np.concatenate([turn, rng.normal(size=(self.axes, bits - self.axes))], 1)
            middle = np.median(points[:, : self.axes] @ turn, axis=0)
            self.cuts.append((turn, middle))
            met |= self._key(own, -1) == self._key(moved, -1)
        self.estimate = float(met.mean()) if bits else 1.0

    def _key(self, x: np.ndarray, layout: int) -> np.ndarray:
        turn, middle = self.cuts[layout]
        side = x[:, : self.axes] @ turn >= middle
        return (side.astype(np.int64) << np.arange(side.shape[1])).sum(1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A row for each vector, a column for each layout."""
        if not self.cuts:
            return np.zeros((len(x), 1), np.int32)
        return np.stack([self._key(x, k) for k in range(len(self.cuts))], 1).astype(np.int32)


def compare(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, chunk: int = 512):
    """Index pairs with a product of the threshold or more, in portions; of one tile with itself, each pair once."""
    dims = x.shape[1]
    steps = sorted({int(s * dims) for s in STEPS} - {0})
    # Norm of what comes after each step.
    rest_x = [np.sqrt(np.maximum((x[:, s:] ** 2).sum(1), 0)) for s in steps]
    rest_y = [np.sqrt(np.maximum((y[:, s:] ** 2).sum(1), 0)) for s in steps]
    for at in range(0, len(x), chunk):
        own = x[at : at + chunk]
        first = steps[0] if steps else dims
        sums = own[:, :first] @ y[:, :first].T
        bound = sums + np.outer(rest_x[0][at : at + chunk], rest_y[0]) if steps else sums
        if same:
            bound[np.arange(len(own))[:, None] + at >= np.arange(len(y))] = -1
        i, j = np.nonzero(bound >= threshold - SLACK)
        part = sums[i, j]
        for k in range(1, len(steps)):
            if not len(i):
                break
            a, b = steps[k - 1], steps[k]
            part = part + np.einsum("ij,ij->i", own[i, a:b], y[j, a:b])
            keep = part + rest_x[k][at + i] * rest_y[k][j] >= threshold - SLACK
            i, j, part = i[keep], j[keep], part[keep]
        for s in range(0, len(i), 1 << 16):
            yield at + i[s : s + (1 << 16)], j[s : s + (1 << 16)]


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int | None = None, exact: bool = True) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each vector.

    exact: compare every two tiles, whatever the size: no link is lost.  Otherwise a pair near the threshold is
    missed with a chance of 1 - RECALL at most, as estimated from the vectors themselves; if
    the layouts cannot promise that, every two tiles are compared too.  An empty table gives
    an empty one; other columns are not read.

    Vectors that are null or zero, or hold null, NaN or infinite components link with
    nothing; nor do rows without an id, whose component is null and which are kept.  Vectors
    link with those of their own length, however few these are.  Rows with one id are
    vectors of their own.  Very long vectors make small tiles.  Cosines are those of the
    components given, in double precision.  tile: vectors of a tile, by TILE_VALUES if not given.
    """
    narrow = dict(rows.dtypes)[vector_col] == "array<float>"  # exact as such, and half as long on its way
    vector = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    good = F.col("vec_id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    # Equal vectors are known by two digests, so that vectors themselves are shuffled once.
    given = given.select("vec_id", "v", *(F.when(good, F.xxhash64(F.lit(k), "v")).alias(c) for k, c in enumerate("pq")))
    equal = given.where("p IS NOT NULL").groupBy("p", "q").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes, _ = stored(equal)
    sizes = nodes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # a row for each length
    if not sizes:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    result = None
    for r in sizes:
        of_size = nodes if len(sizes) == 1 else nodes.where(F.size("v") == r.d)
        part = linked(of_size, r.d, r["count"], threshold, tile or max(2, TILE_VALUES // r.d), narrow, exact)
        result = part if result is None else result.unionByName(part)
    out = join_skewed(given.drop("v"), result, ["p", "q"], "copies", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component, so that squares neither overflow nor vanish."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def principal_axes(nodes: DataFrame, d: int) -> np.ndarray:
    """Axes as columns, largest first; of very long vectors the places of their components, largest first.

    A task sends one matrix of d * d sums (or d of them), whatever its rows.
    """
    whole = d <= MOST_AXES

    def total(batches):
        m = np.zeros((d, d) if whole else d)
        for batch in batches:
            u = unit(np.asarray(batch.column(0).flatten()).reshape(-1, d))
            m += u.T @ u if whole else (u * u).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.size)), pa.array(m.reshape(-1))], ["i", "x"])

    sums = np.zeros(d * d if whole else d)
    for r in nodes.select("v").mapInArrow(total, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[r.i] = r.x
    if not whole:
        return np.argsort(-sums, kind="stable")
    matrix = sums.reshape(d, d)
    return np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1].copy()


def turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return x @ axes if axes.ndim == 2 else x[:, axes]


def linked(nodes: DataFrame, d: int, count: int, threshold: float, tile: int, narrow: bool = False, exact: bool = True) -> DataFrame:
    """``p, q, copies, n, c``: each node of length d, its links and the smallest node it is connected with.

    narrow: components are exact as 32-bit floats, and travel as such.
    """
    if count == 1:
        return nodes.select("p", "q", "copies", (F.col("copies") - 1).alias("n"), F.col("node").alias("c"))
    axes, kind = principal_axes(nodes, d), "<f4" if narrow else "<f8"
    bits = 0 if exact else max(0, math.ceil(math.log2(count / tile)))
    points = np.zeros((1, d))
    if bits:
        picked = nodes.select("v").orderBy(F.xxhash64("node")).limit(SAMPLE).toArrow()["v"].combine_chunks()
        points = turned(unit(np.asarray(picked.flatten()).reshape(-1, d)), axes)
    layouts = Layouts(points, bits, threshold)
    if layouts.estimate < RECALL:  # the only cell of a layout without cuts has all nodes
        layouts = Layouts(points, 0, threshold)
    held = nodes.sparkSession.sparkContext.broadcast((axes, layouts))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        axes, layouts = held.value
        v = np.asarray(batch.column(0).flatten()).reshape(-1, d)
        keys = layouts.keys(turned(unit(v), axes))
        cells = (np.arange(keys.shape[1], dtype=np.int64) << 40 | keys).tolist()
        raw = [x.tobytes() for x in v.astype(kind)]
        return pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(raw, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["node", "copies", "x", "keys", "cells"]
        )

    dealt, drop = stored(in_arrow(nodes.select("v", "node", "copies"), deal, "node long, copies long, x binary, keys binary, cells array<long>"))
    # Cells of more than two tiles: at most layouts * rows / tile / 2 of them, in fact few.
    large = dealt.select(F.explode("cells").alias("cell")).groupBy("cell").count().where(F.col("count") > 2 * tile).select("cell", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    each = dealt.select("node", "copies", "x", "keys", F.explode("cells").alias("cell"))
    if not large.isEmpty():
        each = each.join(large, "cell", "left")
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        others = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
        each = each.withColumn("part", F.coalesce(part, F.lit(0))).withColumn("other", F.explode(others))
        each = each.select("node", "copies", "x", "keys", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    else:
        each = each.select("*", *(F.lit(0).alias(c) for c in ("i", "j", "side")))

    def links(table: pa.Table) -> pa.Table:
        axes = held.value[0]
        layout = table["cell"][0].as_py() >> 40
        side, node, copies = table["side"].to_numpy(), table["node"].to_numpy(), table["copies"].to_numpy()
        given = np.frombuffer(b"".join(table["x"].to_pylist()), kind).reshape(-1, d).astype(np.float64)
        x = unit(given)
        y = turned(x, axes)
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), "<i4").reshape(len(node), -1)[:, :layout]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = table["i"][0].as_py() == table["j"][0].as_py()
        if same:
            right = left
        parent, count = np.arange(len(node)), np.zeros(len(node), np.int64)
        for i, j in compare(y[left], y[right], threshold, same):
            i, j = left[i], right[j]
            sure = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[sure], j[sure]
            if layout:  # pairs that an earlier layout has brought together are counted there
                new = ~(keys[i] == keys[j]).any(1)
                i, j = i[new], j[new]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            parent = roots(len(node), i, j, parent)
        used = np.flatnonzero(count)
        return pa.table({"node": node[used], "root": node[parent[used]], "links": count[used]})

    found, drop_found = stored(each.groupBy("cell", "i", "j").applyInArrow(links, "node long, root long, links long"))
    drop()
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    result, _ = stored(nodes.drop("v").join(sums, "node", "left").join(of, "node", "left").select(
        "p", "q", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c")
    ))
    drop_found()
    return result
