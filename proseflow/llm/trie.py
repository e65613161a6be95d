"""Operator 11: prefix tries of conversations, succinct and in level order.

A node is a distinct sequence of first turns.  No task can hold the trie of all conversations:

1. Each turn gets the digest of its prefix.  A conversation of any length is read in blocks
   of turns, so no window holds more than a block of it.
2. Nodes are grouped by digest.  A node of one conversation needs no trie: its values are
   known.  Nodes in a row with the same members make a chain, told by smallest member and
   number of members; inside it values follow from running lengths.
3. Chains are cut into shards, the subtrees under at most SHARD members.  Shards are packed
   into tasks, where numpy builds a LOUDS bit vector and the label array in level order;
   parents are read from the bits, and totals are added up in reverse level order.
4. The heavy upper levels are merged apart: the totals of shards are summed by parent in
   Spark, and the chains above them are shards of the next tier, with STEP times the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseflow.llm.common import join_skewed, stored

#: Turns of a conversation that a window takes at once.
BLOCK = 1024
#: Members of the chains of a shard in the first tier, and how many times more in each further one.
SHARD, STEP = 4096, 1024
#: Chains that a task takes, about.
TASK_CHAINS = 100_000
#: Characters of joined ids that go as one row.
CHUNK = 1_000_000

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, pos, t1, t2, size``: place from 1, digest of role and text, code points of the text.

    Turns are ordered by ``turn``, null first; rows of one turn by their digest, and repeated
    rows are turns of their own.  Null roles and texts are empty.  Rows without ``conv_id``
    belong to no conversation.  Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce(F.floor(turn / block), F.lit(-(1 << 62))).cast("long").alias("block"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.length(text).cast("long").alias("size"),
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("conv_id", "block").count().select("conv_id", "block", F.sum("count").over(before).alias("offset")).where("offset > 0")
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "t1", "t2"))
    placed = rows.withColumn("place", place).join(offsets, ["conv_id", "block"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("offset", F.lit(0))).cast("long").alias("pos"), "t1", "t2", "size")


def with_shared_heads(turns: DataFrame, base: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns are replaced by those of conversation ``base``.

    base and head: functions of ``conv_id``; head is at most ``longest``.  All turns of base
    are taken if it has fewer, none if there is no such conversation.  Returns ``conv_id,
    depth, total, t1, t2, size`` by turn, and ``conv_id, total`` by conversation.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"base": base.cast("long"), "h": head.cast("int")})
    heads = turns.where(F.col("pos") <= longest).join(convs.select(F.col("base").alias("conv_id")).distinct(), "conv_id", "left_semi")
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "size"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h")))
    convs = convs.select("conv_id", "n", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("total"))
    convs, _ = stored(convs)
    own = turns.where(F.col("pos") > head)
    own = join_skewed(own, convs.select("conv_id", "n", F.size("head").alias("m"), "total"), ["conv_id"], "n")
    own = own.select("conv_id", (F.col("pos") - head + F.col("m")).cast("long").alias("depth"), "total", "t1", "t2", "size")
    first = convs.select("conv_id", "total", F.inline("head"))
    return own.unionByName(first.select("conv_id", F.col("pos").alias("depth"), "total", "t1", "t2", "size")), convs.select("conv_id", "total")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, depth, total, size, cum, p1, p2, q1, q2``: digests of the turns up to this one and up to the one before, and running length.

    A digest is the exclusive or of hashes of turns with their depths.
    """
    turns = turns.select(
        "conv_id", "depth", "total", "size", F.floor(F.col("depth") / block).cast("long").alias("block"),
        F.xxhash64("t1", "t2", "depth").alias("x1"), F.xxhash64("depth", "t2", "t1", F.lit(7)).alias("x2"),
    )
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"x1": F.bit_xor, "x2": F.bit_xor, "size": F.sum}
    blocks = turns.where(F.col("total") >= block).groupBy("conv_id", "block").agg(*(f(c).alias(c) for c, f in sums.items()))
    blocks = blocks.select("conv_id", "block", *(f(c).over(before).alias(f"b_{c}") for c, f in sums.items())).where("b_size IS NOT NULL")
    rows = turns.withColumns({f"w_{c}": f(c).over(within) for c, f in sums.items()}).join(blocks, ["conv_id", "block"], "left")

    def whole(c: str) -> Column:
        return F.col(f"w_{c}").bitwiseXOR(F.coalesce(f"b_{c}", F.lit(0)))

    p1, p2 = whole("x1"), whole("x2")
    return rows.select(
        "conv_id", "depth", "total", "size", (F.col("w_size") + F.coalesce("b_size", F.lit(0))).alias("cum"),
        p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("x1")).alias("q1"), p2.bitwiseXOR(F.col("x2")).alias("q2"),
    )


class Louds:
    """A forest in level order: under one root more, each node has its children as ones, then a zero.

    ``order`` gives the given index of each node in level order, ``labels`` its label, and
    ``levels`` where each level begins.  Children stand by label.
    """

    def __init__(self, parent: np.ndarray, labels: np.ndarray) -> None:
        n = len(parent)
        by_parent = np.lexsort((labels, parent))
        first = np.searchsorted(parent[by_parent], np.arange(-1, n + 1))
        level, levels, order, degrees = by_parent[: first[1]], [0], [], [np.array([first[1]])]
        while len(level):
            order.append(level)
            levels.append(levels[-1] + len(level))
            degree = first[level + 2] - first[level + 1]
            degrees.append(degree)
            start = np.repeat(first[level + 1] - (np.cumsum(degree) - degree), degree)
            level = by_parent[start + np.arange(len(start))]
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.levels, self.labels = levels, labels[self.order]
        degree = np.concatenate(degrees)
        bits = np.ones(len(self.order) + len(degree), np.uint8)
        bits[np.cumsum(degree) + np.arange(len(degree))] = 0
        self.bits, self.size = np.packbits(bits), len(bits)

    def parents(self) -> np.ndarray:
        """The place in level order of each node's parent, -1 for the upper root: the zeros before the node's one."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.size))
        return ones - np.arange(len(ones)) - 1

    def rollup(self, *values: np.ndarray) -> list[np.ndarray]:
        """The sums over subtrees, for values in the order given."""
        up, out = self.parents(), []
        for v in values:
            total = v[self.order]
            for lo, hi in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
                np.add.at(total, up[lo:hi], total[lo:hi])
            back = np.empty_like(total)
            back[self.order] = total
            out.append(back)
        return out


_KEY = ["conv_id", "n_convs"]
_SOLVED = "conv_id long, n_convs long, up_conv long, up_n long, n_leaves long, saved long"


def solve(table: pa.Table) -> pa.Table:
    """Totals of the chains of whole shards; chains whose parent is not among them are tops."""
    columns = {c: np.asarray(table[c].fill_null(-1)) for c in ("conv_id", "n_convs", "up_conv", "up_n", "top", "n_leaves", "saved")}
    index = {k: i for i, k in enumerate(zip(columns["conv_id"].tolist(), columns["n_convs"].tolist(), strict=True))}
    parent = np.array([index.get(k, -1) for k in zip(columns["up_conv"].tolist(), columns["up_n"].tolist(), strict=True)], np.int64)
    n_leaves, saved = Louds(parent, columns["conv_id"]).rollup(columns["n_leaves"], columns["saved"])
    return pa.table({"conv_id": table["conv_id"], "n_convs": table["n_convs"], "up_conv": table["up_conv"], "up_n": table["up_n"], "n_leaves": n_leaves, "saved": saved})


def _shard_tops(chains: DataFrame, limit: int) -> DataFrame:
    """``conv_id, n_convs, r_conv, r_n``: the top of each chain's shard, by doubling pointers."""
    inner = F.col("up_n") <= limit
    links, drop = stored(chains.select(*_KEY, F.when(inner, F.col("up_conv")).otherwise(F.col("conv_id")).alias("r_conv"), F.when(inner, F.col("up_n")).otherwise(F.col("n_convs")).alias("r_n")))
    while True:
        up = links.select(F.col("conv_id").alias("r_conv"), F.col("n_convs").alias("r_n"), F.col("r_conv").alias("s_conv"), F.col("r_n").alias("s_n"))
        moved = (F.col("s_n") != F.col("r_n")) | (F.col("s_conv") != F.col("r_conv"))
        longer, drop_longer = stored(links.join(up, ["r_conv", "r_n"]).select(*_KEY, F.col("s_conv").alias("r_conv"), F.col("s_n").alias("r_n"), moved.alias("moved")))
        drop()
        links, drop = longer, drop_longer
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def totals(chains: DataFrame, shard: int = SHARD, step: int = STEP, task_chains: int = TASK_CHAINS) -> DataFrame:
    """``conv_id, n_convs, n_leaves, saved`` over the subtree of each chain; given are each chain's own.

    A stored table with ``up_conv, up_n``, the parent of a chain (null: none), as well.
    """
    limit, out, rest = shard, [], chains
    while True:
        light, heavy = rest.where(F.col("n_convs") <= limit), rest.where(F.col("n_convs") > limit)
        n = light.count()
        tasks = max(1, -(-n // task_chains))
        dealt = light.join(_shard_tops(light, limit), _KEY).withColumn("task", F.pmod(F.xxhash64("r_conv", "r_n"), F.lit(tasks)))
        solved, _ = stored(dealt.groupBy("task").applyInArrow(solve, _SOLVED))
        out.append(solved.select(*_KEY, "n_leaves", "saved"))
        if heavy.isEmpty():
            break
        tops = solved.where(F.col("up_n") > limit).groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs"))
        tops = tops.agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        heavy = heavy.join(tops, _KEY, "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))})
        rest, _ = stored(heavy.drop("l", "s"))
        limit *= step
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node, which come sorted, joined to pieces of some length."""
    key, first, ids, size = None, None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"p1": [key[0]], "p2": [key[1]], "first": [first], "ids": [",".join(ids)]})

    for batch in batches:
        for p1, p2, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if ids and ((p1, p2) != key or size > CHUNK):
                yield piece()
                ids, size = [], 0
            if not ids:
                key, first = (p1, p2), c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the pieces of one node, which come in order."""
    key, state = None, None
    for batch in batches:
        done: dict[str, list] = {"p1": [], "p2": [], "ends_sha256": []}

        def close(done: dict[str, list] = done) -> None:
            if state is not None:
                for c, v in zip(done, (*key, state.hexdigest()), strict=True):
                    done[c].append(v)

        for p1, p2, _, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (p1, p2) == key:
                state.update(b"," + ids.encode())
            else:
                close()
                key, state = (p1, p2), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())]))
    if state is not None:
        yield pa.RecordBatch.from_pydict({"p1": [key[0]], "p2": [key[1]], "ends_sha256": [state.hexdigest()]})


def ends_of(last: DataFrame) -> DataFrame:
    """``p1, p2, ends_sha256`` for rows of ``p1, p2, conv_id``: the digest of the ids in order, joined by commas.

    Sorted by range, so that a node at which very many end is spread over tasks; only its
    joined ids, some rows, go through one task, since SHA-256 runs in order.
    """
    pieces = last.repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id").mapInArrow(_joined, "p1 long, p2 long, first long, ids string")
    return pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(_hashed, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """One row for each distinct sequence of first turns of the conversations.

    turns: ``conv_id, depth`` (1 and up, no gap), ``total, t1, t2, size``; convs: ``conv_id,
    total``, where 0 is a conversation without turns, a member of the root alone.
    Conversations with equal turns are members of the same nodes.  An empty table has no
    node, not even the root.  Columns: those of ``op11_prefix_trie``, and p1, p2, the node's digest.
    """
    paths, _ = stored(prefixes(turns, block))
    nodes = paths.groupBy("depth", "p1", "p2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *(F.any_value(c).alias(c) for c in ("q1", "q2", "size", "cum")), F.max("total").alias("total")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("total").alias("total")).where("n_convs > 0")
    root = root.withColumns({c: zero for c in ("depth", "p1", "p2", "size", "cum")}).withColumns({c: F.lit(None).cast("long") for c in ("q1", "q2")})
    nodes, _ = stored(nodes.unionByName(root))
    several = nodes.where("n_convs > 1").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"))
    linked, _ = stored(join_skewed(nodes, several, ["q1", "q2"], "up_n", "left"))

    top = F.col("up_n").isNull() | (F.col("up_n") != F.col("n_convs"))
    many = linked.where("n_convs > 1")
    chains = many.groupBy(*_KEY).agg(
        F.max("depth").alias("bottom"), (F.max("depth") - F.min("depth")).alias("length"), F.max("cum").alias("cum"), F.min(F.col("cum") - F.col("size")).alias("above"),
        F.max(F.when(top, F.col("up_conv"))).alias("up_conv"), F.max(F.when(top, F.col("up_n"))).alias("up_n"),
    )
    below = linked.where(top & F.col("up_n").isNotNull()).groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs"))
    below = below.agg(F.count("*").alias("below"), F.count_if(F.col("n_convs") == 1).alias("single"))
    chains = chains.join(below, _KEY, "left").fillna(0, ["below", "single"])
    chains = chains.withColumns({
        "n_leaves": F.col("single") + (F.col("below") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * (F.col("cum") - F.col("above")), "top": zero,
    })
    chains, _ = stored(chains)
    found = totals(chains.select(*_KEY, "up_conv", "up_n", "top", "n_leaves", "saved"), shard, step)
    known, _ = stored(chains.select(*_KEY, "bottom", "length", "above", "below").join(found, _KEY))

    up = F.when(F.col("depth") > 0, F.coalesce("up_conv", "conv_id")).alias("parent_conv_id")
    inside = F.col("depth") < F.col("bottom")
    last = paths.where("depth = total").select("p1", "p2", "conv_id").unionByName(convs.where("total = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id"))
    many = join_skewed(many, known, _KEY, "length").join(ends_of(last), ["p1", "p2"], "left").select(
        "conv_id", "depth", up, "n_convs", F.when(inside, F.lit(1)).otherwise(F.col("below")).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("cum") - F.col("size") - F.col("above"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "p1", "p2",
    )
    ends = F.when(F.col("depth") == F.col("total"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY_SHA)
    one = linked.where("n_convs = 1").select(
        "conv_id", "depth", up, "n_convs", (F.col("depth") < F.col("total")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        ends.alias("ends_sha256"), "p1", "p2",
    )
    return many.unionByName(one)


#: op11_prefix_trie: the first crc32(conv_id) mod 6 turns come from the conversation whose id is the next lower multiple of 100.
SHARED, HEADS = 100, 6


def rebuilt_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The trie of the conversations with heads shared in groups of SHARED."""
    turns, _ = stored(turns_of(conversations))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    rebuilt, convs = with_shared_heads(turns, F.col("conv_id") - F.col("conv_id") % SHARED, head, HEADS - 1)
    return prefix_trie(rebuilt, convs, **sizes)


ORACLE = r"""
WITH c0 AS (SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t, length(coalesce(text, '')) AS size,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                   lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM c0)),
heads AS (SELECT c.conv_id, b.pos AS depth, b.t, b.size FROM crc c JOIN c0 b ON b.conv_id = c.base AND b.pos <= c.h),
m AS (SELECT conv_id, count(*) AS m FROM heads GROUP BY conv_id),
r AS (SELECT * FROM heads UNION ALL
      SELECT o.conv_id, o.pos - c.h + coalesce(m.m, 0), o.t, o.size FROM c0 o JOIN crc c USING (conv_id) LEFT JOIN m USING (conv_id) WHERE o.pos > c.h),
p AS (SELECT conv_id, depth, size, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, max(depth) OVER (PARTITION BY conv_id) AS total FROM r
      UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT max(depth) FROM r WHERE r.conv_id = crc.conv_id), 0) FROM crc),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = total), '') AS ends FROM p GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, left(path, len(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.path = k.path),
sub AS (SELECT a.depth, a.path, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
        FROM full_ v JOIN p a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sub s ON f.depth = s.depth AND f.path = s.path
LEFT JOIN nodes u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.path = left(f.path, len(f.path) - 64)
"""
