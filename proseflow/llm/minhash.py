"""Operator 1: near-duplicate documents by MinHash bands, odd sketches and full sets.

1. A pass over the texts makes, for each document, MinHash values (in bands), an odd sketch
   of them, and a digest of its shingle set.  Documents with equal sets are one node.
2. Nodes that agree in a band share a bucket.  In each bucket all meet its leader, by odd
   sketch: those that may be near it are tied to it, the rest go on with a leader of their
   own, and what is left after some rounds is tied to its leader whatever the sketches say.
   No pairs are listed.  Ties make clusters, wide enough that similar documents share one:
   they agree in some eight bands, and only leaders near the bound can part them.
3. Inside a cluster the pairs are candidates.  Odd sketches verify them at the bound: the
   population count of the XOR says how many samples differ, and a pair beyond DEVIATIONS of
   what the bound allows is dropped.  What is left is decided on full sets, from one document
   to those not yet reached, so that a group of copies takes one comparison a document.
4. Small clusters share tasks.  A large one is cut into tiles, each with the same few leaders.
   After that only documents that are not connected with the cluster's largest group meet the
   other tiles.  A task returns a spanning forest of its links, never the links themselves.

With ``rows`` values in each of ``bands`` bands, two documents of similarity s share no
bucket with chance ``(1 - s^rows)^bands``, less above it.  The bands follow from the
threshold, so that this is at most 3e-5 there: 22 of 6 at 0.85, 35 of 6 at 0.80.  A sketch
drops a pair at the bound with chance 1e-7, about.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.llm.common import components, in_arrow, join_skewed, stored
from proseflow.llm.words import PLACES, mixed, windows, word_hashes

#: Most chance that two documents at the threshold share no bucket, and values in a band, at most.
MISSED, ROWS = 3e-5, 6
SKETCH_BITS = 256
#: Values that the sketch is made of, at most: more would leave unlike sets no further apart.
SKETCHED = 132
#: Sketches that tell of this similarity at least tie a member to its leader; after so many rounds any do.
TIED, ROUNDS = 0.4, 5
#: Standard deviations that the sketches of a linked pair may be further apart than the bound says.
DEVIATIONS = 5.5
#: Documents of a large cluster that every tile has.
LEADERS = 4
#: Most documents and shingles of a tile, about; two tiles are a task.
TILE, TILE_SHINGLES = 1024, 400_000
#: Bits of the filter of documents whose texts are asked for, a document of a cluster and at most (16 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 27
_CHUNK = 4096

_RANDOM = np.random.default_rng(7)
_A = (_RANDOM.integers(0, 1 << 31, 4096, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, 4096, dtype=np.uint32)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of ``words``-word shingles; of fewer words, the whole sequence as one."""
    hashes = word_hashes((text or "").encode(errors="replace").lower())
    return np.unique(windows(hashes, words if len(hashes) >= words else max(len(hashes), 1)))


def banding(threshold: int) -> tuple[int, int]:
    """Bands and rows for documents that link at ``threshold`` percent."""
    for rows in range(ROWS, 0, -1):
        s = min(max(threshold, 1), 100) / 100
        bands = math.ceil(math.log(MISSED) / math.log1p(-(s**rows))) if s < 1 else 1
        if bands * rows <= len(_A):
            break
    return bands, rows


def signature(shingles: np.ndarray, bands: int, rows: int) -> tuple[list[int], list[int], tuple[int, int]]:
    """Band keys, odd sketch (as 64-bit words) and digest of a non-empty set."""
    k = bands * rows
    values = np.full(k, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _CHUNK):
        np.minimum(values, (short[None, at : at + _CHUNK] * _A[:k, None] + _B[:k, None]).min(1), out=values)
    wide = mixed(values.astype(np.uint64) << np.uint64(16) | np.arange(k, dtype=np.uint64))
    keys = mixed((wide.reshape(bands, rows) * PLACES[:rows]).sum(1, dtype=np.uint64)).view(np.int64).tolist()
    odd = np.bincount((wide[:SKETCHED] >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    sketch = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
    spread = mixed(shingles * PLACES[30])
    digest = int(spread.sum(dtype=np.uint64).view(np.int64)), int(mixed(spread * PLACES[31]).sum(dtype=np.uint64).view(np.int64))
    return keys, sketch, digest


def odd_bits(similarity: float, samples: int, bits: int = SKETCH_BITS) -> int:
    """How many bits of two sketches differ on average.

    Samples of sets differ in ``2 * samples * (1 - similarity)`` elements; d elements, folded
    into n bits, leave ``n / 2 * (1 - exp(-2 d / n))`` of them odd.
    """
    return round(bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits)))


def bits_allowed(threshold: int, samples: int) -> int:
    """Most bits in which the sketches of two documents at the threshold differ, but for chance."""
    s, bits = threshold / 100, SKETCH_BITS
    spread = 2 * math.sqrt(samples * s * (1 - s)) * math.exp(-4 * samples * (1 - s) / bits)
    folded = bits / 4 * (1 - math.exp(-8 * samples * (1 - s) / bits))
    return math.ceil(odd_bits(s, samples) + DEVIATIONS * math.sqrt(spread**2 + folded))


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: int = 80, bands: int | None = None, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``; documents link at ``100 * |A n B| >= threshold * |A u B|``.

    A document without words, or with a null text, has an empty set and links with nothing.
    Nor does a row without an id, whose ``component_id`` is null and which is kept.  Rows with
    one id are one node.  Whole texts count, however long.  Words are compared with A-Z in
    lower case.  Other columns of ``docs`` are not read.  bands, rows: by ``banding`` if not given.
    """
    if bands is None or rows is None:
        bands, rows = banding(threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(text, words)
            keys, sketch, digest = signature(shingles, bands, rows) if len(shingles) else (None, None, (None, None))
            out.append((len(shingles), *digest, keys, sketch))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n", "s", "t", "bands", "sketch"])

    signed, _ = stored(in_arrow(texts, sign, "doc_id long, n long, s long, t long, bands array<long>, sketch array<long>"))
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    nodes, drop_nodes = stored(usable.groupBy("s", "t").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    firsts = usable.join(nodes.select("s", "t", F.col("node").alias("doc_id")), ["s", "t", "doc_id"], "left_semi").dropDuplicates(["doc_id", "s", "t"])
    sketches, drop_sketches = stored(firsts.select(F.col("doc_id").alias("node"), "n", "sketch", "bands"))
    samples = min(bands * rows, SKETCHED)
    clusters, drop_clusters = stored(components(ties_of(sketches, odd_bits(TIED, samples))))
    links = confirm(clusters, sketches.select("node", "n", "sketch"), texts, words, threshold, bits_allowed(threshold, samples))
    of, drop_of = stored(components(links))
    placed, _ = stored(nodes.join(of, "node", "left").select("s", "t", "copies", F.coalesce("component", "node").alias("component")))
    for drop in (drop_nodes, drop_sketches, drop_clusters, drop_of):
        drop()
    met = join_skewed(signed.select("doc_id", "n", "s", "t"), placed, ["s", "t"], "copies", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return met.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def ties_of(sketches: DataFrame, tied: int) -> DataFrame:
    """``a, b``: nodes of ``sketches(node, sketch, bands)`` and the leaders of their buckets that they are tied to."""
    words64 = [F.col("sketch")[k].alias(f"x{k}") for k in range(SKETCH_BITS // 64)]
    found = sketches.select("node", *words64, F.explode("bands").alias("key"))
    shared, drop_shared = stored(found.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"))
    members, drop = stored(found.join(shared, "key", "left_semi"))
    drop_shared()
    differ = sum(F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"lead.x{k}"))) for k in range(SKETCH_BITS // 64))
    ties = None
    for last in [False] * (ROUNDS - 1) + [True]:
        lead = F.min(F.struct("node", *(f"x{k}" for k in range(SKETCH_BITS // 64)))).alias("lead")
        leaders, drop_leaders = stored(members.groupBy("key").agg(lead, F.count("*").alias("size")))
        met = join_skewed(members, leaders, ["key"], "size").where(F.col("node") != F.col("lead.node"))
        met, drop_met = stored(met.select("key", "node", *(f"x{k}" for k in range(SKETCH_BITS // 64)), F.col("lead.node").alias("leader"), (differ <= tied).alias("near")))
        drop()
        drop_leaders()
        new = met.select(F.col("node").alias("a"), F.col("leader").alias("b"), "near").where("near" if not last else "true").drop("near").distinct()
        ties = new if ties is None else ties.unionByName(new)
        members, drop = met.where("NOT near").drop("leader", "near"), lambda: None
        if last or members.isEmpty():
            return ties


def confirm(clusters: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, threshold: int, allowed: int) -> DataFrame:
    """A spanning forest (a, b) of the links within ``clusters(node, component)``; ``sizes(node, n, sketch)``."""
    sized, _ = stored(clusters.join(sizes, "node"))
    tiles = F.least(F.count("*"), F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES))).cast("int")
    leads = [F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(LEADERS)]
    cut, _ = stored(sized.groupBy("component").agg(tiles.alias("tiles"), F.count("*").alias("members"), F.array_distinct(F.array(*leads)).alias("leads")))
    total, n_sized = sized.agg(F.sum("n"), F.count("*")).head()
    total = total or 0
    bundles = max(1, math.ceil(total / TILE_SHINGLES))
    placed = join_skewed(sized, cut.drop("leads"), ["component"], "members")
    own = ["node", "component", "sketch"]
    none, zero = F.lit(None).cast("long").alias("cell"), F.lit(0).alias("side")
    bundled = placed.where("tiles = 1").select(*own, none, F.pmod(F.xxhash64("component"), F.lit(bundles)).cast("int").alias("i"), F.lit(-1).alias("j"), zero)
    large = placed.where("tiles > 1").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    cell = F.col("component").alias("cell")
    tiled = large.select(*own, cell, F.col("tile").alias("i"), F.lit(-1).alias("j"), zero)
    leaders = cut.where("tiles > 1").select("component", "tiles", F.explode("leads").alias("node")).join(sizes, "node")
    leaders = leaders.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i")).where(F.pmod(F.xxhash64("node"), F.col("tiles")) != F.col("i"))
    leaders = leaders.select(*own, cell, "i", F.lit(-1).alias("j"), zero)

    def links(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(np.asarray(table["component"]), kind="stable"))
        cluster = np.asarray(table["component"])
        node, side, text = np.asarray(table["node"]), np.asarray(table["side"]), table["text"]
        sketch = np.asarray(table["sketch"].combine_chunks().flatten()).reshape(len(node), -1).view(np.uint64)
        cuts = np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), len(cluster)).tolist()
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            sets = [shingle_set(text[k].as_py(), words) for k in range(s, e)]
            root = linked(sets, sketch[s:e], side[s:e], threshold, allowed)
            found = np.flatnonzero(root != np.arange(e - s))
            a.append(node[s + found])
            b.append(node[s + root[found]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    # Most documents are in no cluster: their texts are left out before the shuffle.
    sources = maybe_in(texts.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "node"), sized, n_sized)

    def decided(rows: DataFrame) -> DataFrame:
        rows = rows.join(sources, "node").select("cell", "i", "j", "component", "node", "side", "sketch", "text")
        return stored(rows.groupBy("cell", "i", "j").applyInArrow(links, "a long, b long"))[0]

    several = not cut.where("tiles > 1").isEmpty()
    first = decided(bundled.unionByName(tiled).unionByName(leaders) if several else bundled)
    if not several:
        return first
    # Documents of large clusters that are not connected with the largest group of theirs meet all others.
    group = F.coalesce("group", "node").alias("group")
    grouped = large.join(components(first).withColumnRenamed("component", "group"), "node", "left").select(*own, "n", "tile", "tiles", group)
    grouped, _ = stored(grouped)
    counted = grouped.groupBy("component", "group").agg(F.count("*").alias("k"))
    biggest, _ = stored(counted.groupBy("component").agg(F.max_by("group", F.struct("k", "group")).alias("main"), F.sum("k").alias("members")))
    split, _ = stored(join_skewed(grouped, biggest, ["component"], "members").withColumn("open", F.col("group") != F.col("main")))
    left = split.where("open").groupBy("component").agg(F.least(F.count("*"), F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES))).cast("int").alias("open_tiles"))
    left, _ = stored(left)
    if left.isEmpty():
        return first
    split = join_skewed(split, left.join(biggest.select("component", "members"), "component").withColumnRenamed("members", "size"), ["component"], "size")
    opened = split.where("open").withColumn("u", F.pmod(F.xxhash64("node", F.lit(7)), F.col("open_tiles")).cast("int"))
    all_u, all_t = F.explode(F.sequence(F.lit(0), F.col("open_tiles") - 1)), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    meets = [
        split.where("NOT open").withColumn("i", all_u).select(*own, cell, "i", F.col("tile").alias("j"), F.lit(1).alias("side")),
        opened.withColumn("j", all_t).select(*own, cell, F.col("u").alias("i"), "j", zero),
    ]
    both = opened.withColumn("other", all_u)
    meets.append(both.select(*own, cell, F.least("u", "other").alias("i"), (F.col("tiles") + F.greatest("u", "other")).alias("j"), (F.col("u") > F.col("other")).cast("int").alias("side")))
    rows = meets[0].unionByName(meets[1]).unionByName(meets[2])
    return first.unionByName(decided(rows))


def maybe_in(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``rows`` without most of those whose ``node`` is not in ``wanted``, which has ``n`` rows; none that is in it goes.

    A bitmap of hashes, some FILTER_BITS for each of ``wanted`` and MOST_BITS at most, is broadcast in pieces of 32,768.
    """
    bits = min(MOST_BITS, 1 << max(15, math.ceil(math.log2(max(n, 1) * FILTER_BITS))))
    place = F.pmod(F.xxhash64("node"), F.lit(bits))
    piece, at = F.bitmap_bucket_number(place).alias("__piece"), F.bitmap_bit_position(place)
    bitmap = wanted.groupBy(piece).agg(F.bitmap_construct_agg(at).alias("__bitmap"))
    found = rows.withColumn("__piece", piece).join(F.broadcast(bitmap), "__piece")
    byte = F.conv(F.hex(F.substring("__bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*rows.columns)


def linked(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, threshold: int, allowed: int) -> np.ndarray:
    """For each set the first one that links connect it with, or itself.  Sets of both sides, or of one, meet.

    A pair is compared if its sketches differ in ``allowed`` bits at most, its sizes permit a
    link, and it is not connected already.
    """
    m = len(sets)
    n = np.array([len(x) for x in sets], np.int64)
    root, open_ = np.arange(m), np.ones(m, bool)
    two = side.any()
    for seed in range(m):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        while queue:
            u = queue.pop()
            near = open_ & (100 * np.minimum(n, n[u]) >= threshold * np.maximum(n, n[u]))
            if two:  # pairs within a tile are another task's
                near &= side != side[u]
            others = np.flatnonzero(near)
            others = others[np.bitwise_count(sketches[others] ^ sketches[u]).sum(1) <= allowed]
            if not len(others):
                continue
            both = shared_with(sets[u], [sets[k] for k in others])
            own = others[(both > 0) & (100 * both >= threshold * (n[u] + n[others] - both))]
            open_[own] = False
            root[own] = seed
            queue += own.tolist()
    return root


def shared_with(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of ``own`` each of the other sets has; all are sorted and without repeats."""
    every = np.concatenate(others)
    at = np.searchsorted(own, every)
    hit = own[np.minimum(at, len(own) - 1)] == every
    return np.add.reduceat(hit, np.append(0, np.cumsum([len(x) for x in others])[:-1]), dtype=np.int64)
