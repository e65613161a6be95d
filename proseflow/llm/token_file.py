"""Operator 5: token ids as canonical length-limited Huffman code in a file format of its own.

A file set is a folder with two tables.  ``codebook``: one row, the code length of every id
(lengths alone define a canonical code).  ``shards``: a row for some 2^18 ids of whole
documents, in ascending order of document id, with

    start         ids in all shards before it
    doc_ids       the documents, in order
    n_tokens      ids of each, with its end id
    checkpoints   unsigned 32-bit bit offsets, one for every block of 256 ids
    bits          the code, most significant bit first

A block decodes without those before it, so a reader may start at any checkpoint, and all
blocks of a batch are decoded in step by table look-up.  The tables are Parquet, so any
file system that Spark writes to will do, with its commit protocol.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseflow.llm.bpe import encoder
from proseflow.llm.common import in_arrow, run_dir, stored

SHARD = 1 << 18
BLOCK = 256
#: Longest code word; the decoding table has 2^MAX_BITS entries.
MAX_BITS = 16


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most ``most`` bits (package-merge); 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need more than {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves) + 1, np.int64)
    for mask in reversed(is_leaf):
        n = int(mask[:take].sum())
        depth[0] += 1
        depth[n] -= 1
        take = 2 * (take - n)
    lengths[used] = np.cumsum(depth)[:-1]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words of the canonical code: ascending by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    if len(used):
        step = 1 << (int(lengths.max()) - lengths[used].astype(np.int64))
        at = np.concatenate([[0], np.cumsum(step)[:-1]])
        codes[used] = at >> (int(lengths.max()) - lengths[used].astype(np.int64))
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, bytes]:
    """Checkpoints and bits of ``ids``."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ids) else 0
    wide = codes[ids].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)
    words = np.zeros(total // 32 + 2, np.uint64)
    place = at >> 5
    first = np.flatnonzero(np.diff(place, prepend=-1)) if len(ids) else np.zeros(0, np.int64)
    if len(ids):  # bits of different ids do not meet, so a sum is a union
        words[place[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        words[place[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return at[::block].astype("<u4").tobytes(), words.astype(">u4").tobytes()[: (total + 7) // 8]


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and length by the next ``max_bits`` bits, 16 at most."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used].astype(np.int64)
    symbols, bits = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    filled = np.repeat(used, 1 << (max_bits - n))
    symbols[: len(filled)] = filled
    bits[: len(filled)] = np.repeat(n, 1 << (max_bits - n))
    return symbols, bits


def unpack_bits(shards: list[tuple[int, bytes, bytes]], tables: tuple[np.ndarray, np.ndarray], block: int = BLOCK) -> list[np.ndarray]:
    """Ids of shards given as (number of ids, checkpoints, bits); all their blocks go in step."""
    symbols, bits = tables
    skip = 16 - (len(symbols).bit_length() - 1)
    data, starts, sizes, base = [], [], [], 0
    for n, checkpoints, raw in shards:
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        starts.append(at + 8 * base)
        sizes.append(np.minimum(block, n - block * np.arange(len(at))))
        data.append(np.frombuffer(raw, np.uint8))
        base += len(raw)
    b = np.concatenate([*data, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    at, size = np.concatenate(starts), np.concatenate(sizes)
    out = np.zeros((len(at), block), np.uint32)
    # Full blocks stay in step; those that end early read zeros past their end, cut off below.
    last = len(window) - 1
    for k in range(int(size.max(initial=0))):
        peek = window[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
        peek >>= skip
        out[:, k] = symbols[peek]
        at += bits[peek]
    result, row = [], 0
    for n, checkpoints, _ in shards:
        k = len(checkpoints) // 4
        result.append(out[row : row + k].reshape(-1)[:n])
        row += k
    return result


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``docs`` by ``tokenizer`` and writes the file set to ``path``.

    A null text counts as empty: its document is its end id alone.  Null ids come first;
    rows with one id stay beside each other, in any order.  No rows: no shards.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    enc = encoder(tokenizer)
    size = max([end_id, *enc.vocab.values(), *enc.special.values()]) + 1
    narrow = "<u2" if size <= 1 << 16 else "<u4"

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        base, ids, parts = 0, [], []
        names = ["part", "base", "doc_ids", "n_tokens", "ids"]

        def row() -> pa.RecordBatch:
            n = [len(x) // 4 for x in parts]
            arrays = [pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([np.frombuffer(b"".join(parts), "<u4").astype(narrow).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names)

        size = 0
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), enc.many(x.as_py() for x in batch.column(1)), strict=True):
                ids.append(doc_id)
                parts.append(own + end)
                size += len(parts[-1]) // 4
                if size >= SHARD:
                    yield row()
                    base, size, ids, parts = base + size, 0, [], []
        if ids:
            yield row()

    raw, drop = stored(ordered.mapInArrow(tokens, "part int, base long, doc_ids array<long>, n_tokens array<long>, ids binary"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(size, np.int64)
        for x in batch.column(0):
            total += np.bincount(np.frombuffer(x.as_buffer(), narrow), minlength=size)
        used = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])

    # As many rows as the vocabulary has ids, whatever the input.
    counts = np.zeros(size, np.int64)
    for r in in_arrow(raw.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    # As many rows as there were partitions.
    totals = dict(raw.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x))).collect())
    before, total = {}, 0
    for part in sorted(totals):
        before[part], total = total, total + totals[part]
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((lengths, codes, before))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, codes, before = held.value
        made = [pack_bits(np.frombuffer(x.as_buffer(), narrow), lengths, codes) for x in batch.column(4)]
        start = [before[p] + b for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        arrays = [pa.array(start, pa.int64()), batch.column(2), batch.column(3), pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["start", "doc_ids", "n_tokens", "checkpoints", "bits"])

    shards = in_arrow(raw, encode, "start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, bits binary")
    shards.write.option("compression", "uncompressed").parquet(f"{path}/shards")
    book = spark.createDataFrame([(MAX_BITS, BLOCK, bytearray(lengths.tobytes()))], "max_bits int, block int, lengths binary")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    drop()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of a file set: doc_id, start, n_tokens, ids (unsigned 32-bit, little-endian)."""
    book = spark.read.parquet(f"{path}/codebook").head()
    held = spark.sparkContext.broadcast((np.frombuffer(bytes(book.lengths), np.uint8), book.max_bits, book.block))

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, max_bits, block = held.value
        tables = decoding_table(lengths, max_bits)
        doc_ids, starts, counts, out = [], [], [], []
        rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        rows = [(start, ids, n, c, b) for start, ids, n, c, b in rows]
        for (start, ids, n, _, _), x in zip(rows, unpack_bits([(sum(n), c, b) for _, _, n, c, b in rows], tables, block), strict=True):
            ends = np.cumsum(n)
            doc_ids += ids
            counts += n
            starts += (start + ends - n).tolist()
            raw = x.astype("<u4").tobytes()
            out += [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n, strict=True)]
        arrays = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])

    schema = "start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, bits binary"
    return in_arrow(spark.read.schema(schema).parquet(f"{path}/shards"), decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes the file set (by default to a new folder, which goes with the other tables of the run) and reads it back."""
    spark = docs.sparkSession
    path = path or f"{run_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
