"""Operator 8: removal of long byte strings that an earlier document has, by suffix arrays.

Suffixes must meet where they can be equal, but no task can hold the suffixes of the corpus:

1. Each window of ``length`` bytes is dealt to its anchor, the 24-byte string in it with the
   smallest hash.  Equal windows have equal anchors, and some 13 neighbouring windows share
   one, so a document falls into runs: an anchor and the bytes its windows span.
2. Runs meet by anchor, packed in blocks by the hash of the anchor.  Copies of a run are
   settled by the first document that has it: first within some megabytes of documents and by
   what the task remembers of earlier ones, so that a passage which many documents share
   arrives some few times from each task, then within the block.
3. Runs that differ but share an anchor may share some of their windows.  Their texts go by
   anchor to a suffix array, built by linear grouping (``suffixes``), in which the anchor, the
   same in all of them, is one symbol.  Windows that are equal stand side by side in it; all
   but those of the first document go.
4. An anchor with more than LARGE different runs is no task's burden: the windows of its runs
   meet by digest, with partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proseflow.llm.common import groups, in_arrow, stored
from proseflow.llm.suffixes import suffix_array
from proseflow.llm.words import PLACES

LENGTH = 50
ANCHOR = 24
#: Different runs of an anchor that one suffix array takes.
LARGE = 20_000
#: Bytes of text whose runs make a block, and runs that make a task of suffix arrays, about.
BLOCK_BYTES, BLOCK_RUNS = 4_000_000, 20_000
#: Longer texts are cut into overlapping slices.
SLICE = 1_000_000
#: Bytes of text whose runs are worked out at once, and whose runs leave a task together.
WORK_BYTES, SEND_BYTES = 1_000_000, 4_000_000
#: Runs that came more than once and that a task remembers, so that they leave it once only.
REMEMBERED = 200_000

_BYTES = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64)
#: A run on its way: document (place in its block's list), start, last window and anchor as distances.
RUN = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<u4"), ("start", "<i4"), ("span", "u1"), ("off", "u1")])
COLUMNS = "kind int, block int, doc_id long, row long, h long, a int, e int, off int, docs array<long>, rows array<long>, runs binary"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs_of(texts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """The runs of all texts together; ``doc`` is the text's index."""
    width = length - ANCHOR + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length or sizes.max() < length:
        return np.zeros(0, RUN)
    ends = np.cumsum(sizes)
    h = _BYTES[data]
    for k in range(4):  # hashes of 2, 4, 8 and 16 bytes
        d = 1 << k
        if k == 3:
            h8 = h
        h = _mix(h[:-d] * PLACES[k] + h[d:])
    h16 = h
    n = len(data) - ANCHOR + 1
    h = _mix(h16[:n] * PLACES[4] + h8[16 : 16 + n])
    # The place in the low bits: the leftmost of equal hashes is the smallest.
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    d = 1
    while 2 * d <= width:
        low = np.minimum(low[:-d], low[d:])
        d *= 2
    if width > d:
        low = np.minimum(low[: len(low) - (width - d)], low[width - d :])
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(doc[: len(low)] == doc[length - 1 :])
    anchor = (low[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc[at], prepend=-1) != 0))
    last = np.append(first[1:], len(at)) - 1
    a, e, p = at[first], at[last], anchor[first]

    def window(s: np.ndarray) -> np.ndarray:
        x = np.zeros(len(s), np.uint64)
        for k, d in enumerate([*range(0, length - 16, 16), length - 16]):
            x = _mix(x + h16[s + d] * PLACES[8 + k])
        return x

    out = np.empty(len(a), RUN)
    out["h"] = h[p]
    out["g"] = _mix(window(a) * PLACES[5] + window(e) + (e - a).astype(np.uint64))
    out["doc"] = doc[a]
    out["start"] = a - (ends - sizes)[doc[a]]
    out["span"], out["off"] = e - a, p - a
    return out


def intervals(docs: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows by document, those that touch merged; ``a`` ascending within equal ``docs``."""
    if not len(a):
        return docs, a, e
    new = np.append(True, (docs[1:] != docs[:-1]) | (a[1:] > e[:-1] + 1))
    first = np.flatnonzero(new)
    return docs[first], a[first], np.maximum.reduceat(e, first)


def _rows(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = dict(zip(NAMES, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.array(np.full(n, kind), k) if c == "kind" else pa.nulls(n, k) for c, k in kinds.items()], NAMES)


def repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by these keys, the last of which is the document; and in it, which runs an earlier document has too, and the first that does."""
    order = np.lexsort(keys[::-1])
    own = keys[-1][order]
    if not len(own):
        return order, np.zeros(0, bool), own
    new = np.append(True, np.zeros(len(own) - 1, bool))
    for k in keys[:-1]:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    first = own[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, own > first, first


def narrowed(strings: list[tuple[int, bytes, int, int]], length: int = LENGTH) -> list[tuple[int, int, bytes, int, int]]:
    """(string, bytes cut in front, bytes, windows after the first, place of the anchor) for the strings that can share a window.

    A window holds the anchor and, before or after it, half of its other bytes at least.  Where
    no other document has the same half on a side, no shared window reaches that far.
    """
    half = (length - ANCHOR + 1) // 2
    sides: tuple[dict, dict] = ({}, {})
    ends = []
    for doc, raw, _, off in strings:
        pair = raw[off - half : off] if off >= half else None, raw[off + ANCHOR : off + ANCHOR + half] if len(raw) >= off + ANCHOR + half else None
        ends.append(pair)
        for side, x in zip(sides, pair, strict=True):
            if x is not None and side.setdefault(x, doc) != doc:
                side[x] = None  # several documents
    out = []
    for k, ((_, raw, _, off), (x, y)) in enumerate(zip(strings, ends, strict=True)):
        low = 0 if x is not None and sides[0][x] is None else max(0, off - half + 1)
        high = len(raw) if y is not None and sides[1][y] is None else min(len(raw), off + ANCHOR + half - 1)
        if high - low >= length:
            out.append((k, low, raw[low:high], high - low - length, off - low))
    return out


def equal_windows(strings: list[tuple[int, bytes, int, int]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(string, first, last) for the windows that a string of an earlier document has too.

    strings: (document, bytes, windows after the first, place of the anchor) of one anchor.
    A window holds the anchor, so it is as many symbols as bytes that are not of the anchor, and one.
    """
    parts, starts, at = [], [], 0
    for _, raw, _, off in strings:
        text = raw.decode("latin-1")
        parts.append(text[:off] + "Ā" + text[off + ANCHOR :] + "ā")
        starts.append(at)
        at += len(parts[-1])
    text, width = "".join(parts), length - ANCHOR + 1
    owner = [-1] * len(text)
    for k, (s, (_, _, span, _)) in enumerate(zip(starts, strings, strict=True)):
        owner[s : s + span + 1] = [k] * (span + 1)
    found, same, last = [], [], None

    def close() -> None:
        if len(same) > 1:
            least = min(strings[owner[i]][0] for i in same)
            found.extend(i for i in same if strings[owner[i]][0] > least)

    for i in suffix_array(text):
        if owner[i] >= 0:
            window = text[i : i + width]
            if window != last:
                close()
                same, last = [], window
            same.append(i)
    close()
    out: list[tuple[int, int, int]] = []
    for i in sorted(found):
        k = owner[i]
        if out and out[-1][0] == k and out[-1][2] == i - starts[k] - 1:
            out[-1] = (k, out[-1][1], i - starts[k])
        else:
            out.append((k, i - starts[k], i - starts[k]))
    return out


def shared_windows(strings: list[tuple[int, bytes, int, int]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """As ``equal_windows``, which gets the narrowed strings, each different one once: that of its first document."""
    kept = narrowed(strings, length)
    same: dict[tuple[bytes, int], list[int]] = {}
    for n, (_, _, raw, _, off) in enumerate(kept):
        same.setdefault((raw, off), []).append(n)
    firsts = [min(ns, key=lambda n: strings[kept[n][0]][0]) for ns in same.values()]
    out = []
    for ns, f in zip(same.values(), firsts, strict=True):
        least = strings[kept[f][0]][0]
        out += [(kept[n][0], kept[n][1], kept[n][1] + kept[n][3]) for n in ns if strings[kept[n][0]][0] > least]
    if len(firsts) > 1:
        groups_ = list(same.values())
        for m, i, j in equal_windows([(strings[kept[f][0]][0], *kept[f][2:]) for f in firsts], length):
            least = strings[kept[firsts[m]][0]][0]
            out += [(kept[n][0], kept[n][1] + i, kept[n][1] + j) for n in groups_[m] if strings[kept[n][0]][0] == least]
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, characters: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: the ranges [start, end) of bytes removed, and the rest.

    carry: also ``rest``, a struct of the other columns of ``docs``.  characters: ranges
    shrink to whole characters, so that ``kept`` is valid UTF-8.

    A byte goes if it lies in a string of ``length`` bytes that also starts in a document
    with a smaller id, whatever is removed there.  A null text is empty.  Rows with one id
    do not remove each other; a row without an id neither removes nor loses anything.
    length: from 24, the size of an anchor, to 279.
    """
    if not ANCHOR <= length < ANCHOR + 256:
        raise ValueError(f"length {length} is not between {ANCHOR} and {ANCHOR + 255}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("raw"), F.struct(*(c for c in docs.columns if c != text_col)).alias("rest"))
    usable = texts.drop("rest").where("doc_id IS NOT NULL").where(F.octet_length("raw") >= length)
    total = usable.agg(F.sum(F.octet_length("raw"))).head()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))

    def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list, list]]:
        ids, rows, raws, bases = [], [], [], []
        for i, r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for at in range(0, max(1, len(raw) - length + 1), SLICE):
                ids.append(i)
                rows.append(r)
                raws.append(raw[at : at + SLICE + length - 1])
                bases.append(at)
        for s, e in groups([len(x) for x in raws], WORK_BYTES):
            yield ids[s:e], rows[s:e], raws[s:e], bases[s:e]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, least = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # remembered runs and the first documents that have them
        parts, all_ids, all_rows, size = [], [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal known, least
            x, ids, rows = np.concatenate(parts), np.array(all_ids), np.array(all_rows)
            key, own = _mix(x["h"] + x["g"] * PLACES[6]), ids[x["doc"]]
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                late = (known[at] == key) & (least[at] < own)
                yield settled(x[late], ids, rows)
                x, key, own = x[~late], key[~late], own[~late]
            order, gone, first = repeats(key, own)
            x, key = x[order], key[order]
            again, at = np.unique(key[gone], return_index=True)
            if len(again):
                first = first[gone][at]
                if len(known) + len(again) > REMEMBERED:
                    known, least = known[:0], least[:0]
                both, ids_of = np.concatenate([known, again[:REMEMBERED]]), np.concatenate([least, first[:REMEMBERED]])
                by = np.lexsort((ids_of, both))
                both, ids_of = both[by], ids_of[by]
                new = np.append(True, both[1:] != both[:-1])
                known, least = both[new], ids_of[new]
            yield settled(x[gone], ids, rows)
            x = x[~gone]
            block = (x["h"] >> np.uint64(20)) % np.uint64(blocks)
            order = np.lexsort((x["start"], x["doc"], block))
            x, block = x[order], block[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            for part, b in zip(np.split(x, cuts), block[np.append(0, cuts)] if len(x) else [], strict=False):
                used, part["doc"] = np.unique(part["doc"], return_inverse=True)
                yield _rows(1, block=[int(b)], docs=[ids[used]], rows=[rows[used]], runs=[b"".join(part[c].tobytes() for c in RUN.names)])

        for batch in batches:
            for ids, rows, raws, bases in batches_of(batch):
                x = runs_of(raws, length)
                x["start"] += np.array(bases, np.int32)[x["doc"]]
                x["doc"] += len(all_ids)
                parts.append(x)
                all_ids += ids
                all_rows += rows
                size += sum(map(len, raws))
                if size >= SEND_BYTES:
                    yield from send()
                    parts, all_ids, all_rows, size = [], [], [], 0
        if parts:
            yield from send()

    def settled(x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        x = x[np.lexsort((x["start"], x["doc"]))]
        doc, a, e = intervals(x["doc"], x["start"], x["start"] + x["span"])
        return _rows(0, block=(ids[doc] % blocks).astype(np.int32), doc_id=ids[doc], row=rows[doc], a=a, e=e)

    def meet(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table["kind"])
        out = [table.filter(pa.array(kinds == 0))]
        ids, rows, parts, base = [], [], [], 0
        for d, r, raw in zip(*(table.filter(pa.array(kinds == 1))[c].to_pylist() for c in ("docs", "rows", "runs")), strict=True):
            n, at = len(raw) // RUN.itemsize, 0
            x = np.empty(n, RUN)
            for c in RUN.names:
                k = RUN[c].itemsize * n
                x[c] = np.frombuffer(raw[at : at + k], RUN[c])
                at += k
            x["doc"] += base
            base += len(d)
            ids += d
            rows += r
            parts.append(x)
        if parts:
            ids, rows = np.array(ids), np.array(rows)
            x = np.concatenate(parts)
            order, gone, _ = repeats(x["h"], x["g"], ids[x["doc"]])
            x = x[order]
            out.append(settled(x[gone], ids, rows))
            x = x[~gone]
            new = np.append(True, x["h"][1:] != x["h"][:-1])
            group = np.cumsum(new) - 1
            n = np.bincount(group)[group]
            own = ids[x["doc"]]
            firsts = np.flatnonzero(new)
            several = (np.minimum.reduceat(own, firsts) != np.maximum.reduceat(own, firsts))[group]
            for kind, keep in ((2, several & (n <= LARGE)), (3, several & (n > LARGE))):
                y = x[keep]
                out.append(_rows(kind, doc_id=ids[y["doc"]], row=rows[y["doc"]], h=y["h"].view(np.int64), a=y["start"], e=y["start"] + y["span"], off=y["off"]))
        return pa.concat_tables([pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x.select(NAMES).cast(pa.schema([(c, f.type) for c, f in zip(NAMES, _rows(0, a=[]).schema, strict=True)])) for x in out])

    met, _ = stored(usable.mapInArrow(deal, COLUMNS).groupBy("block").applyInArrow(meet, COLUMNS).select("kind", "doc_id", "row", "h", "a", "e", "off"))
    open_ = met.where("kind >= 2")
    n_open = dict(open_.groupBy("kind").count().collect())
    asked = open_.groupBy("doc_id", "row").agg(F.collect_list(F.struct("kind", "h", "a", "e", "off")).alias("asked"))
    pieces = usable.join(asked, ["doc_id", "row"]).select("doc_id", "row", "raw", F.explode("asked").alias("x")).select(
        "doc_id", "row", "x.*", F.substring("raw", F.col("x.a") + 1, F.col("x.e") - F.col("x.a") + length).alias("piece")
    )
    ranges = met.where("kind = 0").select("doc_id", "row", "a", "e")
    if n_open:
        pieces, _ = stored(pieces)
        if n_open.get(2):
            tasks = math.ceil(n_open[2] / BLOCK_RUNS)
            dealt = pieces.where("kind = 2").withColumn("task", F.pmod(F.xxhash64("h"), F.lit(tasks)).cast("int"))

            def arrays(table: pa.Table) -> pa.Table:
                order = np.argsort(np.asarray(table["h"]), kind="stable")
                table = table.take(order)
                h = np.asarray(table["h"])
                ids, rows, at, end, off, raw = (table[c].to_pylist() for c in ("doc_id", "row", "a", "e", "off", "piece"))
                cuts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)).tolist()
                out = []
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    found = shared_windows([(ids[k], raw[k], end[k] - at[k], off[k]) for k in range(s, e)], length)
                    out += [(ids[s + k], rows[s + k], at[s + k] + i, at[s + k] + j) for k, i, j in found]
                doc_id, row, a, e = zip(*out, strict=True) if out else ((), (), (), ())
                return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "row": pa.array(row, pa.int64()), "a": pa.array(a, pa.int32()), "e": pa.array(e, pa.int32())})

            ranges = ranges.unionByName(dealt.groupBy("task").applyInArrow(arrays, "doc_id long, row long, a int, e int"))
        if n_open.get(3):
            windows = pieces.where("kind = 3").select("doc_id", "row", "a", "piece", F.explode(F.sequence(F.lit(0), F.col("e") - F.col("a"))).alias("i"))
            window = F.substring("piece", F.col("i") + 1, F.lit(length))
            windows = windows.select("doc_id", "row", (F.col("a") + F.col("i")).alias("a"), F.xxhash64(window).alias("s"), F.xxhash64(F.lit(1), window).alias("t"))
            least = windows.groupBy("s", "t").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
            ranges = ranges.unionByName(windows.join(least, ["s", "t"]).where("doc_id > least").select("doc_id", "row", "a", F.col("a").alias("e")))
    lost = ranges.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("a", "e"))).alias("lost"))
    joined = texts.join(lost, ["doc_id", "row"], "left").select("doc_id", "raw", "lost.a", "lost.e", *["rest"] * carry)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw, a, e in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            spans: list[list[int]] = []
            for s, t in zip(a or (), e or (), strict=True):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], t + length)
                else:
                    spans.append([s, t + length])
            if characters:
                for x in spans:
                    while x[0] < x[1] and raw[x[0]] & 0xC0 == 0x80:
                        x[0] += 1
                    while x[0] < x[1] < len(raw) and raw[x[1]] & 0xC0 == 0x80:
                        x[1] -= 1
            at, kept = 0, []
            for s, t in spans:
                kept.append(raw[at:s])
                at = t
            kept = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(kept), [{"start": s, "end": t} for s, t in spans], kept))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))]
        return pa.RecordBatch.from_arrays([*arrays, *batch.columns[4:]], ["doc_id", "n_bytes", "n_removed", "spans", "kept", *["rest"] * carry])

    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    return in_arrow(joined, cut, StructType([*schema, *([texts.schema["rest"]] if carry else [])]))
