"""Byte-pair encoding: operator 6, and a fast exact path to the tokenizers library.

``merge`` is the operator's own encoder: a priority queue of merge ranks over a doubly
linked list of symbols.  ``Encoder`` drives it, or the library's model, over whole texts.

A text falls into chunks at places where no pre-token of the file's pattern can cross,
so a chunk's ids never depend on its neighbours.  Chunks, and the pre-tokens inside
chunks not met before, are looked up in caches of bounded size.  Texts for which the
argument does not hold (a special token's string, runs of white space across a cut)
take the plain path over the whole text.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.llm.chunk_table import ChunkTable
from proseflow.llm.common import in_arrow

#: Entries of a cache of chunks, and a third of it those of the cache of pre-tokens; a full one is emptied.
CACHE = 300_000
#: Characters of what is cached at most: a longer chunk is not likely to come again.
LONGEST = 64
#: Bytes of text that are looked up together.
BLOCK = 1 << 18


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where visible, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def merge(symbols: list[int], rules: dict[int, int]) -> list[int]:
    """``symbols`` after all merges.  rules: ``left << 20 | right`` to ``rank << 20 | merged``.

    The queue holds (rank, place); an entry whose symbols have changed since is skipped.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    found = rules.get
    queue = []
    for i in range(n - 1):
        pair = symbols[i] << 20 | symbols[i + 1]
        if (rule := found(pair)) is not None:
            queue.append((rule, i, pair))
    if not queue:
        return symbols
    heapify(queue)
    ids = symbols + [-1]  # a last place that no rule matches
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    while queue:
        rule, i, pair = heappop(queue)
        j = after[i] if i < n else n
        if ids[i] < 0 or ids[j] < 0 or ids[i] << 20 | ids[j] != pair:
            continue  # stale
        ids[i] = new = rule & 0xFFFFF
        ids[j] = -1
        after[i] = k = after[j]
        before[k] = i
        if k < n and (rule := found(pair := new << 20 | ids[k])) is not None:
            heappush(queue, (rule, i, pair))
        if (k := before[i]) >= 0 and (rule := found(pair := ids[k] << 20 | new)) is not None:
            heappush(queue, (rule, k, pair))
    return [x for x in ids if x >= 0]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    def __init__(self, make, share: int = 1):
        self.make, self.share = make, share

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) * self.share >= CACHE:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the library gives them.

    kind ``byte``: byte-level file without normalizer.  kind ``word``: file with word ends
    that lower-cases and drops white space.  own: encode by ``merge``, not the library's model.
    """

    def __init__(self, path: str, own: bool = False):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.end = model.get("end_of_word_suffix") or ""
        self.kind = "word" if self.end else "byte"
        pattern = (
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
            if self.end
            else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.split = regex.compile(pattern).findall
        self.alphabet = byte_alphabet()
        self.shown = dict(enumerate(self.alphabet))
        self.space = self.alphabet[32]
        self.own = own
        if own:
            ids = self.vocab
            pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
            self.rules: dict[int, int] = {}
            for rank, (a, b) in enumerate(pairs):
                self.rules.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
            self.of_byte = [ids.get(c, -1) for c in self.alphabet]
            if self.end:
                raise ValueError("own encoding is for byte-level files")
            shown = {c: b for b, c in enumerate(self.alphabet)}
            self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
            for token, i in [*ids.items(), *self.special.items()]:
                self.bytes_of[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
            self.decimals = list(map(str, range(len(self.bytes_of))))
            self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.words = _Cache(self._word, 3)
        self.chunks = _Cache(self._chunk)
        self.spaced = _Cache(self._spaced)
        self.table = ChunkTable(self._made)

    def _word(self, word: str) -> bytes:
        """A pre-token."""
        if self.own:
            return _packed(merge(list(map(self.of_byte.__getitem__, word.encode())), self.rules))
        shown = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.shown)
        return _packed([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.words[chunk[-1]]
        return b"".join(map(self.words.__getitem__, self.split(chunk)))

    def _spaced(self, chunk: str) -> bytes:
        """A chunk that comes after one space."""
        if chunk.isalpha():
            if self.own or not chunk.isascii():
                return self._word(" " + chunk)
            return _packed([t.id for t in self.tokenizer.model.tokenize(self.space + chunk)])
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return self.spaced[chunk[:-1]] + self.words[chunk[-1]]
        return b"".join(map(self.words.__getitem__, self.split(" " + chunk)))

    def whole(self, text: str) -> bytes:
        """The plain path."""
        if not self.own:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.cut_special(text) if self.special else [text]
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._chunk(x) for x in parts if x)

    def _plain(self, text: str) -> bool:
        """Whether the argument for chunks fails."""
        if "<|" in text and any(x in text for x in self.special):
            return True
        if self.kind == "word":
            return not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text)) or _CONTROL(text) is not None
        return _crossed(text)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._plain(text):
            return self.whole(text)
        if self.kind == "word":
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        first, *rest = text.split(" ")
        return self._chunk(first) + b"".join(map(self.spaced.__getitem__, rest))

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """What a call gives for each text, in order; chunks of some BLOCK bytes are looked up together."""
        block, size = [], 0
        for text in texts:
            pieces = self._pieces(text)
            if len(pieces) == 1:
                block += pieces
                size += len(pieces[0])
                if size < BLOCK:
                    continue
            yield from self._looked_up(block)
            if not pieces:
                yield self(text)
            elif len(pieces) > 1:
                yield b"".join(x for piece in pieces for x in self._looked_up([piece]))
            block, size = [], 0
        yield from self._looked_up(block)

    def _pieces(self, text: str | None) -> list[bytes]:
        """A text whose chunks begin at its spaces, cut at spaces if long; nothing if it must go by itself."""
        if not text:
            return [b""]
        if self._plain(text):
            return []
        if self.kind == "word":
            text = " ".join(["", *text.lower().split()])
        raw = text.encode()
        pieces, a = [], 0
        while len(raw) - a > BLOCK and (cut := raw.find(b" ", a + BLOCK)) > 0:
            pieces.append(raw[a:cut])
            a = cut
        pieces.append(raw[a:])
        return pieces if max(map(len, pieces)) <= 2 * BLOCK else []

    def _made(self, raw: bytes) -> bytes:
        """A chunk with the space before it."""
        chunk = raw.decode()
        if chunk[0] != " ":
            return self._chunk(chunk)
        return self._chunk(chunk[1:]) if self.kind == "word" else self._spaced(chunk[1:])

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        raw = b"".join(texts)
        if not raw:
            return [b""] * len(texts)
        ends = np.cumsum([len(x) for x in texts])
        b = np.frombuffer(raw, np.uint8)
        begins = b == 32
        begins[0] = True
        if self.kind == "byte":  # a line end between two characters that are no white space is a pre-token
            line = np.flatnonzero(b[1:-1] == 10) + 1
            left, right = b[line - 1], b[line + 1]
            line = line[(left > 32) & (left < 127) & (right > 32) & ((right < 127) | (right > 0xC2) & (right < 0xE0))]
            begins[line] = begins[line + 1] = True
        begins[ends[ends < len(raw)]] = True
        starts = np.flatnonzero(begins)
        ids, sizes = self.table.encode(raw, starts)
        before = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, ends)]
        data = ids.tobytes()
        return [data[4 * a : 4 * e] for a, e in pairwise([0, *before.tolist()])]


#: Split on by Python, but no white space to the library.
_CONTROL = regex.compile("[\x1c-\x1f]").search
_CROSSED = regex.compile(r"\s (?:\s|\Z)").search


def _crossed(text: str) -> bool:
    """Whether a space stands between white space, so that cutting before it would cut a run."""
    if text.isascii() and not any(x in text for x in ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\x1c ", "\x1d ", "\x1e ", "\x1f ")):
        return False
    return _CROSSED(text) is not None


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, own: bool = False) -> Encoder:
    """One for each process, so that its caches outlive a task."""
    if (path, own) not in _ENCODERS:
        _ENCODERS[path, own] = Encoder(path, own)
    return _ENCODERS[path, own]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Encodes each text by ``merge`` and decodes the ids again.

    Returns ``doc_id, ids array<int>, decoded string`` (``texts=True``), and always
    ``n_tokens, ids_sha256, decoded_sha256``.  A null text counts as empty: no ids, the
    digests of nothing.  A null id stays null; repeated rows give repeated rows.  Other
    columns are not read.
    """
    own = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer, own=True)
        vocab, decimal = enc.bytes_of.__getitem__, enc.decimals.__getitem__
        counts, hashes, decodes, all_ids, all_texts = [], [], [], [], []
        for packed in enc.many(x.as_py() for x in batch.column(1)):
            ids = np.frombuffer(packed, "<u4").tolist()
            raw = b"".join(map(vocab, ids))
            counts.append(len(ids))
            hashes.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode(errors="replace").encode()
            decodes.append(hashlib.sha256(raw).hexdigest())
            if texts:
                all_ids.append(ids)
                all_texts.append(raw.decode())
        arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decodes)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if texts:
            arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts)]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(rows, run, own + (", ids array<int>, decoded string" if texts else ""))
