"""Ids of many chunks at once: a hash table between byte strings and their ids, in numpy.

A dictionary of a million short strings costs several cache misses a look-up, one after
the other; here the look-ups of a block go together.  The key of a chunk is the sum of
random 64-bit values, one for each of its bytes by place, so two chunks have one key with
chance 2^-64.  The table is of fixed size; a full one is emptied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Places of the table, and the chunks and ids that it holds at most.
SLOT_BITS, ENTRIES, IDS = 21, 1 << 20, 5 << 20
#: Bytes of a chunk that is kept; longer ones are made each time.
LONGEST = 64

_VALUES = np.random.default_rng(5).integers(0, 1 << 64, LONGEST << 8, dtype=np.uint64)


class ChunkTable:
    """``make`` gives the ids of a chunk as little-endian unsigned 32-bit bytes, at most one id a byte."""

    def __init__(self, make: Callable[[bytes], bytes]):
        self.make = make
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)  # 0: free
        self.entry = np.zeros(1 << SLOT_BITS, np.int32)
        self.begin = np.zeros(ENTRIES + 2, np.int32)
        self.ids = np.zeros(IDS, np.uint32)
        self.n = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        found = np.full(len(keys), -1)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            there = self.keys[slot]
            hit = there == keys
            found[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            left, keys, slot = left[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return found

    def _add(self, keys: np.ndarray, made: list[bytes]) -> bool:
        """New, different keys; False if there is no room."""
        ids = np.frombuffer(b"".join(made), "<u4")
        used, n = int(self.begin[self.n]), self.n + len(made)
        if n > ENTRIES or used + len(ids) > len(self.ids):
            return False
        self.ids[used : used + len(ids)] = ids
        self.begin[self.n + 1 : n + 1] = used + np.cumsum([len(x) // 4 for x in made])
        entry, slot = np.arange(self.n, n), self._slots(keys)
        self.n = n
        while len(keys):  # of those that want one free place, one gets it
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.entry[slot[won]] = entry[won]
            keys, entry, slot = keys[~won], entry[~won], (slot[~won] + 1) & (len(self.keys) - 1)
        return True

    def encode(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks of ``raw`` that begin at ``starts`` (ascending from 0), and how many each has."""
        b = np.frombuffer(raw, np.uint8)
        ends = np.append(starts[1:], len(b))
        lengths = ends - starts
        place = np.minimum(np.arange(len(b)) - np.repeat(starts, lengths), LONGEST - 1)
        keys = np.maximum(np.add.reduceat(_VALUES[place << 8 | b], starts), np.uint64(1))
        long = np.flatnonzero(lengths > LONGEST)
        entry = self._find(keys)
        entry[long] = 0  # these are filled in at the end
        new = np.flatnonzero(entry < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            first = new[first]
            made = [self.make(raw[a:e]) for a, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            if not self._add(fresh, made):
                self.keys[:] = 0
                self.n = 0
                return self.encode(raw, starts)
            entry[new] = self._find(keys[new])
        own = [np.frombuffer(self.make(raw[a:e]), "<u4") for a, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        begin = self.begin[entry]
        size = self.begin[entry + 1] - begin
        size[long] = [len(x) for x in own]
        at = np.cumsum(size, dtype=np.int64)
        ids = self.ids.take(np.arange(at[-1]) + np.repeat(begin - at + size, size), mode="clip")
        for k, x in zip(long.tolist(), own, strict=True):
            ids[at[k] - size[k] : at[k]] = x
        return ids, size
