"""Words of texts as 64-bit hashes, and n-grams of bytes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries of the word cache; a full one is emptied.  Words of more bytes than LONGEST are not cached.
CACHE, LONGEST = 250_000, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()

#: Odd multipliers: one for each place in a window of hashes.
PLACES = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each maximal run of bytes other than space and 09-0D."""
    words = raw.split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n hashes, in order."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += mixed(hashes[k : k + size] * PLACES[k])
    return mixed(total)


def characters(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", errors="replace"), np.uint32)


def char_grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of each n-gram of characters; n - 1 fewer than characters."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    x = points[:size] * np.uint32(2654435761)
    for k in range(1, n):
        x ^= x >> np.uint32(15)
        x += points[k : k + size]
        x *= np.uint32(2246822519)
    x ^= x >> np.uint32(13)
    x *= np.uint32(3266489917)
    return x >> np.uint32(32 - bits)
