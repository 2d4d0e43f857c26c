"""Word shingles of whole texts as 64-bit hashes, and b-bit MinHash signatures of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
CACHED_WORDS = 300_000
BANDS, ROWS, LOW_BITS = 40, 5, 2
PERMUTATIONS = BANDS * ROWS
BLOCK = 2048

_GOLDEN = 0x9E3779B97F4A7C15
_DRAWS = np.random.Generator(np.random.PCG64(20240917))
_POWERS = _DRAWS.integers(0, 1 << 64, WIDTH, dtype=np.uint64) | np.uint64(1)
_SCALE = _DRAWS.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _DRAWS.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


_WORDS = _Words()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a UTF-8 text.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and white space only, as the
    definition of a word asks.  Fewer words than five give one hash of them all, none give
    an empty set.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(hashes) < WIDTH:
        size = np.array([len(hashes) * _GOLDEN % (1 << 64)], np.uint64)
        return mix((hashes * _POWERS[: len(hashes)]).sum(keepdims=True, dtype=np.uint64) + size)
    n = len(hashes) - WIDTH + 1
    total = hashes[:n] * _POWERS[0]
    for i in range(1, WIDTH):
        total += hashes[i : i + n] * _POWERS[i]
    return np.unique(mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a non-empty set."""
    least = np.full(PERMUTATIONS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        block = shingles[at : at + BLOCK, None] * _SCALE
        block += _SHIFT
        np.minimum(least, block.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of minima; the band's number is part of the key."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + column)
    return keys.astype(np.int64)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low two bits of every (mixed) minimum, 32 of them in a long; the rest is zero."""
    low = np.zeros(-(-PERMUTATIONS // 32) * 32, np.uint64)
    low[:PERMUTATIONS] = mix(least) & np.uint64(3)
    places = np.arange(32, dtype=np.uint64) * np.uint64(LOW_BITS)
    return (low.reshape(-1, 32) << places).sum(axis=1, dtype=np.uint64).astype(np.int64)
