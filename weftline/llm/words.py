"""Words and word shingles as 64-bit hashes, whole texts at a time.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Hashes depend on the word's bytes alone:
a polynomial in them for words of up to LONG bytes, XXH3 for longer ones (long regular words can share a polynomial).
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * len(_POWERS), 1024), BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def word_hashes(text: str, between: np.ndarray = SPACE) -> np.ndarray:
    """One uint64 for each word of a text, in order; between: for each byte value, whether it separates words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gap = between[raw]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    inside = FOLD[raw[~gap]].astype(np.uint64) + np.uint64(1)
    at = np.r_[0, np.cumsum(length)[:-1]]
    place = np.arange(len(inside)) - np.repeat(at, length)
    # the places of long words may wrap: their sums aren't used
    sums = np.add.reduceat(inside * powers(LONG)[place & (LONG - 1)], at)
    out = mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(length > LONG):
        out[i] = xxhash.xxh3_64_intdigest(FOLD[raw[start[i] : end[i]]].tobytes())
    return out


FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of fewer words, one for the whole sequence; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(n, k)
    total = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        total += words[i : n - size + 1 + i] * FACTORS[i]
    return np.unique(mix(total))
