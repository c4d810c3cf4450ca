"""Vectorised 64-bit hashes of words and lines."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        factor = np.full(max(n, 1 << 16), np.uint64(0xD6E8FEB86659FD93))
        factor[0] = 1
        _POWERS[0] = np.cumprod(factor)
    return _POWERS[0][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the ASCII-lower-cased words of UTF-8 text, in order.

    The sum over a word's bytes of a byte's value times a power of its place in the word, then mixed with the length.
    """
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    value = _HASHED_BYTE[_LOWER[data]]
    powers = _powers(1 << 12)
    place = np.arange(len(data)) - np.r_[np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.r_[starts, len(data)]))]
    longest = int((ends - starts).max())
    if longest > len(powers):
        powers = _powers(longest)
    term = np.where(inside, value * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    sums = np.add.reduceat(term, starts)
    return mix(sums + (ends - starts).astype(np.uint64) * ODD)


_HASHED_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * ODD) | np.uint64(1)
