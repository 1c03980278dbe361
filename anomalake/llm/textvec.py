"""Vectorised text primitives shared by the text operators (NumPy over whole Arrow batches)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Base of the polynomial prefix hash, odd so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, so that the polynomial hash has no weak alphabet.
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to 2**19 of them (4 MB), and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = _U(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    if len(have) <= 1 << 19:
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i] = hash of data[:i] as a sum, for substring hashes in O(1)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], alike for equal bytes wherever they stand."""
    n = len(prefix)
    return mix((prefix[end] - prefix[start]) * powers(_INV, n)[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than ASCII white space."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash for each word of the bytes, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, np.uint64)
    low = LOWER[data]
    start, end = words(low)
    return span_hash(prefix_hash(low), start, end)


def shingles(word: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of ``size`` words; fewer words make one shingle of them all, no words none."""
    n = len(word)
    if not n:
        return word
    k = min(size, n)
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc = mix(acc + word[j : n - k + 1 + j] * _U(2 * j + 3))
    return np.unique(mix(acc + _U(k)))


def utf8(text: str | None) -> np.ndarray:
    """The text's bytes; null is empty. A lone surrogate can't come from Spark, whose strings are UTF-8."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
