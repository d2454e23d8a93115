"""Distinct word shingles of texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

# Odd constants of well-known 64-bit mixers.
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


def seed(n: int) -> np.uint64:
    """The n-th of a fixed sequence of seeds."""
    return mix(np.array([((n + 1) * _STEP) & _MASK], dtype=np.uint64))[0]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (``bytes`` methods know ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; the whole sequence as one run if it is shorter."""
    if not len(hashes):
        return hashes
    k = min(size, len(hashes))
    total = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for i in range(k):
        total += hashes[i : len(hashes) - k + 1 + i] * (seed(i) | np.uint64(1))
    return mix(total ^ seed(100 + k))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text, whole texts; none for NULL or a text without words."""
    for text in texts:
        yield np.unique(windows(word_hashes(words_of(text)), size))
