"""Word hashes and rolling hashes of word windows, modulo 2^64, on NumPy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bases of two independent rolling hashes (odd, so that they have an inverse).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of the words of a text, equal in every worker.  A hash takes less time than a memo of it."""

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes of every window of `size` words: sum of word hashes times powers of a base."""

    def __init__(self, size: int, base: int):
        self.size, self._base, self._inverse = size, base, pow(base, -1, 2**64)
        self._up = self._down = np.ones(0, np.uint64)

    def windows(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n < self.size:
            return np.zeros(0, np.uint64)
        if len(self._up) < n:
            self._up, self._down = self._powers(self._base, n), self._powers(self._inverse, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self._up[:n])])
        return (total[self.size:] - total[:-self.size]) * self._down[:n - self.size + 1]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x
