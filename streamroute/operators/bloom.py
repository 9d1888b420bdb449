"""The plain Bloom filter of the deduplication tiers: one bit array, double hashing."""

from __future__ import annotations

import math

import numpy as np


def _mixed(x: np.ndarray, odd: int) -> np.ndarray:
    """A mix of 64-bit values: multiply and fold, twice."""
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(32))) * np.uint64(odd)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(odd ^ 0x5851F42D4C957F2C)
        return z ^ (z >> np.uint64(32))


class Bloom:
    """m = ceil(-n ln p / ln2^2) bits and k = max(1, round(m / n ln 2)) probes for n keys at a rate p. Keys are 64-bit
    hashes. `count` counts insertions, repeated ones included."""

    def __init__(self, capacity: int = 1_000_000, rate: float = 0.001):
        self.m = max(1, math.ceil(-capacity * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(self.m / capacity * math.log(2)))
        self.clear()

    def clear(self) -> None:
        self.bits = np.zeros(-(-self.m // 64), np.uint64)
        self.count = 0

    def _at(self, h: np.ndarray) -> np.ndarray:
        one, two = _mixed(h, 0x9FB21C651E98DF25), _mixed(h, 0xD6E8FEB86659FD93) | np.uint64(1)
        with np.errstate(over="ignore"):
            return np.array([(one + np.uint64(i) * two) % np.uint64(self.m) for i in range(self.k)])

    def may_contain(self, h: np.ndarray) -> np.ndarray:
        at = self._at(h)
        return ((self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0).all(axis=0)

    def insert(self, h: np.ndarray) -> None:
        at = self._at(h).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.count += len(h)
