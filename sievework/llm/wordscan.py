"""Vectorised word scanning shared by the text operators.

A batch of texts becomes one byte buffer; words are maximal runs of bytes other
than 0x20 and 0x09-0x0D, so no Python object is made per word.
"""

from __future__ import annotations

import functools

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MUL1 = np.uint64(0xBF58476D1CE4E5B9)
_MUL2 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place on its own copy."""
    h = h ^ (h >> np.uint64(30))
    h *= _MUL1
    h ^= h >> np.uint64(27)
    h *= _MUL2
    h ^= h >> np.uint64(31)
    return h


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base), dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _power(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), 1 << max(16, (n - 1).bit_length()))[:n]


class Words:
    """Words of a batch: byte ``start``/``end`` in ``buf``, owning row ``doc`` and the offsets ``first`` of each row's words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        # a space after each text keeps words of neighbours apart
        self.raw = b" ".join(texts) + b" "
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        n = len(texts)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        self.text_start = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.text_start[1:])
        inside = ~_SPACE[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes (polynomial over the buffer, finalised)."""
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        p = np.zeros(n + 1, dtype=np.uint64)
        v = self.buf.astype(np.uint64)
        v += np.uint64(1)
        v *= _power(_BASE, n)
        np.cumsum(v, out=p[1:])
        h = p[self.end] - p[self.start]
        h *= _power(_INV, n)[self.start]
        h += (self.end - self.start).astype(np.uint64) * _MUL2
        return mix(h)
