"""Compressed bitmaps over small integers, in chunks of 2^16.

A chunk is a sorted array of 16-bit values while it has at most 4096 of them
and a bit vector of 8 KiB beyond that, so a sparse chunk costs two bytes a
member and a dense one a bit.
"""

from __future__ import annotations

import numpy as np

_SPARSE = 4096


class Bitmap:
    """An immutable set of non-negative integers."""

    def __init__(self, chunks: dict[int, np.ndarray] | None = None) -> None:
        self.chunks = chunks or {}

    @classmethod
    def of(cls, values: np.ndarray) -> Bitmap:
        values = np.unique(np.asarray(values, np.int64))
        high = values >> 16
        edges = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): cls._pack((part & 0xFFFF).astype(np.uint16)) for part in np.split(values, edges) if len(part)})

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= _SPARSE:
            return low
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _members(chunk: np.ndarray) -> np.ndarray:
        return chunk if chunk.dtype == np.uint16 else np.flatnonzero(np.unpackbits(chunk)).astype(np.uint16)

    @staticmethod
    def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if a.dtype == np.uint8 and b.dtype == np.uint8:
            left = np.flatnonzero(np.unpackbits(a & ~b)).astype(np.uint16)
        elif b.dtype == np.uint8:
            low = a.astype(np.int64)
            left = a[(b[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 0]
        else:
            left = np.setdiff1d(Bitmap._members(a), b, assume_unique=True)
        return Bitmap._pack(left)

    def andnot(self, other: Bitmap) -> Bitmap:
        out = {}
        for high, a in self.chunks.items():
            b = other.chunks.get(high)
            left = a if b is None else self._minus(a, b)
            if len(left):
                out[high] = left
        return Bitmap(out)

    def values(self) -> np.ndarray:
        parts = [(self._members(c).astype(np.int64) | (high << 16)) for high, c in sorted(self.chunks.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.bitwise_count(c).sum()) for c in self.chunks.values())

    @property
    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.chunks.values())
