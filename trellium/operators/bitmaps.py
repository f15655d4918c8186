"""Compressed bitmaps over unsigned integers, on numpy.

Values are split by their upper bits into blocks of 65,536; a block holds a
sorted uint16 array while that is the smaller form, else a bitset of 8 KB.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 16
ARRAY_MAX = 4096  # beyond it the bitset is smaller


def _pack(values: np.ndarray) -> np.ndarray:
    """Sorted unique uint16 values to the smaller of the two forms."""
    if len(values) <= ARRAY_MAX:
        return values.astype(np.uint16)
    bits = np.zeros(BLOCK, dtype=np.uint8)
    bits[values] = 1
    return np.packbits(bits, bitorder="little")


def _values(block: np.ndarray) -> np.ndarray:
    if block.dtype == np.uint16:
        return block
    return np.flatnonzero(np.unpackbits(block, bitorder="little")).astype(np.uint16)


def _bits(block: np.ndarray) -> np.ndarray:
    if block.dtype == np.uint8:
        return block
    bits = np.zeros(BLOCK, dtype=np.uint8)
    bits[block] = 1
    return np.packbits(bits, bitorder="little")


class Bitmap:
    def __init__(self, blocks: dict[int, np.ndarray] | None = None):
        self.blocks = blocks or {}

    @classmethod
    def of(cls, values) -> "Bitmap":
        v = np.unique(np.asarray(values, dtype=np.int64))
        high = v >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(p[0] >> 16): _pack(p & 0xFFFF) for p in np.split(v, cuts) if len(p)})

    def _combine(self, other: "Bitmap", keys, sparse, dense) -> "Bitmap":
        out = {}
        for k in keys:
            a, b = self.blocks.get(k), other.blocks.get(k)
            if a is None or b is None:
                block = a if b is None else b
            elif a.dtype == np.uint16 and b.dtype == np.uint16:
                block = _pack(sparse(a, b))
            else:
                block = _pack(_values(dense(_bits(a), _bits(b))))
            if len(block):
                out[k] = block
        return Bitmap(out)

    def __or__(self, other: "Bitmap") -> "Bitmap":
        return self._combine(other, self.blocks.keys() | other.blocks.keys(), np.union1d, np.bitwise_or)

    def __and__(self, other: "Bitmap") -> "Bitmap":
        both = self.blocks.keys() & other.blocks.keys()
        return self._combine(other, both, lambda a, b: np.intersect1d(a, b, assume_unique=True), np.bitwise_and)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        return self._combine(other, self.blocks.keys(), lambda a, b: np.setdiff1d(a, b, assume_unique=True), lambda a, b: a & ~b)

    def values(self) -> np.ndarray:
        parts = [_values(b).astype(np.int64) + (k << 16) for k, b in sorted(self.blocks.items())]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return sum(len(b) if b.dtype == np.uint16 else int(np.unpackbits(b).sum()) for b in self.blocks.values())

    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.blocks.values())
