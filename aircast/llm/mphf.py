"""Minimal perfect hash functions over distinct 64-bit keys, in NumPy.

Keys fall to the bits of an array; those that are alone at theirs are placed, the others
go on to the next, smaller array.  A key's number is the rank of its bit among all set bits, so
``n`` keys have the numbers 0..n-1 and need about 4 bits each.  A key outside the set gets any
number, or -1: who asks with unknown keys must compare the key stored there.
"""

from __future__ import annotations

import numpy as np

from .textkit import U, mix

#: Bits of an array for each key that comes to it.
ROOM = 2.0
LEVELS = 64


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((mix(keys ^ mix(np.full(1, level + 1, U))) >> U(32)) * U(size) >> U(32)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        """``bits``: the arrays of all levels, one after the other, packed."""
        self.sizes, self.packed = sizes, bits
        self.bits = np.unpackbits(bits, count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32)  # of a set bit, its number plus 1
        self.n = int(self.rank[-1]) if len(self.rank) else 0

    def __reduce__(self):
        return PerfectHash, (self.sizes, self.packed)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """``keys``: distinct uint64."""
        sizes, arrays = [], []
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("no perfect hash: the keys are not distinct")
            size = int(len(keys) * ROOM) + 8
            at = _place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(alone)
            keys = keys[~alone[at]]
        return cls(sizes, np.packbits(np.concatenate(arrays)) if arrays else np.zeros(0, np.uint8))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]] - 1
            left = left[~hit]
            if not len(left):
                break
            base += size
        return out
