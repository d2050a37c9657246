"""Character n-grams over code points, on whole Arrow batches at once.

A batch becomes one array of lower-cased code points: letters stay, every other
character is a space, and two zeros stand between texts.  An n-gram is packed into
one 64-bit number (up to three code points) or hashed from it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from . import textkit as tk

SPACE = 32
STEP = 1 << 20  # code points handled at once


@cache
def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start, end): text i is points[start[i]:end[i]], with a space put
    before and after it."""
    raw, off = tk.text_bytes(arr)
    whole = raw.tobytes()
    texts = [f" {whole[a:z].decode('utf-8', 'replace').lower()} " for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("\0\0".join(texts).encode("utf-32-le", "replace"), np.uint32).copy()
    start = np.cumsum(size + 2) - size - 2
    points[~letter_table()[points]] = SPACE
    for gap in (0, 1):
        points[(start[1:] - 2 + gap)] = 0
    return points, start, start + size


def shifted(points: np.ndarray, a: int, z: int, by: int) -> np.ndarray:
    """points[a + by : z + by] as uint64, with zeros past the ends."""
    lo, hi = max(a + by, 0), min(z + by, len(points))
    out = np.zeros(z - a, np.uint64)
    if hi > lo:
        out[lo - a - by : hi - a - by] = points[lo:hi]
    return out


_MULT = np.uint64(0x9E3779B97F4A7C15)


def bucket(packed: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Multiply-shift hash of packed n-grams of one order."""
    return (((packed ^ np.uint64(order * 0x5851F42D4C957F2D & (2**64 - 1))) * _MULT) >> np.uint64(64 - bits)).astype(np.int64)
