"""NumPy kernels over the UTF-8 buffers of Arrow string columns.

Words are found and hashed on whole batches at once.  Both word classes used
here are unions of ASCII ranges plus all bytes from 0x80, so working on bytes
gives the same words as working on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64

_BASE = 0x9E3779B97F4A7C55
#: The lowest 0 to 8 bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, bool)  # [\x20\x09-\x0D]
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE

ALNUM = np.ones(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def text_bytes(arr: pa.Array, kind: pa.DataType = pa.large_string()) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string (or, by ``kind``, binary) column; null counts as empty."""
    arr = pc.fill_null(arr.cast(kind), "" if kind == pa.large_string() else b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster here than NumPy's table)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def spans(raw: np.ndarray, off: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of maximal runs of a byte class; runs end at the
    border of two texts."""
    inside = klass[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(raw):
        edge[0] = edge[-1] = True
        edge[off] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = inside[start] if len(start) else np.zeros(0, bool)
    return start[keep], end[keep]


#: Spans of at most so many 8-byte steps are hashed side by side, longer ones one by one.
SHORT_STEPS = 64


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes or code points; ``seed`` gives independent ones.

    Eight bytes at a time go through ``mix``, which is not linear, so spans don't
    collide for their structure."""
    wide = raw.dtype.itemsize
    flat = np.zeros(len(raw) * wide + 8, np.uint8)
    flat[:-8] = np.ascontiguousarray(raw).view(np.uint8)
    eights = np.ndarray((len(flat) - 7,), "<u8", flat, 0, (1,))
    at, size = start * wide, (end - start) * wide
    h = mix(size.astype(U) * U(_BASE) + mix(np.full(1, seed + 1, U)))
    steps = -(-size // 8)
    for i in np.flatnonzero(steps > SHORT_STEPS).tolist():
        h[i] = xxhash.xxh3_64_intdigest(flat[at[i] : at[i] + size[i]].tobytes(), int(h[i]))
    left = np.flatnonzero((steps > 0) & (steps <= SHORT_STEPS))
    k = 0
    while len(left):
        rest = size[left] - 8 * k
        eight = eights[at[left] + 8 * k] & _MASKS[np.minimum(rest, 8)]
        h[left] = mix(h[left] ^ eight) + U(k)
        left = left[rest > 8]
        k += 1
    return mix(h)


def words(raw: np.ndarray, off: np.ndarray, klass: np.ndarray):
    """(hash, start, end, first) of the words of each text, A-Z lower-cased;
    ``first[i]:first[i+1]`` are the words of text i."""
    low = LOWER[raw]
    start, end = spans(low, off, klass)
    return hash_spans(low, start, end), start, end, np.searchsorted(start, off)


_MULT = mix(np.arange(1, 65, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i; the last n-1 places are missing."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    s = np.zeros(m, U)
    for j in range(n):
        s += h[j : j + m] * _MULT[j % 64]
    return mix(s + U(n))


def window_sets(h: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word windows of each text; a text of fewer words
    (not none) has its whole sequence as the one window."""
    w = windows(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(w[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(windows(h[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def code_point_index(raw: np.ndarray) -> np.ndarray:
    """For each byte offset (0..n) the number of code points before it."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())
