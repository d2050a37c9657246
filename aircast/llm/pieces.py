"""SentencePiece encoding by forward filtering and backward sampling; lossless decoding.

A text is a lattice: its edges are the vocabulary's pieces.  Forward filtering sums, for
every place, the weights of all segmentations that end there; backward sampling then
draws a segmentation with exactly its probability, piece by piece from the end.  The
draws are a hash of the row's key, the place of the unit in the row and
the step, so a row's segmentation doesn't depend on partitions, batches or retries.

Weights: a BPE model has merge ranks but no probabilities; the weight of a piece is that
of Zipf's law for its rank, (rank + 2) ** -alpha.  Larger ``alpha`` comes closer to
the best segmentation.

Spaces are written as U+2581, which follows no other character in any piece (runs of
them are pieces too), and some characters (line feeds, say) stand in no longer piece at
all.  There, and nowhere else, the lattice falls into independent units, and equal
units of a batch are filtered once.  A unit may be as long as its text (there are texts
without spaces), so its sums are kept as logarithms.  A character without a piece of its own may be
spelled in byte pieces; U+2581 in the text always is, so decoding gives back
exactly the text (no prefix is added, nothing is normalised).

Defined results: a null text has null pieces and stays null; an empty text has none; rows
that repeat key and text have the same pieces; a null key counts as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import scan, spare

#: Where the vocabulary is; read on the driver, and broadcast (under 20 MB).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 1
SPACE, SPACE_SIGN = 32, 0x2581
HIDDEN = 0x110000  # stands for U+2581 of the text itself, in no piece; no code point of any text
SCREEN_BITS = 20
#: Characters of distinct units in one lattice (a longer unit has one of its own): about 25 MB.
CHARACTERS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C55)


class Vocabulary:
    def __init__(self, pieces: Sequence[str], scores: Sequence[float], kinds: Sequence[str], alpha: float = ALPHA):
        """``kinds``: 'piece', 'byte' or 'other' (control and unknown pieces, never used)."""
        self.alpha = alpha
        self.byte_id = np.full(256, -1, np.int32)
        spelled = [b""] * len(pieces)
        normal = []
        for i, (p, s, kind) in enumerate(zip(pieces, scores, kinds)):
            if kind == "byte":
                b = int(p[3:5], 16)
                self.byte_id[b], spelled[i] = i, bytes([b])
            elif kind == "piece":
                if "▁" in p.lstrip("▁"):
                    raise ValueError("a piece with a space after another character")
                spelled[i] = p.replace("▁", " ").encode()
                normal.append((p, i))
        if (self.byte_id < 0).any():
            raise ValueError("lossless encoding needs all 256 byte pieces")
        normal.sort(key=lambda x: -scores[x[1]])
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        #: by length: sorted hashes, ids, weights and a screen over the hashes
        self.by_length: dict[int, tuple] = {}
        rank = {i: r for r, (_, i) in enumerate(normal)}
        for n in sorted({len(p) for p, _ in normal}):
            own = [(p, i) for p, i in normal if len(p) == n]
            points = np.array([[ord(c) for c in p] for p, _ in own], np.uint64)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * _BASE + points[:, k]
            order = np.argsort(h)
            ids = np.array([i for _, i in own], np.int32)[order]
            weight = np.array([(rank[i] + 2.0) ** -alpha for i in ids])
            screen = np.zeros(1 << SCREEN_BITS, bool)
            screen[(h >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)] = True
            if n == 1:
                screen = None  # short numbers have no high bits, and nearly all are there
            self.by_length[n] = h[order], ids, weight, screen
        self.byte_weight = (len(normal) + 2.0) ** -alpha
        #: characters that longer pieces hold; the others stand alone
        self.joins = np.zeros(HIDDEN + 1, bool)
        self.joins[[ord(c) for p, _ in normal if len(p) > 1 for c in p]] = True


def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece" for i in ids]
    return Vocabulary([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], kinds, alpha)


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    return (tk.mix(key + np.uint64(step * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(11)).astype(float) * 2.0**-53


class Lattice:
    """Forward sums over distinct units: ``points`` (code points), units [start, end)."""

    def __init__(self, v: Vocabulary, points: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.start, self.end = start, end
        size = end - start
        owner = np.repeat(np.arange(len(start)), size)
        left = end[owner] - np.arange(len(points))  # characters to the end of the unit
        at, h, wide = np.arange(len(points)), np.zeros(len(points), np.uint64), points.astype(np.uint64)
        edges: list[tuple] = []
        alone = np.zeros(len(points), bool)
        for n in range(1, max(v.by_length) + 1):
            h = h * _BASE + wide[at + n - 1]
            if n in v.by_length:
                keys, ids, weight, screen = v.by_length[n]
                maybe = np.arange(len(h)) if screen is None else np.flatnonzero(screen[(h >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)])
                found = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[found] == h[maybe]
                where, found = at[maybe[hit]], found[hit]
                edges.append((where, np.full(len(where), n, np.int8), ids[found], weight[found]))
                if n == 1:
                    alone[where] = True
            go = left[at] > n
            at, h = at[go], h[go]
            if not len(at):
                break
        bare = np.flatnonzero(~alone)  # spelled in bytes
        n_bytes = utf8_size(points[bare])
        edges.append((bare, np.ones(len(bare), np.int8), np.full(len(bare), -1, np.int32), v.byte_weight**n_bytes))
        where, n, ids, weight = (np.concatenate(x) for x in zip(*edges))
        # places between characters: unit u has size[u] + 1 of them, from base[u] on
        base = start + np.arange(len(start))
        self.top = base + size
        tail = where + owner[where]
        head = tail + n
        weight = np.log(weight)
        # in the order of heads, those of each depth together; every place but a unit's first is a head
        depth = head - base[owner[where]]
        order = np.lexsort((head, depth))
        by_head = np.flatnonzero(np.concatenate([[True], np.diff(head[order]) != 0]))
        cut = np.searchsorted(depth[order[by_head]], np.arange(1, int(size.max(initial=0)) + 2)).tolist()
        by_head = np.append(by_head, len(order))
        sums = np.zeros(len(points) + len(start))  # logarithms
        for a, z in zip(cut[:-1], cut[1:]):
            first = by_head[a : z + 1]
            e = order[first[0] : first[-1]]
            x = sums[tail[e]] + weight[e]
            most = np.maximum.reduceat(x, first[:-1] - first[0])
            x = np.exp(x - np.repeat(most, np.diff(first)))
            sums[head[order[first[:-1]]]] = most + np.log(np.add.reduceat(x, first[:-1] - first[0]))
        # edges by their end, with the probability of each among those that end there
        order = np.argsort(head, kind="stable")
        self.tail, self.ids, head = tail[order].astype(np.int32), ids[order], head[order]
        self.edge = np.searchsorted(head, np.arange(len(sums) + 1)).astype(np.int32)
        # summed up place by place, so a draw doesn't depend on what else is in the lattice
        self.upto = np.exp(sums[self.tail] + weight[order] - sums[head])
        number = np.diff(self.edge)
        for k in range(1, int(number.max(initial=0))):
            e = self.edge[:-1][number > k] + k
            self.upto[e] += self.upto[e - 1]
        self.point_of_tail = self.tail - np.searchsorted(self.top, self.tail).astype(np.int32)  # back to a place in ``points``

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, first, number): the edges of each occurrence ``unit`` in order."""
        base = self.start + np.arange(len(self.start))
        place, stop = self.top[unit], base[unit]
        live = np.arange(len(unit))
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        number = np.zeros(len(unit), np.int64)
        while len(live):
            p = place[live]
            # the first edge of the place whose sum is beyond the draw, by halving
            e, last = self.edge[p], self.edge[p + 1] - 1
            u = uniform(key[live], len(drawn)) * self.upto[last]
            for _ in range(int((last - e).max()).bit_length()):
                mid = (e + last) >> 1
                beyond = self.upto[mid] > u
                last = np.where(beyond, mid, last)
                e = np.where(beyond, e, np.minimum(mid + 1, last))
            drawn.append((live, e))
            number[live] += 1
            place[live] = self.tail[e]
            live = live[place[live] > stop[live]]
        first = np.concatenate([[0], np.cumsum(number)])
        out = np.empty(first[-1], np.int64)
        for step, (who, e) in enumerate(drawn):
            out[first[who] + number[who] - 1 - step] = e
        return out, first[:-1], number


def spoken(points: np.ndarray) -> np.ndarray:
    return np.where(points == HIDDEN, SPACE_SIGN, np.where(points == SPACE_SIGN, SPACE, points))


def utf8_size(points: np.ndarray) -> np.ndarray:
    """Bytes of the characters that lattice places stand for."""
    p = spoken(points)
    return 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)


def encode(v: Vocabulary, arr: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the pieces of text i are ids[offsets[i]:offsets[i + 1]]."""
    raw, off = tk.text_bytes(arr)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)  # of characters, in bytes
    text = raw.tobytes().decode("utf-8", "strict")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    points[points == SPACE_SIGN] = HIDDEN
    points[points == SPACE] = SPACE_SIGN
    row_at = np.searchsorted(starts, off)  # rows in characters
    # units begin with a row, the first of a run of space signs, and on either side of a
    # character that stands alone
    begin = points == SPACE_SIGN
    begin[1:] &= ~begin[:-1]
    alone = ~v.joins[points]
    begin |= alone
    begin[1:] |= alone[:-1]
    begin[row_at[:-1][row_at[:-1] < len(points)]] = True
    at = np.flatnonzero(begin)
    # equal units once; compared by their characters, not by a hash
    cut = np.append(at, len(points)).astype(np.int64) * 4
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(points)]).dictionary_encode()
    unit = np.asarray(units.indices)
    raw_units, unit_off = tk.text_bytes(units.dictionary.cast(pa.large_binary()), pa.large_binary())
    distinct, first = raw_units.view(np.uint32), unit_off // 4
    row = np.searchsorted(row_at, at, "right") - 1
    rank = np.arange(len(at)) - np.searchsorted(at, row_at[row])
    key = tk.mix(tk.mix(keys[row].astype(np.int64).view(np.uint64) + np.uint64(seed * int(_BASE) & (2**64 - 1))) ^ rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    by_unit = np.argsort(unit, kind="stable")
    begin_of = np.searchsorted(unit[by_unit], np.arange(len(first)))
    number, parts, a = np.zeros(len(at), np.int64), [], 0
    while a < len(first) - 1:  # a lattice of so many characters at a time
        z = max(a + 1, int(np.searchsorted(first, first[a] + CHARACTERS, "right")) - 1)
        occurrences = by_unit[begin_of[a] : begin_of[z]]
        lattice = Lattice(v, distinct[first[a] : first[z]], first[a:z] - first[a], first[a + 1 : z + 1] - first[a])
        ids, count = _drawn(v, lattice, distinct[first[a] : first[z]], unit[occurrences] - a, key[occurrences])
        number[occurrences] = count
        parts.append((occurrences, ids, count))
        a = z
    total = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(total[-1], np.int32)
    for occurrences, ids, count in parts:
        out[np.repeat(total[occurrences] - (np.cumsum(count) - count), count) + np.arange(len(ids))] = ids
    return out, total[np.searchsorted(at, row_at)]


def _drawn(v: Vocabulary, lattice: Lattice, points: np.ndarray, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of some occurrences of a lattice's units."""
    edges, begin_at, count = lattice.sample(unit, key)
    ids = lattice.ids[edges]
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        # a character in bytes becomes as many pieces
        points_of = points[lattice.point_of_tail[edges[bare]]]
        wide = np.ones(len(ids), np.int64)
        wide[bare] = utf8_size(points_of)
        ids = np.repeat(ids, wide)
        letters = spoken(points_of).astype(np.uint32).tobytes().decode("utf-32-le").encode()
        ids[np.flatnonzero(ids < 0)] = v.byte_id[np.frombuffer(letters, np.uint8)]
        count = np.add.reduceat(wide, begin_at)
    return ids, count


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    size = v.size[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    flat = v.bytes[np.repeat(v.first[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
    cut = total[offsets].tolist()
    return [flat[a:z] for a, z in zip(cut[:-1], cut[1:])]


def _keep(docs: DataFrame, *new: str) -> tuple[list[str], DataFrame, str]:
    names = [c for c in docs.columns if c not in new]
    rows = docs.select(*names)
    return names, rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def with_pieces(docs: DataFrame, v: Vocabulary, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` (with ``text``) plus ``pieces`` (ids; null for a null text), which
    replaces a column of this name."""
    names, rows, schema = _keep(docs, "pieces")
    held = docs.sparkSession.sparkContext.broadcast(v)
    seeded = spare(rows, "key_")
    rows = rows.withColumn(seeded, F.coalesce(docs[key].cast("bigint"), F.lit(0)))

    def run(b: pa.RecordBatch) -> dict:
        text = tk.column(b, "text")
        ids, off = encode(held.value, text, np.asarray(tk.column(b, seeded)), seed)
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), mask=pc.is_null(text))
        return {c: tk.column(b, c) for c in names} | {"pieces": lists}

    return scan(rows, run, f"{schema}, pieces array<int>")


def with_text(docs: DataFrame, v: Vocabulary, to: str = "text") -> DataFrame:
    """``docs`` (with ``pieces``) plus the text that the pieces stand for."""
    names, rows, schema = _keep(docs, to)
    held = docs.sparkSession.sparkContext.broadcast(v)

    def run(b: pa.RecordBatch) -> dict:
        lists = tk.column(b, "pieces")
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        texts = decode(held.value, np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(size)]))
        out = [t.decode() if ok else None for t, ok in zip(texts, pc.is_valid(lists).to_pylist())]
        return {c: tk.column(b, c) for c in names} | {to: out}

    return scan(rows, run, f"{schema}, `{to}` string")
