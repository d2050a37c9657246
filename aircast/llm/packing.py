"""Packing token ids into sequences: bounded-space online best-fit.

Each task tokenises its documents (token ids, then an end id) and keeps at most
``OPEN`` windows open.  A document goes whole into the window that it leaves
fullest (best fit).  Where none has room for it, a new window is opened; where all
``OPEN`` are in use, the fullest is filled up with the document's first ids, closed
and emitted, and the rest is placed in the same way.  Ids beyond a whole window are
windows of their own.  A task keeps its open windows, a few piece rows and no others.

At a task's end its emptiest windows are poured into the fullest, until one is left open.
These leftovers are merged as a tree: ``FAN`` tasks' leftovers are packed by
the same rule in one task, theirs again, until one window is left; its ids are
dealt to sequences whose lengths are powers of two.  So no sequence has padding, and
no task or driver sees more than ``FAN`` windows beside its own documents.

The tokeniser never joins what ``cut`` separates, so equal words of a batch are encoded
once, and a worker remembers up to ``WORDS`` of them.

Defined results: a null or empty text is the end id alone; rows that repeat an id are
documents of their own; a null doc_id stays null; a very long text fills windows of its own;
ties in fit go to the window opened first; an empty table has no pieces; other columns
of ``docs`` are not read, whatever their names.  A sequence's id is made of its task's number and its
number there; it is unique, not dense.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import materialize
from . import textkit as tk
from .frames import prepare

#: Vocabulary file; read on the driver and broadcast (under 2 MB).
MODEL = "/opt/tokenizers/word_bpe_49k.json"
SIZE = 4096
END = 2
OPEN = 64
FAN = 64
#: Words whose ids a worker remembers (about 100 bytes each).
WORDS = 300_000
#: Words that are encoded as one text.
TOGETHER = 512
#: A level of the tree has sequence ids of its own.
LEVEL = 1 << 56

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, part bigint"


#: Classes of bytes: white space, letters, other printable characters, digits, and the rest.
_SPACE, _LETTER, _SIGN, _DIGIT, _REST = range(5)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[tk.SPACE] = _SPACE


def cut(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces, first): the texts, lower-cased in ASCII, without ASCII white space, cut where the tokeniser's pattern
    always begins a new word: at white space, at digits, and between letters (ASCII and
    Latin-1) and signs, unless an apostrophe stands before letters.  Pieces of text i are
    [first[i], first[i + 1])."""
    kind = _CLASS[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3)
    latin = latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    before, here = kind[:-1], kind[1:]
    new = (before != here) & (before != _REST) & (here != _REST)
    new &= ~((raw[:-1] == 0x27) & (here == _LETTER))
    new |= (before == _DIGIT) & (here == _DIGIT)
    new |= (before == _SPACE) != (here == _SPACE)
    marks = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
    if len(marks):  # "<|" may begin a special token: such words stay whole
        edge = np.flatnonzero((before == _SPACE) != (here == _SPACE)) + 1
        word = np.searchsorted(edge, np.arange(1, len(raw)), "right")
        whole = np.isin(word, np.searchsorted(edge, marks, "right"))
        new &= ~whole | ((before == _SPACE) != (here == _SPACE))
        low = np.where(np.append(whole, whole[-1:]) | np.append(whole[:1], whole), raw, tk.LOWER[raw])
    else:
        low = tk.LOWER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = new
    if len(raw):
        edge[off] = edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    visible = kind[at[:-1]] != _SPACE if len(at) else np.zeros(0, bool)
    start, size = at[:-1][visible], np.diff(at)[visible]
    total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = low[kind != _SPACE]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(total), pa.py_buffer(flat)]), np.searchsorted(start, off)


class Tokens:
    """Token ids of whole batches of texts."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special]
        # a special token between two words separates their ids
        self.mark, self.between = special[0][0], special[0][1].content
        self.reset()

    def reset(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        texts = [self.between + self.between.join(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)]
        ids = [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([*ids, np.array([self.mark], np.int32)])
        mark = flat == self.mark
        return flat[~mark], np.diff(np.flatnonzero(mark)) - 1

    def _codes(self, words: list[bytes]) -> np.ndarray:
        got = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(got < 0)
        if len(self.code) + len(new) > WORDS and self.code:
            self.reset()
            return self._codes(words)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            odd = np.array([b"<|" in w or b"|>" in w for w in fresh])  # may hold a special token: alone
            order = np.argsort(odd, kind="stable")
            plain = len(fresh) - int(odd.sum())
            flat, size = self._encode([fresh[i].decode() for i in order[:plain].tolist()])
            more = [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([fresh[i].decode() for i in order[plain:].tolist()], add_special_tokens=False)]
            flat, size = np.concatenate([flat, *more]), np.append(size, [len(x) for x in more]).astype(np.int64)
            have = int(self.first[-1])
            if have + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[:have], np.zeros(have + 2 * len(flat), np.int32)])
            self.ids[have : have + len(flat)] = flat
            got[new[order]] = np.arange(len(self.code), len(self.code) + len(new))
            self.first = np.concatenate([self.first, have + np.cumsum(size)])
            self.code.update(zip(fresh, got[new].tolist()))
        return got

    def of(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]; null counts as empty."""
        words, row = cut(*tk.text_bytes(arr))
        words = words.dictionary_encode()
        code = self._codes(words.dictionary.to_pylist())[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64)
        start, size = self.first[code], self.first[code + 1] - self.first[code]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        return ids, total[row]


@lru_cache(1)
def worker_tokens(model: str) -> Tokens:
    """A worker keeps its words from task to task."""
    return Tokens(model)


class Packer:
    """Open windows.  A piece is (doc_id, start, ids, doc_tokens); ``closed`` gathers
    windows (lists of pieces) that are full."""

    def __init__(self, size: int = SIZE, open_windows: int = OPEN):
        self.size, self.most = size, open_windows
        self.room: list[tuple[int, int]] = []  # (free places, window), sorted
        self.windows: dict[int, list] = {}
        self.made = 0
        self.closed: list[list] = []

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        at = 0
        while len(ids) - at >= self.size:
            self.closed.append([(doc_id, start + at, ids[at : at + self.size], doc_tokens)])
            at += self.size
        while at < len(ids):
            rest = len(ids) - at
            i = bisect_left(self.room, (rest, -1))
            if i < len(self.room):
                free, w = self.room.pop(i)
                n = rest
            elif len(self.room) < self.most:
                free, w, n = self.size, self.made, rest
                self.windows[w] = []
                self.made += 1
            else:
                free, w = self.room.pop(0)
                n = free
            self.windows[w].append((doc_id, start + at, ids[at : at + n], doc_tokens))
            at += n
            if free == n:
                self.closed.append(self.windows.pop(w))
            else:
                insort(self.room, (free - n, w))

    def pour(self) -> list:
        """Close all windows but one, and return its pieces (none where all are full)."""
        left = [self.windows[w] for _, w in self.room]
        free = [f for f, _ in self.room]
        self.room, self.windows = [], {}
        while len(left) > 1:
            doc_id, start, ids, n = left[-1].pop()
            cut = min(free[0], len(ids))
            left[0].append((doc_id, start, ids[:cut], n))
            free[0] -= cut
            free[-1] += cut
            if cut < len(ids):
                left[-1].append((doc_id, start + cut, ids[cut:], n))
            if not free[0]:
                self.closed.append(left.pop(0))
                free.pop(0)
            if left and not left[-1]:
                left.pop()
                free.pop()
        return left[0] if left else []

    def take(self) -> list[list]:
        out, self.closed = self.closed, []
        return out


def powers_of_two(pieces: list) -> list[list]:
    """The pieces' ids as sequences whose lengths are falling powers of two."""
    out: list[list] = []
    free = 0
    left = sum(len(p[2]) for p in pieces)
    for doc_id, start, ids, n in pieces:
        at = 0
        while at < len(ids):
            if not free:
                free = 1 << (left.bit_length() - 1)
                out.append([])
            cut = min(free, len(ids) - at)
            out[-1].append((doc_id, start + at, ids[at : at + cut], n))
            at, free, left = at + cut, free - cut, left - cut
    return out


def _rows(windows: list[list], first_id: int, part: int | None, with_ids: bool, arrow: pa.Schema) -> pa.RecordBatch:
    """Piece rows; of open windows (``part`` set) with their ids and without a sequence."""
    flat = [(k, p) for k, w in enumerate(windows) for p in w]
    raw = [p[2].astype("<u4").tobytes() for _, p in flat]
    size = np.array([len(p[2]) for _, p in flat], np.int64)
    number = np.array([k for k, _ in flat], np.int64)
    before = np.cumsum(size) - size
    new = np.concatenate([[True], np.diff(number) > 0]) if len(flat) else np.zeros(0, bool)
    offset = before - np.maximum.accumulate(np.where(new, before, 0))
    cols = [
        [p[0] for _, p in flat], [p[1] for _, p in flat], size, [zlib.crc32(x) for x in raw], [p[3] for _, p in flat],
        first_id + number, offset, raw if with_ids or part is not None else [None] * len(flat), [part] * len(flat),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)


def _encode_and_pack(docs: DataFrame, model: str, size: int, end: int, open_windows: int, with_ids: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    arrow = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = worker_tokens(held.value), Packer(size, open_windows)
        task = TaskContext.get().partitionId()
        number = task << 32
        for b in batches:
            ids, off = tokens.of(tk.column(b, "text"))
            for i, doc_id in enumerate(tk.column(b, "doc_id").to_pylist()):
                own = np.append(ids[off[i] : off[i + 1]], np.int32(end))
                packer.add(doc_id, 0, own, len(own))
            full = packer.take()
            if full:
                yield _rows(full, number, None, with_ids, arrow)
                number += len(full)
        left = packer.pour()
        full = packer.take()
        if full:
            yield _rows(full, number, None, with_ids, arrow)
        if left:
            yield _rows([left], 0, task, True, arrow)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _schema() -> pa.Schema:
    return pa.schema([(f.name, f.type) for f in to_arrow_schema(_parse_datatype_string(PIECES))])


def _merge(left: DataFrame, level: int, last: bool, size: int, open_windows: int, with_ids: bool) -> DataFrame:
    """Pack the open windows of ``FAN`` parts together (all of them in the ``last`` level)."""
    arrow = _schema()

    def run(key: tuple, t: pa.Table) -> pa.Table:
        packer = Packer(size, open_windows)
        part = key[0].as_py()
        rows = sorted(t.select(["part", "offset", "doc_id", "start", "ids", "doc_tokens"]).to_pylist(), key=lambda r: (r["part"], r["offset"]))
        for r in rows:
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").astype(np.int64), r["doc_tokens"])
        rest = packer.pour()
        full = packer.take()
        if last and rest:
            full += powers_of_two(rest)
            rest = []
        out = [_rows(full, level * LEVEL + (part << 32), None, with_ids, arrow)] if full else []
        out += [_rows([rest], 0, part, True, arrow)] if rest else []
        return pa.Table.from_batches(out, schema=arrow)

    up = F.lit(0).cast("bigint") if last else F.floor(F.col("part") / FAN)
    return left.groupBy(up.alias("up")).applyInArrow(run, PIECES)


def pack(docs: DataFrame, model: str = MODEL, size: int = SIZE, end: int = END, open_windows: int = OPEN, with_ids: bool = False) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset; with ``with_ids`` also its ids (array<bigint>)."""
    prepare(docs.sparkSession)
    with open(model, encoding="utf-8") as f:
        text = f.read()
    got = materialize(  # so texts are tokenised once
        _encode_and_pack(docs, text, size, end, open_windows, with_ids)
    )
    out = [got.where("part IS NULL")]
    left, level, parts = got.where("part IS NOT NULL"), 1, got.where("part IS NOT NULL").agg(F.max("part")).first()[0]
    while parts is not None:
        merged = _merge(left, level, parts < FAN, size, open_windows, with_ids)
        if parts >= FAN:
            merged = materialize(merged)
        out.append(merged.where("part IS NULL"))
        left, level, parts = merged.where("part IS NOT NULL"), level + 1, parts // FAN if parts >= FAN else None
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not with_ids:
        return rows.select(*cols)
    return rows.select(*cols, _unpack("ids").alias("ids"))


def _unpack(c: str):
    """Little-endian 32-bit ids of a binary column as array<bigint>."""
    text = F.hex(F.col(c))

    def one(i):
        at = i * 8 + 1
        turned = F.concat(*(F.substr(text, at + F.lit(k), F.lit(2)) for k in (6, 4, 2, 0)))
        return F.conv(turned, 16, 10).cast("bigint")

    return F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), one)


def sequences(pieces: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """sequence_id, ids and used places of each sequence of ``pack(..., with_ids=True)``;
    sequences shorter than ``size`` are padded unless their length is a power of two."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    used = F.size("ids").cast("bigint")
    power = used.bitwiseAND(used - 1) == 0
    padded = F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad).cast("bigint"), size - F.size("ids"))))
    return rows.select("sequence_id", ids.alias("ids")).select("sequence_id", padded.alias("ids"), used.alias("n_used"))
