"""Cross-tokenizer alignment: groups of tokens of two tokenizers, and corpus counts of linked ids.

Two tokenisations of a text cut the same bytes.  Offsets where tokens of both end cut them
into groups, and two tokens whose byte ranges overlap are linked.  The count of
an id pair is the number of documents that hold it linked.

1. Every task aligns its documents and counts the pairs it finds; the counts go packed to a table.
2. The distinct pairs are merged bucket by bucket, as a tree, and each bucket gets a minimal
   perfect hash (``mphf``) with the pairs themselves in the order of their numbers.
3. The tasks' counts are added to dense vectors indexed by the hash; the vectors
   are summed as a tree.
4. A second pass aligns the documents again and looks up their pairs: the stored pair must
   be the one asked for.

Hashes and counts are broadcast in slices of at most ``SLICE_PAIRS`` pairs (all pairs of an A id are in one
slice; one slice is the usual case); with several, a document's sums of the
slices are added up.

Both tokenizers begin a new token at a space that follows a visible character, so texts are cut there,
equal pieces of a batch are encoded once, and a worker remembers up to
``MEMORY`` of them with their alignment.  Pieces in ASCII and Latin-1 letters are encoded together
by ranks, others by the A file itself (the same vocabulary and merges).

Defined results: a text that is null or empty, or whose tokens of either side don't spell
space + text, has no tokens: zeros and an empty digest; rows that repeat an id are
documents of their own; a null doc_id stays null; texts are read whole, whatever their length; ties for an
A id's highest count all count as best; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import Scratch, prepare, scan, scan_state
from .mphf import PerfectHash

#: Vocabulary files; read on the driver and broadcast (under 4 MB together).
A_MODEL, A_RANKS, B_MODEL = (f"/opt/tokenizers/{x}" for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
#: Fixed value: the public pattern that splits a text for the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of text that a worker remembers (about 200 bytes each).
MEMORY = 300_000
#: Pieces that are encoded as one text.
TOGETHER = 512
#: Distinct pairs that a task holds before it writes them down.
HELD = 2_000_000
#: Pairs of a bucket, about; buckets in which tasks deal out their pairs.
BUCKET = 1 << 17
DEALT = 32
#: Pairs broadcast at once (16 bytes each).
SLICE_PAIRS = 4_000_000
#: Packed rows that meet in one step of a tree.
FAN = 64
#: Slots of a count vector that travel together.
BLOCK = 1 << 16

RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(x, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x.as_buffer() if isinstance(x, pa.Scalar) else x), kind)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


@dataclass(frozen=True)
class Models:
    """The files' contents, as they are sent to the executors."""

    a: str
    ranks: bytes
    b: bytes

    @classmethod
    def read(cls, a: str = A_MODEL, ranks: str = A_RANKS, b: str = B_MODEL) -> "Models":
        with open(a, encoding="utf-8") as f, open(ranks, "rb") as g, open(b, "rb") as h:
            return cls(f.read(), g.read(), h.read())


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 ones
    for themselves, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Spelled:
    """What the ids of a vocabulary stand for, in bytes, and their decimal texts."""

    def __init__(self, tokens: list[bytes], last: bytes):
        """``last``: what stands after the last id of a group's side."""
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.texts = pa.array([b"%d%s" % (i, end) for end in (b",", last) for i in range(len(tokens))], pa.large_binary())

    def text(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.flat[np.repeat(self.first[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Tokenizers:
    def __init__(self, m: Models):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(m.a)
        self.a.encode_special_tokens = True
        ranks = {base64.b64decode(w): int(r) for w, r in (x.split() for x in m.ranks.splitlines() if x)}
        self.by_rank = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        letters = _byte_letters()
        vocabulary = json.loads(m.a)["model"]["vocab"]
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for w, i in vocabulary.items():
            if all(c in letters for c in w):
                spelled[i] = bytes(letters[c] for c in w)
        self.of_a = Spelled(spelled, b"|")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=m.b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_b = Spelled([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], b";")
        self.space = self.b.piece_to_id("▁")
        # a space, then ASCII and Latin-1 letters that begin and end with a visible character
        self.simple = re.compile(r" (?![ \n\t])[ \n\t\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?<![ \n\t])\Z")

    def encode(self, pieces: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order of the pieces, their ids of A and how many each has, the same of B.  A piece
        that either side doesn't spell has no ids."""
        simple = [i for i, p in enumerate(pieces) if self.simple.match(p)]
        rest = sorted(set(range(len(pieces))) - set(simple)) if len(simple) < len(pieces) else []
        a, n_a, b, n_b, done = [], [], [], [], []
        for k in range(0, len(simple), TOGETHER):
            # one after the other: both sides begin anew at each piece
            own = [pieces[i] for i in simple[k : k + TOGETHER]]
            text = "".join(own)
            ids_a, ids_b = (np.array(x, np.int64) for x in (self.by_rank.encode_ordinary(text), self.b.encode(text[1:])))
            end = np.cumsum([len(p.encode()) for p in own])
            raw = np.frombuffer(text.encode(), np.uint8)
            cuts = [np.searchsorted(np.cumsum(of.size[ids]), end) + 1 for of, ids in ((self.of_a, ids_a), (self.of_b, ids_b))]
            if not all(
                np.array_equal(of.text(ids), raw) and np.array_equal(np.cumsum(of.size[ids])[cut - 1], end)
                for of, ids, cut in ((self.of_a, ids_a, cuts[0]), (self.of_b, ids_b, cuts[1]))
            ):
                rest = [*rest, *simple[k : k + TOGETHER]]  # one by one
                continue
            done += simple[k : k + TOGETHER]
            a.append(ids_a)
            b.append(ids_b)
            n_a.append(np.diff(cuts[0], prepend=0))
            n_b.append(np.diff(cuts[1], prepend=0))
        odd_a = self.a.encode_batch([pieces[i] for i in rest], add_special_tokens=False) if rest else []
        odd_b = self.b.encode([pieces[i][1:] for i in rest], num_threads=1) if rest else []
        for i, x, y in zip(rest, odd_a, odd_b):
            # the space that B puts first is the piece's own; alone it ends a text
            x, y = np.array(x.ids, np.int64), np.array([self.space] if pieces[i] == " " else y, np.int64)
            raw = pieces[i].encode()
            if self.of_a.text(x).tobytes() != raw or self.of_b.text(y).tobytes() != raw:
                x = y = np.zeros(0, np.int64)
            a.append(x)
            b.append(y)
            n_a.append([len(x)])
            n_b.append([len(y)])
        return [*done, *rest], *(np.concatenate(x).astype(np.int64) for x in (a, n_a, b, n_b))


class Rows:
    """Growing rows of varying length in one array."""

    def __init__(self, kind: type):
        self.flat, self.first = np.zeros(1 << 12, kind), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        have = int(self.first[-1])
        if have + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:have], np.zeros(have + 2 * len(flat), self.flat.dtype)])
        self.flat[have : have + len(flat)] = flat
        self.first = np.concatenate([self.first, have + np.cumsum(size)])

    def size(self, rows: np.ndarray) -> np.ndarray:
        return self.first[rows + 1] - self.first[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        size = self.size(rows)
        return self.flat[np.repeat(self.first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def links(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of all overlapping byte ranges of two cuts of the same bytes."""
    start_a = np.concatenate([[0], end_a[:-1]])
    start_b = np.concatenate([[0], end_b[:-1]])
    lo = np.searchsorted(end_b, start_a, "right")
    n = np.searchsorted(start_b, end_a, "left") - lo
    a = np.repeat(np.arange(len(end_a)), n)
    return a, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Aligner:
    """Alignments of the pieces that a worker has seen, by their codes."""

    def __init__(self, models: Models, texts: bool):
        """``texts``: whether the groups are written out."""
        self.t, self.texts = Tokenizers(models), texts
        self.words = pa.concat_arrays([self.t.of_a.texts, self.t.of_b.texts])
        self.reset()

    def reset(self) -> None:
        self.code: dict[bytes, int] = {}
        self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(3))
        self.pairs, self.groups = Rows(np.int64), Rows(np.uint8)

    def codes(self, pieces: list[bytes]) -> np.ndarray:
        got = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(got < 0)
        if self.code and len(self.code) + len(new) > MEMORY:
            self.reset()
            return self.codes(pieces)
        if len(new):
            order = self._align([pieces[i].decode() for i in new.tolist()])
            got[new[order]] = np.arange(len(self.code), len(self.code) + len(new))
            self.code.update(zip([pieces[i] for i in new.tolist()], got[new].tolist()))
        return got

    def _align(self, pieces: list[str]) -> list[int]:
        """Append the pieces' alignments, in the order that is returned."""
        order, ids_a, n_a, ids_b, n_b = self.t.encode(pieces)
        # pieces stand one after the other and both sides end with each of them
        end_a, end_b = np.cumsum(self.t.of_a.size[ids_a]), np.cumsum(self.t.of_b.size[ids_b])
        la, lb = links(end_a, end_b)
        of_a = np.repeat(np.arange(len(pieces)), n_a)
        self.pairs.add(pair_keys(ids_a[la], ids_b[lb]), np.bincount(of_a[la], minlength=len(pieces)))
        both_a = np.isin(end_a, end_b)
        if self.texts and len(ids_a):
            both_b = np.isin(end_b, end_a)
            # tokens of A, then of B, group after group
            cut_a, cut_b = np.flatnonzero(both_a) + 1, np.flatnonzero(both_b) + 1
            group_a = np.cumsum(both_a) - both_a
            group_b = np.cumsum(both_b) - both_b
            at_a = np.arange(len(ids_a)) + np.append(0, cut_b)[group_a]
            at_b = np.arange(len(ids_b)) + cut_a[group_b]
            word = np.empty(len(ids_a) + len(ids_b), np.int64)
            top = len(self.t.of_a.texts)
            word[at_a] = ids_a + both_a * len(self.t.of_a.tokens)
            word[at_b] = top + ids_b + both_b * len(self.t.of_b.tokens)
            raw, off = tk.text_bytes(self.words.take(pa.array(word)), pa.large_binary())
            self.groups.add(raw, np.diff(off[np.concatenate([[0], np.cumsum(n_a + n_b)])]))
        elif self.texts:
            self.groups.add(np.zeros(0, np.uint8), np.zeros(len(pieces), np.int64))
        for name, x in (("n_a", n_a), ("n_b", n_b), ("n_groups", np.bincount(of_a[both_a], minlength=len(pieces)))):
            setattr(self, name, np.append(getattr(self, name), x))
        return order

    def batch(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(codes, offsets) of the pieces of each text; none for a text without tokens."""
        pieces, first = cut(arr)
        coded = pieces.dictionary_encode()
        code = self.codes(coded.dictionary.to_pylist())[np.asarray(coded.indices)] if len(pieces) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        lost = np.bincount(row[self.n_a[code] == 0], minlength=len(first) - 1) > 0 if len(code) else np.zeros(len(first) - 1, bool)
        keep = ~lost[row]
        size = np.where(lost, 0, np.diff(first))
        return code[keep], np.concatenate([[0], np.cumsum(size)])


@lru_cache(1)
def worker_aligner(models: Models, texts: bool) -> Aligner:
    """A worker keeps its pieces from task to task."""
    return Aligner(models, texts)


def cut(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, first): space + text of all texts, cut at each space after a visible character."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    some = np.asarray(pc.greater(pc.binary_length(arr), 0))
    space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    arr = pc.binary_join_element_wise(pc.if_else(pa.array(some), space, none), arr, none)
    raw, off = tk.text_bytes(arr)
    at = np.flatnonzero(raw == 32)
    at = at[at > 0]
    p1, p2, p3 = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    visible = (p1 > 0x20) & (p1 != 0x7F)
    # white space beyond ASCII begins with one of these bytes; there (and at the sign that B writes
    # for a space) no cut is made
    visible &= ~((p1 >= 0x80) & ((p2 == 0xC2) | ((p3 >= 0xE1) & (p3 <= 0xE3))))
    start = np.union1d(at[visible], off[:-1][some])
    end = np.append(start, len(raw))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(end.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces, np.searchsorted(start, off)


def local_counts(docs: DataFrame, models) -> DataFrame:
    """(part, pairs, counts): what each task counts, sorted pairs packed."""

    def make():
        aligner = worker_aligner(models.value, False)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush() -> dict | None:
            nonlocal keys, n
            if not len(keys):
                return None
            out = {"part": [TaskContext.get().partitionId()], "pairs": [pack(keys)], "counts": [pack(n)]}
            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return out

        def fn(b: pa.RecordBatch) -> dict | None:
            nonlocal keys, n
            code, off = aligner.batch(tk.column(b, "text"))
            if not len(code):
                return None
            # pieces of a document once, then their pairs once
            top = int(code.max()) + 1
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            once = tk.distinct(row * top + code)
            pair = aligner.pairs.take(once % top)
            distinct, at = np.unique(pair, return_inverse=True)
            row = np.repeat(once // top, aligner.pairs.size(once % top))
            at = tk.distinct(row * len(distinct) + at) % max(len(distinct), 1)
            keys, n = _add(keys, n, distinct, np.bincount(at, minlength=len(distinct)))
            return flush() if len(keys) > HELD else None

        return fn, flush

    return scan_state(docs.select("text"), make, "part bigint, pairs binary, counts binary")


def _add(k1: np.ndarray, n1: np.ndarray, k2: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k1, k2]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n1, n2]).astype(float), len(keys)).astype(np.int64)


def _tree(parts: DataFrame, merge, steps: int = 3) -> DataFrame:
    """(bucket, part, data) -> (bucket, part 0, data): rows of a bucket meet ``FAN`` tasks at a time."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        data = merge([x.as_buffer() for x in t.column("data")])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    for step in range(steps):
        up = F.floor(F.col("part") / FAN) if step < steps - 1 else F.lit(0).cast("bigint")
        parts = parts.select("bucket", up.alias("part"), "data").groupBy("bucket", "part").applyInArrow(run, "bucket bigint, part bigint, data binary")
    return parts


def _hash(keys: np.ndarray) -> np.ndarray:
    return tk.mix(keys.view(np.uint64))


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """All pairs of an A id are in one slice."""
    return (tk.mix((keys >> 32).view(np.uint64)) % tk.U(slices)).astype(np.int64)


def distinct_pairs(local: DataFrame) -> DataFrame:
    """(bucket, part, data): the corpus' pairs, sorted and packed, in ``DEALT`` buckets by hash."""

    def deal(b: pa.RecordBatch) -> dict:
        out: dict = {"bucket": [], "part": [], "data": []}
        for part, x in zip(tk.column(b, "part").to_pylist(), tk.column(b, "pairs")):
            keys = unpack(x, np.int64)
            at = (_hash(keys) % tk.U(DEALT)).astype(np.int64)
            for i in np.unique(at).tolist():
                out["bucket"].append(i)
                out["part"].append(part)
                out["data"].append(pack(keys[at == i]))
        return out

    def merge(rows: list) -> bytes:
        return pack(np.unique(np.concatenate([unpack(x, np.int64) for x in rows])))

    return _tree(scan(local, deal, "bucket bigint, part bigint, data binary"), merge)


class Index:
    """Pairs of one slice: in each bucket a perfect hash, and the pairs in the order of their numbers."""

    def __init__(self, buckets: list[tuple[PerfectHash, np.ndarray]]):
        self.buckets = buckets
        self.base = np.cumsum([0] + [len(k) for _, k in buckets])
        self.n = int(self.base[-1])

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate([k for _, k in self.buckets]) if self.buckets else np.zeros(0, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``, -1 for those that aren't there."""
        out = np.full(len(keys), -1, np.int64)
        of = (_hash(keys) >> tk.U(40)).astype(np.int64) % max(len(self.buckets), 1)
        for i, (h, own) in enumerate(self.buckets):
            at = np.flatnonzero(of == i)
            slot = h.numbers(keys[at].view(np.uint64))
            right = slot >= 0
            right[right] = own[slot[right]] == keys[at[right]]
            out[at[right]] = self.base[i] + slot[right]
        return out


def build_index(pairs: DataFrame, slice_: int, slices: int, buckets: int) -> Index:
    """Perfect hashes of the buckets of one slice, each built in a task of its own."""

    def deal(b: pa.RecordBatch) -> dict:
        out: dict = {"bucket": [], "data": []}
        for x in tk.column(b, "data"):
            keys = unpack(x, np.int64)
            keys = keys[_slice_of(keys, slices) == slice_]
            at = (_hash(keys) >> tk.U(40)).astype(np.int64) % buckets
            for i in np.unique(at).tolist():
                out["bucket"].append(i)
                out["data"].append(pack(keys[at == i]))
        return out

    def build(key: tuple, t: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x, np.int64) for x in t.column("data")])
        h = PerfectHash.build(keys.view(np.uint64))
        own = np.empty(len(keys), np.int64)
        own[h.numbers(keys.view(np.uint64))] = keys
        return pa.table({
            "bucket": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([h.sizes], pa.list_(pa.int64())),
            "bits": pa.array([h.packed.tobytes()], pa.binary()), "pairs": pa.array([pack(own)], pa.binary()),
        })

    rows = scan(pairs, deal, "bucket bigint, data binary").groupBy("bucket").applyInArrow(build, "bucket bigint, sizes array<bigint>, bits binary, pairs binary")
    got = {r.bucket: (PerfectHash(r.sizes, np.frombuffer(r.bits, np.uint8)), unpack(bytes(r.pairs), np.int64)) for r in rows.collect()}
    none = PerfectHash([], np.zeros(0, np.uint8)), np.zeros(0, np.int64)
    return Index([got.get(i, none) for i in range(buckets)])


def total_counts(local: DataFrame, index: Index, held) -> np.ndarray:
    """Documents of each slot: the tasks' dense vectors, summed block by block as a tree."""

    def make():
        total = np.zeros(-(-max(index.n, 1) // BLOCK) * BLOCK, np.int64)

        def fn(b: pa.RecordBatch) -> None:
            for keys, n in zip(tk.column(b, "pairs"), tk.column(b, "counts")):
                slot = held.value.slots(unpack(keys, np.int64))
                total[slot[slot >= 0]] += unpack(n, np.int64)[slot >= 0]

        def close() -> dict:
            blocks = total.reshape(-1, BLOCK)
            some = np.flatnonzero(blocks.any(1)).tolist()
            return {"bucket": some, "part": [TaskContext.get().partitionId()] * len(some), "data": [pack(blocks[i]) for i in some]}

        return fn, close

    def merge(rows: list) -> bytes:
        total = np.zeros(BLOCK, np.int64)
        for x in rows:
            total += unpack(x, np.int64)
        return pack(total)

    out = np.zeros((-(-max(index.n, 1) // BLOCK), BLOCK), np.int64)
    for r in _tree(scan_state(local, make, "bucket bigint, part bigint, data binary"), merge).collect():
        out[r.bucket] = unpack(bytes(r.data), np.int64)
    return out.ravel()[: index.n]


@dataclass
class Counted:
    """A slice as it is broadcast: pairs, their counts, and whether each is its A id's best."""

    index: Index
    count: np.ndarray
    best: np.ndarray

    @classmethod
    def of(cls, index: Index, count: np.ndarray) -> "Counted":
        a = index.keys >> 32
        top = np.zeros(int(a.max()) + 1 if len(a) else 0, np.int64)
        np.maximum.at(top, a, count)
        return cls(index, count, count == top[a])


def look_up(rows: DataFrame, models, counted, slices: int, first: bool) -> DataFrame:
    """Per row (row, doc_id, text) what it has and the sums over the links of a slice (see ``RESULT``);
    the columns that don't depend on counts only in the ``first`` slice."""

    def make():
        aligner = worker_aligner(models.value, first)

        def fn(b: pa.RecordBatch) -> dict:
            code, off = aligner.batch(tk.column(b, "text"))
            distinct, at = np.unique(code, return_inverse=True)
            pair, owner = aligner.pairs.take(distinct), np.repeat(np.arange(len(distinct)), aligner.pairs.size(distinct))
            one, back = np.unique(pair, return_inverse=True)
            slot = counted.value.index.slots(one)
            known = slot >= 0
            if slices == 1 and not known.all():
                raise ValueError("a linked pair without a count")
            count, best = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
            count[known], best[known] = counted.value.count[slot[known]], counted.value.best[slot[known]]

            def per_doc(of_piece: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(of_piece[at])])
                return total[off[1:]] - total[off[:-1]]

            def summed(x: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(x[back])])
                cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(distinct)))])
                return per_doc(total[cut[1:]] - total[cut[:-1]])

            out = {"row": tk.column(b, "row"), "doc_id": tk.column(b, "doc_id"), "n_best": summed(best), "count_sum": summed(count)}
            if not first:
                return out | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), np.zeros(b.num_rows, np.int64)) | {"groups": [None] * b.num_rows}
            text = aligner.groups.take(code).tobytes()
            cuts = np.concatenate([[0], np.cumsum(aligner.groups.size(code))])[off].tolist()
            spelled = [text[x : max(y - 1, x)].decode() for x, y in zip(cuts[:-1], cuts[1:])]  # without the last semicolon
            for name in ("n_a", "n_b", "n_groups"):
                out[name] = per_doc(getattr(aligner, name)[distinct])
            return out | {"n_links": per_doc(aligner.pairs.size(distinct)), "groups": spelled}

        return fn, lambda: None

    return scan_state(rows, make, "row bigint, doc_id bigint, " + ", ".join(f"{c} bigint" for c in RESULT) + ", groups string")


def align(docs: DataFrame, models: Models | None = None, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """doc_id, the columns of ``RESULT`` and ``groups`` ('a1,a2|b1;a3|b2,b3') of each row of ``docs`` (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(models or Models.read())
    with Scratch(spark, "align") as scratch:
        local = scratch.table(local_counts(docs, held), "local")
        pairs = scratch.table(distinct_pairs(local), "pairs")
        sized = scan(pairs, lambda b: {"n": [sum(len(unpack(x, np.int64)) for x in tk.column(b, "data"))]}, "n bigint")
        n = sized.agg(F.sum("n")).first()[0] or 0
        slices = 1 if n <= slice_pairs else -(-2 * n // slice_pairs)  # half-filled on average
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        if slices > 1:
            rows = scratch.table(rows, "rows")  # a row keeps its number in all passes
        found = []
        for i in range(slices):
            index = build_index(pairs, i, slices, max(1, -(-n // slices // BUCKET)))
            counted = Counted.of(index, total_counts(local, index, spark.sparkContext.broadcast(index)))
            part = look_up(rows, held, spark.sparkContext.broadcast(counted), slices, i == 0)
            if slices == 1:
                return part.drop("row")
            found.append(scratch.table(part, f"slice{i}"))
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        added = [F.sum(c).alias(c) for c in RESULT]
        return scratch.keep(every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *added, F.max("groups").alias("groups")).drop("row"))


def digest(aligned: DataFrame) -> DataFrame:
    """The groups as a hash ('' without tokens)."""
    sha = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned.select("doc_id", *RESULT, sha.alias("groups_sha256"))

