"""Secret scans with multipart credential linking.

Strong findings (kinds assign, access, hex) are reported on sight.  Weak candidates
are parts that mean little alone: an identifier (``user = x``), a mixed long token,
an endpoint (URL or IPv4 address).  They are reported only where a complementary
part lies in their scope: an identifier or an endpoint needs a secret, a token needs an
identifier or an endpoint.  Strong findings count as parts too.

A scope is a distance: the gap between two spans is at most ``SCOPE`` code points.
The interval join deals each part to the cells of SCOPE code points that it
covers, sums each (text, role, cell) to its first start and last end, and
joins each candidate to the cells within its reach.  So a text full of
parts costs its cells, not its pairs.

Positions are code points, ends exclusive.  A null or empty text has no spans; a weak
candidate that overlaps a strong span is part of it and not reported again; rows
that repeat a doc_id are scanned each for itself; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import Scratch, scan

KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
SCOPE = 200

# The patterns (ASCII, so they match on UTF-8 bytes as on code
# points).  WORD_CASE spells letters in either case, without Unicode folding.


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
IDENT_WORDS = ("access_?key_?id", "client_?id", "user_?name", "user", "login", "account")
ASSIGN = f"(?:{'|'.join(map(_either_case, ASSIGN_WORDS))}){_SET}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
IDENT = f"(?:{'|'.join(map(_either_case, IDENT_WORDS))}){_SET}([A-Za-z0-9@._-]+)"
TOKEN = "[A-Za-z0-9+/_-]+"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x09-\x0D\x20"'<>]+|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(?::[0-9]+)?"""

# runs of one class: asking for the least length in the pattern gives the same matches
_HEX = re.compile(b"[0-9a-f]{24,}")
_ACCESS = re.compile(b"AKIA[A-Z0-9]{16,}")
_TOKEN = re.compile(b"[A-Za-z0-9+/_-]{20,}")
_ASSIGN, _IDENT, _ENDPOINT = (re.compile(p.encode()) for p in (ASSIGN, IDENT, ENDPOINT))


def _mixed(t: bytes) -> bool:
    return t.lower() != t and t.upper() != t and any(48 <= c <= 57 for c in t)


def strong(t: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t)]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(t)])


def weak(t: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = [(m.start(), 3, m.end()) for m in _IDENT.finditer(t) if m.end(1) - m.start(1) >= 3]
    out += [(m.start(), 4, m.end()) for m in _TOKEN.finditer(t) if _mixed(m[0])]
    out += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(t)]
    out.sort()
    if not taken or not out:
        return out
    # strong spans of different kinds may overlap, so their ends are carried along
    starts = np.array([s for s, _, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, _, e in taken]))
    before = np.searchsorted(starts, [e for _, _, e in out])  # strong spans that start before the end
    return [x for x, k in zip(out, before.tolist()) if not k or ends[k - 1] <= x[0]]


def candidates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, strong and weak spans (s, kind, e) of each row."""

    def run(b: pa.RecordBatch) -> dict:
        raw, off = tk.text_bytes(tk.column(b, "text"))
        whole = raw.tobytes()
        out: dict = {"rid": tk.column(b, "rid"), "doc_id": tk.column(b, "doc_id"), "strong": [], "weak": []}
        for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
            t = whole[a:z]
            found = strong(t)
            more = weak(t, found)
            at = tk.code_point_index(raw[a:z]) if found or more else None
            for name, x in (("strong", found), ("weak", more)):
                out[name].append([{"s": int(at[s]), "kind": k, "e": int(at[e])} for s, k, e in x])
        return out

    span = "array<struct<s:bigint,kind:int,e:bigint>>"
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return scan(rows, run, f"rid bigint, doc_id bigint, strong {span}, weak {span}")


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rid and its weak spans that have a complementary part in scope."""
    # roles: 0 identifier, 1 secret, 2 endpoint
    role = F.when(F.col("kind").isin(0, 2, 4), 1).when(F.col("kind") == 5, 2).otherwise(0)
    parts = rows.select("rid", F.explode(F.concat("strong", "weak")).alias("x")).select("rid", "x.*").withColumn("role", role)
    cells = (
        parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / scope), F.floor((F.col("e") - 1) / scope))))
        .groupBy("rid", "cell", "role")
        .agg(
            F.min(F.greatest("s", F.col("cell") * scope)).alias("first"),
            F.max(F.least("e", (F.col("cell") + 1) * scope)).alias("last"),
        )
    )
    reach = F.sequence(F.floor((F.col("s") - scope - 1) / scope), F.floor((F.col("e") + scope) / scope))
    wanted = parts.where("kind >= 3").withColumn("cell", F.explode(reach))
    meets = (
        ((F.col("role") == 1) != (F.col("other") == 1))  # a secret, and something that is none
        & (F.col("last") >= F.col("s") - scope)
        & (F.col("first") <= F.col("e") + scope)
    )
    return (
        wanted.join(cells.withColumnRenamed("role", "other"), ["rid", "cell"])
        .where(meets)
        .groupBy("rid")
        .agg(F.collect_set(F.struct("s", "kind", "e")).alias("more"))
    )


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, strong and all spans (arrays of (s, kind, e), sorted) for each row of ``docs``."""
    with Scratch(docs.sparkSession, "secrets") as scratch:
        rows = scratch.table(candidates(docs), "candidates")
        more = linked(rows.where(F.size("weak") > 0), scope)
        both = rows.join(more, "rid", "left")
        spans = F.when(F.col("more").isNull(), F.col("strong")).otherwise(F.array_sort(F.concat("strong", "more")))
        return scratch.keep(both.select("doc_id", "strong", spans.alias("spans")))


def written(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def n(kind: int):
        return F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(written(F.col("strong")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
