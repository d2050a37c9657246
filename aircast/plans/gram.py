"""Normal-equation sums by aggregation, and the small per-series solves.

A design vector ``x`` (ARRAY<DOUBLE>, x[0] = 1) and a target ``y`` are
reduced to X'X, X'y and y'y.  ``fit`` adds up whole matrices: each Arrow batch
gives one packed matrix for every series in it, wherever its rows are (a long
series is spread over many tasks), and only these meet by series, sorted by Spark: a task
adds up and solves ``NUMBERS`` worth of systems at once, and holds no more of its partition.
``gram_exprs`` states the same sums as SQL aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import ship_package

#: Rows whose products are formed at once.
STEP = 1024
#: Numbers of the square matrices that are held at once (8 bytes each): so many series are added up or solved together.
NUMBERS = 1 << 18
#: Bytes of an Arrow batch: a packed matrix has up to 18 kB, so 10,000 rows (Spark's bound) would be 180 MB of a worker.
BATCH_BYTES = 4 << 20


def upper_pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def gram_exprs(x: Column, y: Column, p: int, over=None, prefix: str = "") -> list[Column]:
    """Aggregates (or window aggregates with ``over``) for the sums; output
    columns n, xtx, xty, yty (with an optional name prefix)."""
    def agg(e):
        s = F.sum(e)
        return s.over(over) if over is not None else s

    cnt = F.count(F.lit(1)).over(over) if over is not None else F.count(F.lit(1))
    xtx = F.array(*[agg(x[i] * x[j]) for i, j in upper_pairs(p)]).alias(prefix + "xtx")
    xty = F.array(*[agg(x[i] * y) for i in range(p)]).alias(prefix + "xty")
    return [cnt.alias(prefix + "n"), xtx, xty, agg(y * y).alias(prefix + "yty")]


def full_gram(upper: np.ndarray, p: int) -> np.ndarray:
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = upper
    return g + np.triu(g, 1).T


def ridge_from_sums(g: np.ndarray, xty: np.ndarray, use: np.ndarray, std: np.ndarray, pen: np.ndarray, lam: float):
    """Solve (Z'Z + lam*D) c = Z'y in standardised units and return raw
    coefficients (prediction = x . beta), a status and the dropped terms.

    Column 0 must be the constant 1, so n, means and variances come from
    the sums.  Columns flagged ``std`` are scaled to mean 0 / sd 1; a column
    without spread is dropped (coefficient 0)."""
    p = len(xty)
    n = g[0, 0]
    if n <= 0:
        return np.full(p, np.nan), "empty", []
    m = g[0] / n
    var = np.diag(g) / n - m * m
    idx = [i for i in range(p) if use[i]]
    dropped = []
    keep = []
    for i in idx:
        if i == 0 or var[i] > 1e-12 * (1.0 + m[i] * m[i]):
            keep.append(i)
        else:
            dropped.append(i)
    a = np.eye(p)
    for i in keep:
        if std[i] and i != 0:
            s = np.sqrt(var[i])
            a[i, :] = 0.0
            a[i, i] = 1.0 / s
            a[i, 0] = -m[i] / s
    k = np.array(keep, dtype=int)
    za = a[k]
    zz = za @ g @ za.T
    zy = za @ xty
    d = np.diag([lam if pen[i] else 0.0 for i in keep])
    status = "ok"
    try:
        c = np.linalg.solve(zz + d, zy)
        if not np.all(np.isfinite(c)):
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        c = np.linalg.lstsq(zz + d, zy, rcond=None)[0]
        status = "singular"
    beta = np.zeros(p)
    beta[:] = za.T @ c
    return beta, status, dropped


def codes(columns: Sequence[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): the groups of equal rows of some columns: the first row of each group and
    the group of each row.  Without columns all rows are one group."""
    key = np.zeros(n, np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        key = np.unique(key * (len(d.dictionary) + 1) + np.asarray(d.indices), return_inverse=True)[1]
    _, first, code = np.unique(key, return_index=True, return_inverse=True)
    return first, code


def matrix(col: pa.Array) -> np.ndarray:
    """An ARRAY<DOUBLE> column of equal lengths as rows of a matrix."""
    flat = np.asarray(col.flatten(), dtype=float)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def group_sums(rows: np.ndarray, code: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows by group."""
    order = np.argsort(code, kind="stable")
    cut = np.searchsorted(code[order], np.arange(groups))
    return np.add.reduceat(rows[order], cut, axis=0) if len(rows) else np.zeros((groups, rows.shape[1]))


def outer_sums(z: np.ndarray, code: np.ndarray, groups: int) -> np.ndarray:
    """The packed upper triangles of the sums of z z' by group, ``STEP`` rows at a time."""
    i, j = np.triu_indices(z.shape[1])
    out = np.zeros((groups, len(i)))
    order = np.argsort(code, kind="stable")
    for a in range(0, len(z), STEP):
        own = order[a : a + STEP]
        some, at = np.unique(code[own], return_inverse=True)
        out[some] += group_sums(z[own][:, i] * z[own][:, j], at, len(some))
    return out


def unpacked(upper: np.ndarray, p: int) -> np.ndarray:
    """(S, p, p) symmetric matrices from packed upper triangles."""
    i, j = np.triu_indices(p)
    out = np.zeros((len(upper), p, p))
    out[:, i, j] = upper
    out[:, j, i] = upper
    return out


Solver = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray], "dict[str, object]"]


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded by their bytes, and the package on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)


def arrow_schema(schema: str) -> pa.Schema:
    """On the driver: it asks the session."""
    return pa.schema([(f.name, f.type) for f in to_arrow_schema(_parse_datatype_string(schema))])


def record(cols: dict, arrow: pa.Schema) -> pa.RecordBatch:
    out = []
    for f in arrow:
        c = cols[f.name]
        if isinstance(c, np.ndarray) and c.ndim == 2:
            c = pa.ListArray.from_arrays(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1], pa.array(np.ascontiguousarray(c).ravel()))
        out.append(c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type))
    return pa.RecordBatch.from_arrays(out, schema=arrow)


def fit(df: DataFrame, keys: Sequence[str], solver: Solver, schema: str, *, x: str = "x", y: str = "y",
        carry: Sequence[str] = (), greatest: Sequence[str] = ()) -> DataFrame:
    """One row per series: keys, ``carry`` (columns that are constant in a series), n, and what
    ``solver`` makes of (carried columns, X'X, X'y, y'y) of many series at once
    (columns of ``schema``).  ``greatest``: columns whose largest absolute values come as ``top``."""
    keys, carry, greatest = list(keys), list(carry), list(greatest)
    prepare(df.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    own = "".join(f"`{c}` {kind[c]}, " for c in keys + carry)
    part_schema, out_schema = own + "n bigint, p int, top array<double>, sums binary", own + "n bigint, " + schema
    part_arrow, out_arrow = arrow_schema(part_schema), arrow_schema(out_schema)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first, code = codes([b.column(c) for c in keys], b.num_rows)
            z = np.column_stack([matrix(b.column(x)), np.asarray(b.column(y), dtype=float)])
            most = np.column_stack([np.zeros(b.num_rows), *[np.abs(np.asarray(b.column(c), dtype=float)) for c in greatest]])[:, 1:]
            order, some = np.argsort(code, kind="stable"), at_once(z.shape[1])
            for lo in range(0, len(first), some):
                own = first[lo : lo + some]
                at = order[slice(*np.searchsorted(code[order], [lo, lo + len(own)]))]
                sums = outer_sums(z[at], code[at] - lo, len(own))
                top = np.zeros((len(own), len(greatest)))
                np.maximum.at(top, code[at] - lo, most[at])
                cols = {c: b.column(c).take(pa.array(own)) for c in keys + carry}
                counts = np.bincount(code[at] - lo)
                yield record(cols | {"n": counts, "p": np.full(len(own), z.shape[1]), "top": top, "sums": [s.tobytes() for s in sums]}, part_arrow)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the sums so far of the last series, which may go on

        def added(t: pa.RecordBatch) -> tuple[dict, np.ndarray, int, int]:
            """(columns, sums, number of the series that ends the rows, p) of the series in some rows."""
            first, code = codes([t.column(c) for c in keys], t.num_rows)
            sums = group_sums(np.frombuffer(b"".join(t.column("sums").to_pylist())).reshape(t.num_rows, -1), code, len(first))
            n, top = np.bincount(code, np.asarray(t.column("n"))).astype(np.int64), np.zeros((len(first), len(greatest)))
            if greatest:
                np.maximum.at(top, code, matrix(t.column("top")))
            return {c: t.column(c).take(pa.array(first)) for c in keys + carry} | {"n": n, "top": top}, sums, int(code[-1]), t.column("p")[0].as_py()

        def solved(cols: dict, sums: np.ndarray, p: int) -> pa.RecordBatch:
            g = unpacked(sums, p)
            return record({c: cols[c] for c in (*keys, *carry, "n")} | solver(cols, g[:, :-1, :-1], g[:, :-1, -1], g[:, -1, -1]), out_arrow)

        for b in batches:
            some = at_once(b.column("p")[0].as_py()) if b.num_rows else 1
            for a in range(0, b.num_rows, some):
                t = b.slice(a, some)
                t = t if held is None else pa.Table.from_batches([held, t]).combine_chunks().to_batches()[0]
                cols, sums, last, p = added(t)
                done = np.flatnonzero(np.arange(len(sums)) != last)
                if len(done):
                    yield solved({c: v.take(pa.array(done)) if isinstance(v, pa.Array) else v[done] for c, v in cols.items()}, sums[done], p)
                own = {c: v.slice(last, 1) if isinstance(v, pa.Array) else v[last : last + 1] for c, v in cols.items()}
                held = record(own | {"p": np.array([p]), "sums": [sums[last].tobytes()]}, part_arrow)
        if held is not None:
            cols, sums, _, p = added(held)
            yield solved(cols, sums, p)

    rows = df.select(*dict.fromkeys([*keys, *carry, x, y, *greatest]))
    parts = rows.mapInArrow(part, part_schema)
    parts = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
    return parts.mapInArrow(whole, out_schema)


def at_once(p: int) -> int:
    """Series with matrices of p x p that are held at once."""
    return max(1, NUMBERS // (p * p))


def ridge(g: np.ndarray, xty: np.ndarray, use: np.ndarray, std: np.ndarray, pen: np.ndarray, lam: float):
    """``ridge_from_sums`` for many systems: (beta, status, dropped, A, M), where beta = A' c and
    M = (Z'Z + lam D)^-1 for the standardised columns Z = X A' (rows and columns that aren't used are zero)."""
    s, p = xty.shape
    n = np.maximum(g[:, 0, 0], 1)
    m = g[:, 0] / n[:, None]
    var = np.einsum("sii->si", g) / n[:, None] - m * m
    use = np.broadcast_to(use, (s, p))
    spread = var > 1e-12 * (1.0 + m * m)
    spread[:, 0] = True
    keep = use & spread
    a = np.zeros((s, p, p))
    i = np.arange(p)
    scaled = np.broadcast_to(std, (s, p)) & keep & (i > 0)
    wide = np.sqrt(np.where(scaled, var, 1.0))
    a[:, i, i] = np.where(keep, 1.0 / wide, 0.0)
    a[:, :, 0] -= np.where(scaled, m / wide, 0.0)
    zz = a @ g @ a.transpose(0, 2, 1)
    zy = np.einsum("sij,sj->si", a, xty)
    zz[:, i, i] += np.where(keep, np.where(pen, lam, 0.0), 1.0)
    inverse, singular = np.zeros_like(zz), np.zeros(s, bool)
    try:
        inverse = np.linalg.inv(zz)
        singular = ~np.isfinite(inverse).all((1, 2))
    except np.linalg.LinAlgError:
        singular[:] = True
    for k in np.flatnonzero(singular):  # one by one, to find out which
        try:
            inverse[k] = np.linalg.inv(zz[k])
            singular[k] = not np.isfinite(inverse[k]).all()
        except np.linalg.LinAlgError:
            pass
        if singular[k]:
            inverse[k] = np.linalg.pinv(zz[k])
    c = np.einsum("sij,sj->si", inverse, zy)
    for k in np.flatnonzero(~singular):  # one step of refinement, for badly scaled systems
        c[k] += inverse[k] @ (zy[k] - zz[k] @ c[k])
    inverse = inverse * (keep[:, :, None] & keep[:, None, :])
    beta = np.einsum("sij,si->sj", a, np.where(keep, c, 0.0))
    status = np.where(g[:, 0, 0] <= 0, "empty", np.where(singular, "singular", "ok"))
    dropped = [np.flatnonzero(d).tolist() for d in use & ~keep]
    return beta, status, dropped, a, inverse


def lasso(q: np.ndarray, r: np.ndarray, alpha: np.ndarray, sweeps: int = 2000) -> np.ndarray:
    """argmin of d'Qd/2 - r'd + alpha |d|_1 for many small systems, by coordinate descent."""
    d = np.zeros_like(r)
    diagonal = np.einsum("sii->si", q)
    for _ in range(sweeps):
        before = d.copy()
        for j in range(r.shape[1]):
            rest = r[:, j] - np.einsum("si,si->s", q[:, j], d) + diagonal[:, j] * d[:, j]
            short = np.sign(rest) * np.maximum(np.abs(rest) - alpha, 0)
            d[:, j] = np.where(diagonal[:, j] > 1e-12, short / np.maximum(diagonal[:, j], 1e-12), 0.0)
        if np.abs(d - before).max(initial=0) <= 1e-13 * (1 + np.abs(d).max(initial=0)):
            break
    return d


SOLVE_SCHEMA = "beta array<double>, status string, dropped array<int>"


def solve(sums: DataFrame, keys: Sequence[str], *, use: Sequence[bool] | None = None, std: Sequence[bool] | None = None,
          pen: Sequence[bool] | None = None, lam: float = 1.0, use_col: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One ridge solve per row of ``sums`` (columns n, xtx, xty), all of a batch at once.

    ``use`` / ``std`` / ``pen`` are per-column flags (fixed), ``use_col`` an
    optional per-row ARRAY<BOOLEAN> mask (e.g. the regressor gate)."""
    keys, carry = list(keys), list(carry)
    prepare(sums.sparkSession)
    cols = keys + carry + ["xtx", "xty"] + ([use_col] if use_col else [])
    fields = [f for f in sums.schema.fields if f.name in keys + carry]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [SOLVE_SCHEMA])

    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            xty = matrix(b.column("xty"))
            p = xty.shape[1]
            flags = [np.asarray(f if f is not None else [True] * p, bool) for f in (use, std, pen)]
            own = matrix(b.column(use_col)) > 0 if use_col else flags[0]
            beta, status, dropped, _, _ = ridge(unpacked(matrix(b.column("xtx")), p), xty, own, flags[1], flags[2], lam)
            yield record({f.name: b.column(f.name) for f in fields} | {"beta": beta, "status": status.tolist(), "dropped": dropped}, arrow)

    return sums.select(*cols).mapInArrow(run, schema)


def dot(x: Column, beta: Column) -> Column:
    """x . beta with built-in higher-order functions (JVM side)."""
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


