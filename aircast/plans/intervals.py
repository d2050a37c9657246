"""80 % intervals of the forecasts: seeded trajectories folded over the horizon.

For each series ``PATHS`` trajectories are drawn: every step adds noise of the model's residual
spread, and the temperature's trend may go on bending as often and as strongly as it did in
the past.  Noise feeds back through the lags like the values themselves.  The bounds
of a step are quantiles of its trajectories.  A series' draws come from a counter-based
generator keyed by a hash of its keys, so they don't depend on partitions or retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import DEFAULT_KEYS
from . import gram as G
from . import models as M

#: Fixed value: the width of the intervals.
WIDTH = 0.80
PATHS = 1000
#: Series whose trajectories are held at once (8 bytes x PATHS x horizon each).
SERIES = 64


def normals(seeds: np.ndarray, salt: int, paths: int, steps: int) -> np.ndarray:
    """(S, paths, steps) standard normal draws, each series' from its own seed."""
    return np.stack([np.random.Generator(np.random.Philox(key=[int(s), salt])).standard_normal((paths, steps)) for s in seeds.view(np.uint64)])


def trend_bends(seeds: np.ndarray, delta: np.ndarray, span: np.ndarray, steps: int, paths: int) -> np.ndarray:
    """(S, paths, steps): what future bends add to the trend.  As many of them are expected a day as there were
    places for them, each Laplace with the mean size of the past ones."""
    size = np.abs(delta).mean(1) if delta.shape[1] else np.zeros(len(delta))
    out = np.zeros((len(seeds), paths, steps))
    for i in np.flatnonzero(size > 0).tolist():
        r = np.random.Generator(np.random.Philox(key=[int(seeds.view(np.uint64)[i]), 2]))
        rate = delta.shape[1] / max(float(span[i]), 1.0)
        here = r.random((paths, steps)) < rate  # a bend on the day
        bend = np.where(here, r.laplace(0.0, size[i], (paths, steps)), 0.0)
        # a bend on day s adds bend * (h - s) / span from then on
        out[i] = np.cumsum(np.cumsum(bend, 1) - bend, 1) / max(float(span[i]), 1.0)
    return out


def temp_trajectories(base, low, high, l1, l2, b1, b2, sigma, extra, noise) -> np.ndarray:
    """(S, paths, steps): base + b1 lag1 + b2 lag2 + trend + noise, clipped step by step."""
    s, paths, steps = noise.shape
    out, one, two = np.empty_like(noise), np.repeat(l1[:, None], paths, 1), np.repeat(l2[:, None], paths, 1)
    for h in range(steps):
        y = base[:, h, None] + b1[:, None] * one + b2[:, None] * two + extra[:, :, h] + sigma[:, None] * noise[:, :, h]
        y = np.minimum(np.maximum(y, low[:, h, None]), high[:, h, None])
        out[:, :, h], one, two = y, y, one
    return out


def co2_trajectories(xb, t_row, u1, u2, eps, phi1, phi2, drift, theta, sigma, noise) -> np.ndarray:
    """(S, paths, steps): x.beta + u, u = phi1 u-1 + phi2 u-2 + drift t + theta e-1 + e."""
    s, paths, steps = noise.shape
    out = np.empty_like(noise)
    one, two, last = (np.repeat(v[:, None], paths, 1) for v in (u1, u2, eps))
    for h in range(steps):
        e = sigma[:, None] * noise[:, :, h]
        u = phi1[:, None] * one + phi2[:, None] * two + drift[:, None] * t_row[:, h, None] + theta[:, None] * last + e
        out[:, :, h], one, two, last = xb[:, h, None] + u, u, one, e
    return out


def _bounds(j: DataFrame, keys: Sequence[str], make: Callable[[pa.Table, np.ndarray, int], np.ndarray], width: float, paths: int) -> DataFrame:
    """``j`` (one row per series with ``fut``) plus lower and upper, arrays by step."""
    G.prepare(j.sparkSession)
    names = j.columns
    j = j.withColumn("_seed", F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in j.schema.fields if f.name in names) + ", lower array<double>, upper array<double>"
    arrow, edges = G.arrow_schema(schema), [(1 - width) / 2, (1 + width) / 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, SERIES):
                t = pa.Table.from_batches([b.slice(a, SERIES)]).combine_chunks()
                steps = np.asarray(step_counts(t.column("fut")))
                lower, upper = [None] * t.num_rows, [None] * t.num_rows
                for n in set(steps.tolist()) - {0}:  # all alike as a rule
                    at = np.flatnonzero(steps == n)
                    with np.errstate(invalid="ignore"):
                        q = np.quantile(make(t.take(pa.array(at)).combine_chunks(), at, n), edges, axis=1)
                    for i, lo, hi in zip(at.tolist(), q[0], q[1]):
                        if np.isfinite(lo).all():
                            lower[i], upper[i] = lo.tolist(), hi.tolist()
                yield G.record({c: t.column(c).combine_chunks() for c in names} | {"lower": lower, "upper": upper}, arrow)

    return j.mapInArrow(run, schema)


def step_counts(col: pa.ChunkedArray) -> pa.Array:
    return pc.fill_null(pc.list_value_length(col), 0).combine_chunks()


def _numbers(t: pa.Table, name: str, missing: float = np.nan) -> np.ndarray:
    x = np.asarray(t.column(name).combine_chunks(), dtype=float)
    return np.where(np.isnan(x), missing, x)


def _steps(t: pa.Table, field: str, steps: int) -> np.ndarray:
    flat = t.column("fut").combine_chunks().flatten()
    return np.asarray(flat.field(field), dtype=float).reshape(-1, steps)


def temp_bounds(paths_of: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, width: float = WIDTH, paths: int = PATHS) -> DataFrame:
    """``forecast.temp_paths`` rows plus lower and upper."""

    def make(t: pa.Table, at: np.ndarray, steps: int) -> np.ndarray:
        seeds = np.asarray(t.column("_seed").combine_chunks())
        beta, delta = (G.matrix(t.column(c).combine_chunks()) for c in ("beta", "delta"))
        low = _steps(t, "outside_temp_max", steps)
        high = low + _numbers(t, "avg_temp_diff")[:, None]
        extra = trend_bends(seeds, delta, _numbers(t, "span_days"), steps, paths)
        return temp_trajectories(
            _steps(t, "base", steps), low, high, _numbers(t, "l1"), _numbers(t, "l2"), beta[:, M.LAG1_IDX], beta[:, M.LAG2_IDX],
            _numbers(t, "sigma"), extra, normals(seeds, 1, paths, steps),
        )

    return _bounds(paths_of, keys, make, width, paths)


def co2_bounds(paths_of: DataFrame, *, keys: Sequence[str] = DEFAULT_KEYS, width: float = WIDTH, paths: int = PATHS) -> DataFrame:
    """``forecast.co2_paths`` rows plus lower and upper."""

    def make(t: pa.Table, at: np.ndarray, steps: int) -> np.ndarray:
        seeds = np.asarray(t.column("_seed").combine_chunks())
        cols = [_numbers(t, c) for c in ("u_last", "u_prev")] + [_numbers(t, "eps_last", 0.0)] + [_numbers(t, c) for c in ("phi1", "phi2", "delta")]
        return co2_trajectories(_steps(t, "xb", steps), _steps(t, "t_row", steps), *cols, _numbers(t, "theta", 0.0), _numbers(t, "sigma"), normals(seeds, 3, paths, steps))

    return _bounds(paths_of, keys, make, width, paths)
