"""Passes over whole series in day order, many series at a time.

For recursions that no aggregate expresses (an estimate that is carried from day to day).
Rows are dealt by series and sorted by Spark; a task reads them as Arrow batches and
hands over the series that are complete, so it holds one batch and the rows of
one series.  A series has one row a day, which the calendar bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import gram as G

#: (the columns of complete series, first row of each and the end) -> columns of the result.
SeriesFn = Callable[[pa.Table, np.ndarray], "dict | None"]


def _starts(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which another series begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = np.asarray(t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def each_series(df: DataFrame, keys: Sequence[str], order: str, fn: SeriesFn, schema: str) -> DataFrame:
    keys = list(keys)
    G.prepare(df.sparkSession)
    rows = df.repartition(*keys) if keys else df.repartition(1)
    rows = rows.sortWithinPartitions(*keys, order)
    arrow = G.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def made(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            out = fn(t.combine_chunks(), np.append(first, t.num_rows))
            if out is not None:
                yield G.record(out, arrow)

        for b in batches:
            if not b.num_rows:
                continue
            own = pa.Table.from_batches([b])
            ends = held and len(_starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), own.slice(0, 1)]), keys)) > 1
            first = _starts(own, keys)
            if not ends and len(first) == 1:
                held.append(own)  # one series so far
                continue
            t = pa.concat_tables([*held, own])
            first = _starts(t, keys)
            held = [t.slice(first[-1])]
            yield from made(t.slice(0, first[-1]), first[:-1])
        if held:
            t = pa.concat_tables(held)
            yield from made(t, _starts(t, keys))

    return rows.mapInArrow(run, schema)
