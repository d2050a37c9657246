"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from ..sources.fixtures import FIXTURE_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def round6(c):
    """To the nearest 6 digits (half to even), in IEEE arithmetic: identical in Spark and DuckDB."""
    return F.rint(c * F.lit(10.0**DIGITS)) / F.lit(10.0**DIGITS)


def canon(df: DataFrame) -> DataFrame:
    """Output form shared with the oracle: doubles rounded to 6 digits,
    integers as BIGINT, instants as TIMESTAMP_NTZ (UTC wall clock)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round6(c.cast("double"))
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, *, raw: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql``
    is the oracle text (None: rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            out = fn(spark, sf_dir)
            return out if raw else canon(out)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run

    return deco


# ---------------------------------------------------------------------------
# DuckDB side: named CTE bodies with dependencies.  ``with_(body, ...)``
# prefixes the CTEs a body needs, in dependency order.

LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Brussels')"

CTE: dict[str, tuple[str, tuple[str, ...]]] = {k: (v, ()) for k, v in FIXTURE_SQL.items()}


def cte(name: str, body: str, *deps: str) -> None:
    CTE[name] = (body.strip(), deps)


def with_(body: str, *names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTE[n][0]}\n)" for n in order]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def r6(expr: str, alias: str | None = None) -> str:
    """Oracle twin of ``round6``."""
    x = f"CAST({expr} AS DOUBLE)"
    s = f"(round_even({x} * 1e6, 0) / 1e6)"
    return f"{s} AS {alias}" if alias else s


def avg_exact_sql(x: str, scale: int = 10) -> str:
    """Oracle twin of ``operators.daily.avg_exact``."""
    return f"(CAST(sum(CAST({x} AS DECIMAL(28,{scale}))) AS DOUBLE) / count({x}))"


cte(
    "parsed",
    "SELECT m.*, try_cast(ts_raw AS TIMESTAMP) AS ts FROM measurements m",
    "measurements",
)
cte(
    "clean",
    f"SELECT id, room_id, ts_raw, co2, temperature, humidity, presence, ts, {LOCAL} AS local_ts "
    "FROM parsed WHERE ts IS NOT NULL AND (co2 > 5000) IS NOT TRUE",
    "parsed",
)
cte(
    "daily",
    f"""SELECT room_id, CAST(ts AS DATE) AS ds, avg(co2) AS co2_mean, {avg_exact_sql("temperature")} AS temp_mean,
       {avg_exact_sql("humidity")} AS hum_mean, CAST(sum(CAST(presence AS INT)) AS BIGINT) AS presence_count,
       count(co2) AS total_count
FROM clean GROUP BY room_id, CAST(ts AS DATE)""",
    "clean",
)
cte(
    "daily2",
    """SELECT room_id, ds, co2_mean, temp_mean, hum_mean, least(presence_count + 8, 24) AS presence_count,
       total_count,
       CASE WHEN total_count = 0 THEN NULL
            ELSE CAST(least(presence_count + 8, 24) AS DOUBLE) / total_count END AS presence_ratio
FROM daily""",
    "daily",
)
