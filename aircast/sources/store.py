"""A: the measurement store as parquet, and its four verbs as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas


def conform(df: DataFrame, schema=schemas.MEASUREMENT) -> DataFrame:
    """Project onto the fixed schema: fixed column order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_store(spark, path: str, fmt: str = "parquet", *, multiline: bool = True) -> DataFrame:
    """A1: read measurement records from parquet or a JSON array file with
    the fixed schema; the same schema serves ``readStream``."""
    if fmt == "json":
        return conform(spark.read.schema(schemas.MEASUREMENT).option("multiLine", multiline).json(path))
    return conform(spark.read.schema(schemas.MEASUREMENT).parquet(path))


def scan_desc(df: DataFrame, *, by: str = "text") -> DataFrame:
    """A2: newest first.  ``by="text"`` orders on the stored text as the
    store does (mixed offsets sort by text, not by instant); ``by="instant"``
    orders on the parsed time.  A global sort is a range-partitioned
    exchange, so it scales out."""
    key = F.col("ts_raw") if by == "text" else F.try_to_timestamp(F.col("ts_raw"))
    return conform(df).orderBy(key.desc(), F.col("id").desc())


def dense_number(df: DataFrame, order: list[str], *, out: str = "_n") -> DataFrame:
    """1..n in ``order`` without a single-partition window.

    Range-partition and sort by ``order``, count rows per partition, turn the
    counts into offsets (a table with one row per partition: a proven
    bound, broadcast), then number inside each partition.  The sorted batch
    is checkpointed first so a recomputed task sees the same rows in the
    same place (lineage is cut in the cluster's checkpoint folder)."""
    from pyspark.sql import Window

    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_mono").alias("_m0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", "_m0", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    out_df = s.join(F.broadcast(offs), "_pid")
    return out_df.withColumn(out, F.col("_off") + F.col("_mono") - F.col("_m0") + 1).drop("_pid", "_mono", "_m0", "_off")


def append_with_id(store: DataFrame, batch: DataFrame, *, order: tuple[str, ...] = ("ts_raw", "id"),
                   start_id=None) -> DataFrame:
    """A3: new rows get ids max(id)+1 ... in ingest ``order`` (autoincrement).
    Returns the store with the batch appended; ``write_append`` persists it.
    ``start_id`` (e.g. from the ingestion high-water-mark table) replaces the
    ``max(id)`` scan of a large store."""
    top = F.lit(start_id) if start_id is not None else store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = dense_number(batch, list(order))
    new = numbered.withColumn("id", top + F.col("_n")).drop("_n")
    return conform(store).unionByName(conform(new))


def write_append(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def add_column_default(old: DataFrame, new: DataFrame, *, column: str = "presence", default=False) -> DataFrame:
    """A4: rows stored before the column existed read with its default."""
    return old.unionByName(new, allowMissingColumns=True).withColumn(
        column, F.coalesce(F.col(column), F.lit(default))
    )


CORRUPT = "_corrupt_record"


#: The texts that count as booleans.
TRUE_TEXTS, FALSE_TEXTS = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def typed(text, kind: str):
    """A field's text as its type, or NULL: numbers may come as text, integers as whole floats."""
    t = F.trim(text)
    if kind == "string":
        return text
    if kind == "boolean":
        low = F.lower(t)
        return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False)
    if kind == "int":
        x = t.try_cast("double")
        return F.when(x == F.floor(x), x.try_cast("int"))
    return t.try_cast(kind)


def validate_payload(raw: DataFrame, *, text: str = "payload", schema=schemas.PAYLOAD) -> DataFrame:
    """A5: parse JSON payloads with the fixed schema; every field required.

    Returns all rows with ``status`` ``ok`` / ``quarantine`` and a
    ``reason``: malformed JSON, the first missing field, or the first field of the wrong type
    (a number as text, such as "612", is of the right one)."""
    from pyspark.sql import types as T

    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    p = raw.withColumn(
        "_p",
        F.from_json(F.col(text), texts, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}),
    )
    values = {f.name: typed(F.col(f"_p.{f.name}"), f.dataType.simpleString()) for f in schema.fields}
    reason = F.when(F.col(f"_p.{CORRUPT}").isNotNull() | F.col("_p").isNull(), F.lit("malformed"))
    for f in schema.fields:
        reason = reason.when(F.col(f"_p.{f.name}").isNull(), F.lit(f"missing {f.name}"))
    for f in schema.fields:
        reason = reason.when(values[f.name].isNull(), F.lit(f"invalid {f.name}"))
    p = p.withColumn("reason", reason)
    return p.select(
        *[c for c in raw.columns if c != text],
        *[v.alias(name) for name, v in values.items()],
        F.when(F.col("reason").isNull(), "ok").otherwise("quarantine").alias("status"),
        "reason",
    )


def delete_by_id(store: DataFrame, deletes: DataFrame) -> DataFrame:
    """``DELETE WHERE id = ?``; a missing id is a no-op (left anti)."""
    return store.join(deletes.select("id").distinct(), "id", "left_anti")


def update_presence(store: DataFrame, updates: DataFrame) -> DataFrame:
    """``UPDATE SET presence = ? WHERE id = ?``, the latest update per
    id wins; a missing id is a no-op.  Updates are reduced to one row per
    id before the join."""
    u = updates.groupBy("id").agg(F.max_by("presence", "seq").alias("_new"))
    return store.join(u, "id", "left").withColumn("presence", F.coalesce("_new", "presence")).drop("_new")


def apply_changes(changes: DataFrame) -> DataFrame:
    """Ordered change feed (seq, op, id, presence, co2) -> current rows.

    A row lives if it was inserted and no delete of its id came later; its
    presence is the last ``set_presence`` after the insert.  An update after
    a delete stays a no-op (the row is gone).  Each side is reduced to one
    row per id before the joins."""
    ins = changes.where(F.col("op") == "insert").groupBy("id").agg(
        F.max_by(F.struct("seq", "presence", "co2"), "seq").alias("i")
    ).select("id", F.col("i.seq").alias("ins_seq"), F.col("i.presence").alias("presence"), F.col("i.co2").alias("co2"))
    dels = changes.where(F.col("op") == "delete").groupBy("id").agg(F.max("seq").alias("del_seq"))
    upd = changes.where(F.col("op") == "set_presence").groupBy("id").agg(
        F.max("seq").alias("upd_seq"), F.max_by("presence", "seq").alias("upd_presence")
    )
    live = ins.join(dels, "id", "left").where(F.col("del_seq").isNull() | (F.col("del_seq") < F.col("ins_seq")))
    out = live.join(upd, "id", "left")
    newer = F.col("upd_seq") > F.col("ins_seq")
    return out.select(
        "id", F.when(newer, F.col("upd_presence")).otherwise(F.col("presence")).alias("presence"), "co2"
    )


def write_store(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Persist readings partitioned by their UTC ``date`` (from the text
    timestamp; unparsable stamps land in the NULL-date partition), so
    day-range reads prune whole folders."""
    d = F.to_date(F.try_to_timestamp(F.col("ts_raw")).cast("timestamp_ntz"))
    conform(df).withColumn("date", d).write.mode(mode).partitionBy("date").parquet(path)


def read_days(spark, path: str, lo: str, hi: str) -> DataFrame:
    """Readings of UTC days lo..hi: a predicate on the partition column, so
    the scan lists only those folders (``PartitionFilters`` in the plan)."""
    from pyspark.sql import types as T

    schema = T.StructType(list(schemas.MEASUREMENT.fields) + [T.StructField("date", T.DateType())])
    df = spark.read.schema(schema).parquet(path)
    return df.where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
