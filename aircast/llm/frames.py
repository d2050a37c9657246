"""Small Spark helpers shared by the operators: Arrow scans, scratch tables in
the shared folder, row columns with names of their own."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import ensure_checkpoint_dir, ship_package

#: Rows and bytes in one Arrow batch.  Whole texts travel in a batch, so it is kept small:
#: 512 texts of 3 kB are 1.5 MB; longer ones end a batch by its bytes.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20

#: Spark deletes a query's shuffle files when it ends, not when the driver's garbage is collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ArrowFn = Callable[[pa.RecordBatch], "dict | None"]


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches of whole texts, and the package on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def scan(df: DataFrame, fn: ArrowFn, schema: str) -> DataFrame:
    """``mapInArrow`` with a per-batch function that returns a dict of columns
    (NumPy arrays, lists or Arrow arrays), or None for no rows."""
    prepare(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b) if b.num_rows else None
            if out is not None:
                yield record(out, arrow)

    return df.mapInArrow(run, schema)


def scan_state(df: DataFrame, make: Callable[[], tuple[ArrowFn, Callable[[], "dict | None"]]], schema: str) -> DataFrame:
    """Like ``scan``, for functions that keep state over the batches of a task.
    ``make()`` returns the per-batch function and a closing one."""
    prepare(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, close = make()
        for b in batches:
            out = fn(b) if b.num_rows else None
            if out is not None:
                yield record(out, arrow)
        out = close()
        if out is not None:
            yield record(out, arrow)

    return df.mapInArrow(run, schema)


def record(cols: dict, arrow: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in arrow:
        c = cols[f.name]
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        arrays.append(c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([(f.name, f.type) for f in arrow]))


class Scratch:
    """Parquet tables in the shared folder (``spark.checkpoint.dir``), deleted
    through Spark's file system on leaving the block.  A result that
    outlives the block is a ``checkpoint`` of small rows, see ``keep``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/aircast-{name}-{uuid.uuid4().hex}"
        self.brief: list[str] = []

    def __enter__(self) -> "Scratch":
        return self

    def table(self, df: DataFrame, name: str, brief: bool = False, by: str | None = None) -> DataFrame:
        """``df`` written and read back.  ``brief``: ``forget`` deletes it; ``by``: a column whose values have folders of their own."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")  # nothing else reads the shuffle files of this write
        try:
            write = df.write.option("compression", "zstd")
            (write.partitionBy(by) if by else write).parquet(path)
        finally:
            self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)
        if brief:
            self.brief.append(name)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        """Delete the tables that were made for the step that is over."""
        for name in self.brief:
            self.drop(name)
        self.brief.clear()

    def release(self) -> None:
        """Let Spark delete the shuffle files of jobs whose results are written: it does so when the
        driver's garbage is collected, which a driver with much memory seldom does by itself."""
        gc.collect()
        self.spark._jvm.System.gc()

    def keep(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def __exit__(self, kind, *rest) -> None:
        self.drop()


def spare(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 5, is 0 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int]) -> DataFrame:
    """Rows of ``docs`` with a ``label``: at most ``per_class`` labelled doc_ids of label 0
    and 1, in the order of a hash of doc_id, and one row of each (the one with the smallest
    hash).  Only these ids (a bounded number)
    are broadcast.  A doc_id with several labels has the largest; null ones don't count."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    one = one.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).alias("label"))
    ids = [one.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[v]) for v in (0, 1)]
    cols = [c for c in docs.columns if c != "doc_id"]
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    first = rows.groupBy("doc_id", "label").agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("row"))
    return first.select("doc_id", "row.*", "label")
