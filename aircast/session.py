"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  Instants are kept in UTC and
# converted to a display zone explicitly, so the session zone must be UTC.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast only what is proven small; 32 MB is the ceiling for the
    # dimension tables (weather, holidays, coefficients, bounds rows)
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # keyed state of the stream operators (transformWithStateInPandas needs RocksDB)
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Suggested static settings for a large cluster (100 TB of readings); the
# library never sets these itself, the cluster owner does.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",  # upper bound; AQE coalesces
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.checkpoint.dir": "<shared storage, e.g. an object-store prefix>",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators depend on, and send the package to
    the executors (idempotent)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Python workers import this package by name, so it goes to them as a zip
    file (once for each application; workers that have it already use theirs)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="aircast-zip-"), "aircast.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "aircast")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(path)  # served by the driver; the local copy is only its source
    _shipped.add(sc.applicationId)


def build_session(master: str | None = None, partitions: int = 8, app: str = "aircast",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    master = master or os.environ.get("AIRCAST_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("AIRCAST_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for k, v in {**RUNTIME_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def materialize(df):
    """Cut lineage for a table that several plans reuse (the feature table):
    a reliable ``checkpoint`` in the shared checkpoint folder, so a lost
    executor does not replay the whole upstream plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; a folder of our own is
    set only when it is unset (local tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the conf is all there is
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        master = sc.master if sc is not None else "remote"
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="aircast-ckpt-", dir="/tmp")  # one machine: tests and the bench
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    return d
