"""Spark session and clock settings shared by every job.

Every operator takes an explicit ``as_of``; nothing reads the wall clock.
The session zone is pinned to UTC so that casts between ``timestamp_ntz``
(the driver's Parquet) and ``timestamp`` are pure relabels.
"""
from __future__ import annotations

import datetime as _dt
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Fixed clock of the fixtures (FIXTURES.md): 2024-02-01 00:00:00 UTC.
AS_OF = _dt.datetime(2024, 2, 1, 0, 0, 0)

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_LOCAL_DIRS: dict[str, str] = {}  # application id -> work folder of a single-process session


def build_session(master: str | None = None, app: str = "mailtriage",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the jobs assume (UTC, AQE, no UI)."""
    master = master or os.environ.get("SPARK_MASTER") or "local[*]"
    parts = shuffle_partitions or os.environ.get("SHUFFLE_PARTITIONS")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # per-mail streaming state (ST3, ST4) grows with the mailbox: keep it in RocksDB on
        # local disk with changelog checkpoints, not in the JVM heap
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    if parts:  # else the cluster's own setting
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in Arrow batches of at most ``BATCH_BYTES``, unless the session has a size of its own.

    Spark's 10,000 rows a batch are no bound in bytes, and an executor holds each task's batch in its JVM and in a worker."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared work folder: checkpoints, stream state, written intermediate tables.

    On a cluster this is ``spark.checkpoint.dir``, a folder every node sees; a
    session on several machines without it is an error. A single-process session
    (``local[*]``, as in tests) gets one folder of its own per application.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared work folder")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="mailtriage-work-")
        sc.setCheckpointDir(_LOCAL_DIRS[sc.applicationId])
    return _LOCAL_DIRS[sc.applicationId]


def cut(df: DataFrame, name: str = "t", schema=None) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: lineage ends here, the rows
    survive a lost executor, and the planner knows the size of what it reads.

    ``schema`` reads it under other types of the same storage form (a struct as a Spark ML vector)."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
