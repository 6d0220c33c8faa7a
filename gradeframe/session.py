"""Session helpers: building a session, the shared work folder, tables in it, the state store."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_spark(app: str = "gradeframe", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested with.

    On a cluster the caller passes its own session; nothing in the library needs this one.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster session without the
    setting is an error, because other executors could not read a machine-local folder.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@functools.cache
def _local_root() -> str:
    """Work folder of a local session without the setting."""
    return tempfile.mkdtemp(prefix="gradeframe-")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder with what lies below it; False if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of ended jobs, which else lie there until the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def materialised(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``materialise`` for as long as the block runs; nothing that outlives it may read the table."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    try:
        df.write.parquet(path)
        free_shuffles(spark)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(spark, path)
        free_shuffles(spark)


def with_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, unless the session names a store of its own.

    State with several variables and timers needs it; a running stream and the checkpoint of an
    earlier one keep the store they have.
    """
    if (spark.conf.get(STATE_STORE, None) or "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKSDB)
