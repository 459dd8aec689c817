"""Tables in the folder that driver and executors share, and small tables dealt to all cores."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark, "_corvane_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark._corvane_shared = "file://" + tempfile.mkdtemp(prefix="corvane-shared-")
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stash(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan_bytes(df: DataFrame) -> int:
    """Bytes of a scan, as the planner knows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A scan of few bytes dealt to all cores, as it may be a single row group; larger ones stay as their files split them."""
    return df if scan_bytes(df) > most_bytes else df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, bytes_: int, *by: str, piece: int = 8 << 20) -> DataFrame:
    """Rows dealt for much work on each, whatever row groups they came in: a task for every piece of so many bytes read, one a core at
    least.  By hash, as dealing in turn would sort the rows first."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-bytes_ // piece))
    return df.repartition(n, F.xxhash64(*by))


def bounded_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Broadcast hint only where a count proves that df has at most max_rows; else a shuffle.

    The planner goes by the bytes of files, and many rows may compress to few."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def release(spark: SparkSession) -> None:
    """Lets Spark drop what earlier steps left in the driver: plans, broadcasts and shuffles of frames that nothing names any more.

    Spark's cleaner works on what the JVM has collected, which a driver with little to do may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
