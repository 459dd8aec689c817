"""A cache of pages or of extractions: a table of entries by key, appended by Spark's writer.

An entry is (key, version, payload, gone); puts and invalidations append, and of a key the entry of the highest version counts, so
that nothing is rewritten.  Versions are given by the caller (a run's number); of equal versions an invalidation counts before
a put, then the greatest payload, so a replayed put changes nothing.  Entries are dealt to buckets by key, a column of folders,
so a lookup of few keys reads few of them.

Cases: an unknown or invalidated key is a miss, and so is one whose payload is no JSON; null keys are never stored and always
misses; an empty cache has no folder and misses all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X

ENTRY = "key string, version long, payload string, gone boolean, bucket int"
BUCKETS = 64


def page_key(url: Column) -> Column:
    """Key of a page: 16 hex digits of its address's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 16)


def extraction_key(question: Column, chunk_ids: Column) -> Column:
    """Key of an extraction: of the question and the sorted ids of its chunks."""
    return X.cache_key(question, F.array_join(F.array_sort(chunk_ids), ","))


@dataclass
class Cache:
    spark: SparkSession
    path: str

    def entries(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(self.path)

    def _append(self, rows: DataFrame, version: int, payload: Column, gone: bool) -> None:
        r = rows.filter("key is not null").select("key", F.lit(version).cast("long").alias("version"), payload.cast("string").alias("payload"), F.lit(gone).alias("gone"))
        r.withColumn("bucket", F.pmod(F.hash("key"), F.lit(BUCKETS))).write.mode("append").partitionBy("bucket").parquet(self.path)

    def put(self, rows: DataFrame, version: int) -> None:
        """Stores rows (key, payload)."""
        self._append(rows, version, F.col("payload"), False)

    def invalidate(self, keys: DataFrame, version: int) -> None:
        """Forgets keys (key): entries of lower versions, and of this one."""
        self._append(keys, version, F.lit(None), True)

    def current(self, entries: DataFrame | None = None) -> DataFrame:
        """(key, version, payload) of the keys in force."""
        e = self.entries() if entries is None else entries
        last = e.groupBy("key").agg(F.max(F.struct("version", "gone", "payload")).alias("x")).filter("not x.gone")
        return last.filter(F.try_parse_json("x.payload").isNotNull()).select("key", "x.version", "x.payload")

    def get(self, wanted: DataFrame) -> DataFrame:
        """wanted (key and other columns) with payload and hit; the buckets of few wanted keys are listed first."""
        buckets = [r[0] for r in wanted.select(F.pmod(F.hash("key"), F.lit(BUCKETS))).distinct().collect()]  # at most BUCKETS
        found = self.current(self.entries().filter(F.col("bucket").isin(buckets))).select(F.col("key").alias("__k"), F.col("payload").alias("__p"))
        return wanted.join(found, F.col("key") == F.col("__k"), "left").select(*[F.col(c) for c in wanted.columns], F.col("__p").alias("payload"), F.col("__k").isNotNull().alias("hit"))

    def misses(self, wanted: DataFrame) -> DataFrame:
        return self.get(wanted).filter("not hit").select(*wanted.columns)
