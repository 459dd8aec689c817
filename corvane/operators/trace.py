"""Traces of runs: rows and sums of each stage, taken while it is written, and when it ended.

A stage is observed as it runs, so that no second pass counts it.  A trace is a table of one row a stage and metric, appended to
a folder by Spark's writer; stages of one run share its id.

Cases: a stage without rows reports zeros; metrics that are null (a sum over nothing) are left out; a run may repeat a stage,
whose last report counts.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.operators import select

TRACE = "run_id string, stage string, ordinal int, metric string, value double, seconds double"


class Run:
    """Stages of one run: each writes its rows and reports on them."""

    def __init__(self, spark: SparkSession, run_id: str):
        self.spark, self.run_id, self.rows = spark, run_id, []

    def stage(self, name: str, rows: DataFrame, path: str, **metrics: Column) -> DataFrame:
        """rows, written to path and read back; metrics are aggregates over them."""
        seen, began = Observation(f"{self.run_id}-{name}-{len(self.rows)}"), time.perf_counter()
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(n) for n, c in metrics.items()]).write.mode("overwrite").parquet(path)
        took = time.perf_counter() - began
        ordinal = len({(r[1], r[2]) for r in self.rows})
        self.rows += [(self.run_id, name, ordinal, n, float(v), took) for n, v in seen.get.items() if v is not None]
        return self.spark.read.schema(rows.schema).parquet(path)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, TRACE)

    def save(self, folder: str) -> None:
        self.table().write.mode("append").parquet(folder)


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Of every run and stage the last report: (run_id, stage, metric, value, seconds)."""
    t = spark.read.schema(TRACE).parquet(folder)
    key = F.struct("run_id", "stage", "metric")
    return select.latest(t.select(key.alias("k"), "ordinal", "value", "seconds"), "k", "ordinal").select("k.*", "value", "seconds")


def hit_ratio(trace: DataFrame, all_of: str = "scanned", hits: str = "skipped") -> DataFrame:
    """(run_id, ratio): share of a run's scanned items that it skipped; 0 if it scanned none."""
    of = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    return trace.groupBy("run_id").agg(F.when(of(all_of) > 0, F.round(of(hits) / of(all_of), 3)).otherwise(0.0).alias("ratio"))
