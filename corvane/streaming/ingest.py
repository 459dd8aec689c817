"""Streaming ingest into the store: each micro-batch is one incremental build.

Builds skip sources the manifest has, so a batch that is replayed after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import text as X
from corvane.sources.store import Store


def document_stream(spark: SparkSession, folder: str, schema: str = "uri string, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def distinct_statements(stream: DataFrame, at: str, statement: str, lateness: str = "1 hour") -> DataFrame:
    """Statements once within the watermark; its state holds fingerprints only."""
    return stream.withColumn("fingerprint", X.fingerprint(F.col(statement))).withWatermark(at, lateness).dropDuplicatesWithinWatermark(["fingerprint"])


def ingest(stream: DataFrame, store: Store, domain: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    def build(batch: DataFrame, number: int) -> None:
        store.build(batch.select("uri", "text"), domain, f"{domain}-{number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(build)
    return writer.trigger(availableNow=True).start() if once else writer.start()
