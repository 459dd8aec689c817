"""JSON objects (research objects, decision models, engagements, reports) as an appended table, and markdown of many memos.

A version of an object is a row (kind, id, version, body); puts append by Spark's writer, by kind, and of an object the highest
version counts.  The latest object of a kind is the one of the highest version, of equal ones the greatest id, so nothing
points to it and nothing is rewritten.

Cases: a put that is repeated changes nothing; of equal versions the greatest body counts; a null id is not stored; an empty
table has no folder and no objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = "id string, version long, body string, kind string"


@dataclass
class Objects:
    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], OBJECT)
        return self.spark.read.schema(OBJECT).parquet(self.path)

    def put(self, kind: str, objects: DataFrame, key: str, version: int | Column) -> None:
        """Stores rows as objects: all columns make the body."""
        v = F.lit(version) if isinstance(version, int) else version
        made = objects.select(F.col(key).cast("string").alias("id"), v.cast("long").alias("version"), F.to_json(F.struct(*objects.columns), {"ignoreNullFields": "false"}).alias("body"), F.lit(kind).alias("kind"))
        made.filter("id is not null").write.mode("append").partitionBy("kind").parquet(self.path)

    def of(self, kind: str, schema: str | None = None) -> DataFrame:
        """(id, version, body) of the objects of a kind, the last version of each; with a schema its columns in place of body."""
        last = self.rows().filter(F.col("kind") == kind).groupBy("id").agg(F.max(F.struct("version", "body")).alias("x")).select("id", "x.version", "x.body")
        return last.select("id", "version", F.from_json("body", schema).alias("o")).select("id", "version", "o.*") if schema else last

    def latest(self, kind: str) -> DataFrame:
        """The latest object of a kind: one row, or none."""
        return self.of(kind).orderBy(F.desc("version"), F.desc("id")).limit(1)


def markdown(lines: DataFrame, key: str = "memo") -> DataFrame:
    """(key, markdown) of memos from their lines: key, title, section, section_ord, ord, line; a section whose lines are null is
    shown as empty, the lines of the others as a list.  Sections of a memo are joined, never memos."""
    items = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("ord", "line"))))
    s = lines.groupBy(key, "title", "section_ord", "section").agg(items.alias("l"))
    body = F.when(F.size("l") == 0, "_None._").otherwise(F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    s = s.select(key, "title", F.struct("section_ord", F.concat(F.lit("## "), "section", F.lit("\n\n"), body).alias("t")).alias("s"))
    m = s.groupBy(key, "title").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return m.select(key, F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("markdown"))
