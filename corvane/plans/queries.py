"""Queries of the engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.plans.catalog import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""
    with s as (
      select doc_id, source, u.pos, u.sentence
      from (select doc_id, source, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) a from documents),
           lateral (select unnest(a) sentence, generate_subscripts(a, 1) - 1 pos) u
      where length(u.sentence) >= 40
    ), t as (
      select *, (contains(lower(sentence), 'that')::int + contains(lower(sentence), 'with')::int + contains(lower(sentence), 'from')::int) hits from s
    ), r as (
      select *, round(0.65 * hits / 3.0 + 0.35 * (1 + cast(substr(source, 4) as int) % 5) / 5.0, 4) score from t where hits > 0
    )
    select source, doc_id, pos, hits, score, rk from (
      select *, row_number() over (partition by source order by score desc, hits desc, doc_id, pos) rk from r)
    where rk <= 3
    """
)
def sentence_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    split = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    s = docs.select("doc_id", "source", F.posexplode(split).alias("pos", "sentence")).filter(F.length("sentence") >= 40)
    low = F.lower("sentence")
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in ("that", "with", "from")), F.lit(0))
    quality = 1 + F.substring("source", 4, 9).cast("int") % 5
    s = s.withColumn("hits", hits).filter("hits > 0").withColumn("score", F.round(0.65 * F.col("hits") / 3.0 + 0.35 * quality / 5.0, 4))
    w = Window.partitionBy("source").orderBy(F.desc("score"), F.desc("hits"), "doc_id", "pos")
    return s.withColumn("rk", F.row_number().over(w)).filter("rk <= 3").select("source", "doc_id", "pos", "hits", "score", "rk")


from corvane.plans import claim_queries, document_queries, retrieval_queries  # noqa: E402, F401
from corvane.plans import pass_queries, report_queries, review_queries  # noqa: E402, F401
from corvane.plans import cache_queries, engage_queries, job_queries, record_queries, source_queries, term_queries, validate_queries  # noqa: E402, F401
