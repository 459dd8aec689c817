"""Ranked retrieval over stored statements: lexical, semantic and hybrid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import score, select


def candidates(statements: DataFrame, metadata: DataFrame, key: str, enabled_only: bool = True, types: Sequence[str] = (), profile: str | None = None) -> DataFrame:
    """Statements with their record (overall, priority, value, enabled); without one they drop out."""
    m = metadata.filter("enabled") if enabled_only else metadata
    s = statements
    if types:
        s = s.filter(F.col("store_type").isin(*types))
    if profile:
        s = s.filter(F.array_contains("profiles", profile))
    return s.join(m, key)


def scored(rows: DataFrame, mode: str, terms: Sequence[str], query: Sequence[float] | None = None, statement: str = "statement", vector: str = "embedding", least: float = 0.01) -> DataFrame:
    """Rows with lexical, semantic and score; rows below the least score, or without a signal, drop out."""
    lex = score.lexical_relevance(F.col(statement), terms)
    sem = score.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])) if query is not None else F.lit(0.0)
    factor = score.metadata_factor(F.col("overall"), F.col("priority"), F.col("value"))
    r = rows.withColumns({"lexical": lex, "semantic": sem})
    if mode == "lexical":
        r = r.withColumn("score", F.round(F.col("lexical") * factor, 4))
    elif mode == "semantic":
        r = r.filter("semantic > 0").withColumn("score", F.round(F.col("semantic") * factor, 4))
    elif mode == "hybrid":
        r = r.withColumn("semantic", F.greatest("semantic", F.lit(0.0))).filter("lexical > 0 or semantic > 0")
        r = r.withColumn("score", F.round((0.4 * F.col("lexical") + 0.6 * F.col("semantic")) * factor, 4))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return r.filter(F.col("score") >= least)


def top(rows: DataFrame, k: int, key: str) -> DataFrame:
    """The k best with ranks; ties by overall, then key."""
    return select.ranked_top(rows, [F.desc("score"), F.desc("overall"), F.asc(key)], k)


def reranked(candidates_: DataFrame, order: DataFrame, key: str, k: int) -> DataFrame:
    """Candidates in an order given elsewhere (key, position): unknown keys and repeats are ignored, the rest follow by rank."""
    first = order.groupBy(key).agg(F.min("position").alias("position"))
    r = candidates_.join(first, key, "left").withColumn("__given", F.col("position").isNull())
    return select.ranked_top(r.drop("rank"), [F.asc("__given"), F.asc("position"), F.desc("score"), F.asc(key)], k).drop("__given", "position")
