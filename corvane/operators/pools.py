"""Comparisons of sets that are tables: pools of ids, many to a key, without gathering one.

Exact comparisons count a full join of distinct members.  For many pools compared with each other, sketches of fixed size
(theta, mergeable) give estimates: a pool is read once, whatever the number of comparisons.

Cases: null members do not count; a pool without members is empty, and two empty ones are equal (Jaccard 1); repeated members
count once; keys that stand in neither table appear only if keys are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def members(a: DataFrame, b: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member, side) with side shared, only_a or only_b: one row for each member of each key."""
    side = lambda d, name: d.filter(F.col(member).isNotNull()).select(key, member).distinct().withColumn(name, F.lit(True))
    both = side(a, "__a").join(side(b, "__b"), [key, member], "full_outer")
    return both.select(key, member, F.when(F.col("__a").isNull(), "only_b").when(F.col("__b").isNull(), "only_a").otherwise("shared").alias("side"))


def jaccard(shared: Column, only_a: Column, only_b: Column) -> Column:
    every = shared + only_a + only_b
    return F.when(every == 0, 1.0).otherwise(shared / every)


def comparison(a: DataFrame, b: DataFrame, key: str, member: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, shared, only_a, only_b, jaccard) of two pools for each key."""
    count = lambda s: F.count_if(F.col("side") == s).alias(s)
    c = members(a, b, key, member).groupBy(key).agg(count("shared"), count("only_a"), count("only_b"))
    if keys is not None:
        c = keys.select(key).distinct().join(c, key, "left").na.fill(0, ["shared", "only_a", "only_b"])
    return c.withColumn("jaccard", F.round(jaccard(F.col("shared"), F.col("only_a"), F.col("only_b")), 6))


def sketches(rows: DataFrame, pool: str, member: str, log_entries: int = 12) -> DataFrame:
    """(pool, sketch): a theta sketch of each pool, of 2^log_entries hashes at most."""
    return rows.filter(F.col(member).isNotNull()).groupBy(pool).agg(F.theta_sketch_agg(member, F.lit(log_entries)).alias("sketch"))


def estimates(sketched: DataFrame, pairs: DataFrame, pool: str, log_entries: int = 12) -> DataFrame:
    """(a, b, shared, every, jaccard), estimated, of the given pairs (a, b) of pools; the error is about 2^(-log_entries / 2)."""
    side = lambda n: sketched.select(F.col(pool).alias(n), F.col("sketch").alias(f"__{n}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.theta_sketch_estimate(F.theta_intersection("__a", "__b"))
    every = F.theta_sketch_estimate(F.theta_union("__a", "__b", F.lit(log_entries)))
    return p.select("a", "b", shared.alias("shared"), every.alias("every"), F.when(every == 0, 1.0).otherwise(shared / every).alias("jaccard"))
