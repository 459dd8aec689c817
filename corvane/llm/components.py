"""Connected components of a table of links: alternating large-star and small-star rounds.

Every round is a few shuffles of the links, written to the shared folder; minima are combined before the
shuffle and the joins back can be split, so a hub's links need not meet in one task.

Cases: links of an id with itself and repeated links count for nothing; no links give no rows; ids are longs, not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import stash


def _star(links: DataFrame, both: DataFrame, large: bool) -> DataFrame:
    # written, so that the join back can split the links of a hub
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    pairs = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.unionByName(least.filter("u != m").select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: (a, b) of longs.  Gives (id, component) of every linked id; component is the least id reachable."""
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stash(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = stash(_star(edges, both, True), "large-star")
        edges = stash(_star(big, big, False), "small-star")
        # two hashes of 64 bits for the whole set of links, whatever their order
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
