"""Links between small vocabularies and evidence, and between the records of a decision.

Token overlaps are equi-joins on exploded tokens, combined per pair before the shuffle; best matches are
max_by aggregations, so nothing is compared pair by pair and ties go to the first in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import terms
from corvane.sources.scratch import bounded_broadcast

#: Words that link nothing.
STOP = ("the", "a", "an", "of", "in", "is", "are", "to", "for", "and", "or", "what", "how", "why", "does", "do", "can", "with", "that", "this", "it", "be", "by", "at", "as")
#: Evidence categories and the areas of investigation they belong to.
AREAS = {"power": "Power", "cooling": "Cooling", "networking": "Networking", "rack architecture": "Rack Architecture", "architecture": "Architecture", "operations": "Operations", "gpu": "GPU", "facility": "Facility", "resiliency": "Resiliency", "economics": "Economics", "construction": "Construction", "licensing": "Regulation", "reactor design": "SMR Technology", "grid integration": "Grid Integration", "fuel cycle": "Fuel Cycle", "deployment timeline": "Deployment Timeline", "safety": "Safety", "waste management": "Waste Management", "bwrx": "SMR Technology", "nuscale": "SMR Technology", "other": "Other"}


def tokens(text: Column) -> Column:
    return T.tokens(text, "[a-z0-9]+", STOP, 3, distinct=True)


def overlaps(items: DataFrame, item: str, text: str, targets: DataFrame, target: str, target_text: str) -> DataFrame:
    """(item, target, overlap) of pairs that share a token.  targets is a vocabulary: broadcast if a count proves it small."""
    a = items.select(F.col(item), F.explode(tokens(F.col(text))).alias("__t"))
    b = targets.select(F.col(target), F.explode(tokens(F.col(target_text))).alias("__t"))
    return a.join(bounded_broadcast(b), "__t").groupBy(item, target).agg(F.count("*").alias("overlap"))


def best_target(items: DataFrame, item: str, text: str, targets: DataFrame, target: str, target_text: str, default: object = None) -> DataFrame:
    """(item, target, overlap): the target with most shared tokens, the first of equals; default where none is shared."""
    pairs = overlaps(items, item, text, targets, target, target_text)
    best = pairs.groupBy(item).agg(F.min_by(target, F.struct(-F.col("overlap"), F.col(target))).alias(target), F.max("overlap").alias("overlap"))
    return items.select(item).join(best, item, "left").select(item, F.coalesce(F.col(target), F.lit(default)).alias(target), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def profile_attribution(items: DataFrame, key: str, text: str, vocabulary: DataFrame, fallback: str) -> DataFrame:
    """(key, profile, hits): the profile of which an item's text holds most terms, the first by profile_ord of equals; fallback without any.

    vocabulary: profile, profile_ord and term, a row each.  An item's terms are found at once; profiles are counted per item."""
    v = vocabulary.select(F.to_json(F.struct("profile_ord", "profile", F.lower("term").alias("term"))).alias("label"), "term")
    held = terms.labelled(items.select(key, F.col(text).alias("__t")), "__t", v, out="__l").select(key, F.explode("__l").alias("l"))
    said = F.from_json("l", "profile_ord int, profile string, term string")
    n = held.select(key, said.alias("x")).groupBy(key, "x.profile", "x.profile_ord").agg(F.count("*").alias("hits"))
    best = n.groupBy(key).agg(F.min_by("profile", F.struct(-F.col("hits"), F.col("profile_ord"))).alias("profile"), F.max("hits").alias("hits"))
    return items.select(key).join(best, key, "left").select(key, F.coalesce("profile", F.lit(fallback)).alias("profile"), F.coalesce("hits", F.lit(0)).alias("hits"))


def attribution_levels(attributed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, n, level) of every profile: how much evidence was attributed to it."""
    n = profiles.select("profile").distinct().join(attributed.groupBy("profile").agg(F.count("*").alias("n")), "profile", "left").na.fill(0, ["n"])
    return n.withColumn("level", F.when(F.col("n") >= 10, "STRONG").when(F.col("n") >= 3, "MODERATE").when(F.col("n") > 0, "WEAK").otherwise("NONE"))


def round_robin(unmatched: DataFrame, order: str, n: int) -> Column:
    return (F.row_number().over(Window.orderBy(order)) - 1) % n


def area_links(evidence: DataFrame, areas: DataFrame, key: str = "id", area: str = "area") -> DataFrame:
    """(key, area): by a token shared with the area's name, or by the category's own area."""
    said = F.concat_ws(" ", F.col("category"), F.array_join("topics", " "))
    by_token = overlaps(evidence.withColumn("__s", said), key, "__s", areas, area, area).select(key, area)
    own = F.element_at(F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv]), F.col("category"))
    by_map = evidence.select(key, own.alias(area)).join(bounded_broadcast(areas.select(area)), area, "left_semi").select(key, area)
    return by_token.unionByName(by_map).distinct()


def shared_links(a: DataFrame, a_key: str, b: DataFrame, b_key: str, columns: tuple[str, ...]) -> DataFrame:
    """(a_key, b_key) of records whose arrays share an element in one of the columns."""
    out = None
    for c in columns:
        x = a.select(a_key, F.explode(c).alias("__v")).distinct()
        y = b.select(b_key, F.explode(c).alias("__v")).distinct()
        j = x.join(y, "__v").select(a_key, b_key)
        out = j if out is None else out.unionByName(j)
    return out.distinct()


def grouped(links: DataFrame, key: str, other: str) -> DataFrame:
    return links.groupBy(key).agg(F.array_sort(F.collect_set(other)).alias(f"{other}s"))


def orphans(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return rows.select(key).join(links.select(key).distinct(), key, "left_anti")


def closure(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every conflict, by record."""
    both = pairs.select(F.col(a).alias("id"), F.col(b).alias("other")).unionByName(pairs.select(F.col(b).alias("id"), F.col(a).alias("other")))
    return both.filter("id <> other").groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("conflicts_with"))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two sets; 1 for two empty ones."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_report(a: Column, b: Column) -> Column:
    """(jaccard, shared, only_a, only_b) of two sets, sorted."""
    return F.struct(
        F.round(set_overlap(a, b), 3).alias("jaccard"),
        F.array_sort(F.array_intersect(a, b)).alias("shared"),
        F.array_sort(F.array_except(a, b)).alias("only_a"),
        F.array_sort(F.array_except(b, a)).alias("only_b"),
    )


def result_sources(results: DataFrame, key: str, ids: str, evidence: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, source_id, uri): the source of a result's first supporting evidence; null where there is none.

    evidence: evidence_id, source_id; manifest: source_id, uri."""
    first = results.select(key, F.get(F.col(ids), 0).alias("evidence_id"))
    return first.join(evidence.select("evidence_id", "source_id"), "evidence_id", "left").join(manifest.select("source_id", "uri"), "source_id", "left").select(key, "source_id", "uri")
