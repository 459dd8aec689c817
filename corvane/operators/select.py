"""Ranking and selection: top-k with guarantees, diversity, budgets, quotas.

Ranks are windows over explicit orders that end in a unique key; a rank filter becomes a group limit before
the shuffle.  Orders over a whole table are taken only as top-k (limit), never as a global window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import text as T
from corvane.sources.scratch import stash


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def ranked_top(rows: DataFrame, order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows with their ranks; the window runs over these k only."""
    return rows.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def with_group_guarantee(rows: DataFrame, group: str, score: str, key: str, k: int, least: float) -> DataFrame:
    """The top k, and of every group without one its best row if that scores at least so much."""
    order = [F.desc(score), F.asc(key)]
    top = rows.orderBy(*order).limit(k)
    best = top_per_group(rows, [group], order, 1).filter(F.col(score) >= least).drop("rank")
    return top.withColumn("reason", F.lit("top")).unionByName(best.join(F.broadcast(top.select(group).distinct()), group, "left_anti").withColumn("reason", F.lit("coverage")))


def merged_queries(rows: DataFrame, query: str, group: str, score: str, key: str, k: int, least: float) -> DataFrame:
    """Selections of several queries with guarantees, each chunk once with its best score: (key, score, queries).

    Of each query the top k, and of each of its groups without one the best row; ranks are limited before the shuffle."""
    order = [F.desc(score), F.asc(key)]
    top = top_per_group(rows, [query], order, k).drop("rank")
    best = top_per_group(rows, [query, group], order, 1).drop("rank").filter(F.col(score) >= least)
    chosen = top.unionByName(best.join(top.select(query, group).distinct(), [query, group], "left_anti"))
    return chosen.groupBy(key).agg(F.max(score).alias(score), F.count("*").alias("queries"))


def capped_selection(chosen: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best of the queries' selections."""
    return chosen.orderBy(F.desc(score), F.asc(key)).limit(k)


def rejected(scored: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scored rows that were not selected."""
    return scored.join(chosen.select(*keys).distinct(), list(keys), "left_anti")


def expanded(rows: DataFrame, query: str, order: Sequence[Column | str], key: str, each: int, most: int) -> DataFrame:
    """Union of the queries' top rows in the queries' order (a number), a row for its first query only, at most so many."""
    top = top_per_group(rows, [query], order, each)
    first = top_per_group(top, [key], [F.asc(query)], 1, "__first").drop("__first")
    return first.orderBy(query, "rank").limit(most)


def diverse(rows: DataFrame, group: str, order: Sequence[Column | str], limit: int, cap: int) -> DataFrame:
    """One row of every group, then up to cap of each, then the rest, in order, to the limit."""
    r = top_per_group(rows, [group], order, limit, "__n")
    r = r.withColumn("pass", F.when(F.col("__n") == 1, 1).when(F.col("__n") <= cap, 2).otherwise(3)).drop("__n")
    return r.orderBy("pass", *order).limit(limit)


def combined_score(relevance: Column, priority: Column, signals: Column) -> Column:
    """Score by which chunks compete for a budget: relevance, boost of the priority, strength of the signals; null for skipped ones."""
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in L.PRIORITY_BOOST.items() for x in kv]), priority)
    return F.when(priority != "skip", relevance + boost * 0.30 + signals * 0.25)


def _fold(size: str, left: int, names: list[str]) -> Callable:
    """Of rows in order those that fit what is left, each after the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = left
        for batch in batches:
            fits = []
            for n in batch.column(batch.schema.get_field_index(size)).to_pylist():
                fits.append(n <= room)
                room -= n * (n <= room)
            yield batch.filter(pa.array(fits, pa.bool_())).select(names)

    return run


def within_budget(rows: DataFrame, order: Sequence[Column | str], size: str, budget: int, ranges: int | None = None) -> DataFrame:
    """Rows in order, each taken if it still fits the budget, so that a later smaller one may; null sizes never fit.

    Rows are dealt by ranges of the order.  Ranges whose rows all fit are taken whole, by their sums alone; the range in which
    the budget runs out is read row by row, in one task; what is left goes on to the rows of the ranges after it that could
    still fit.  The driver sees sums of ranges only.  order ends in a unique key."""
    by = [(F.expr(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
    keyed = rows.filter(F.col(size).isNotNull()).withColumn("__o", F.struct(*by))
    dealt = keyed.repartitionByRange(ranges, "__o") if ranges else keyed.repartitionByRange("__o")
    dealt = stash(dealt.withColumn("__p", F.spark_partition_id()), "ranges")
    left, first, taken, columns = budget, 0, None, rows.columns
    while True:
        live = dealt.filter((F.col("__p") >= first) & (F.col(size) <= left))
        sums = sorted(live.groupBy("__p").agg(F.sum(size).alias("n")).collect())  # a row a range
        whole, limit, tight = [], left, None
        for p, n in sums:
            if n > left:
                tight = p
                break
            whole.append(p)
            left -= n
        if whole:
            part = dealt.filter(F.col("__p").between(whole[0], whole[-1]) & (F.col(size) <= limit)).select(columns)
            taken = part if taken is None else taken.unionByName(part)
        if tight is None:
            return rows.limit(0) if taken is None else taken
        here = dealt.filter((F.col("__p") == tight) & (F.col(size) <= left)).repartition(1).sortWithinPartitions("__o")
        part = stash(here.select(*columns).mapInArrow(_fold(size, left, columns), rows.schema), "tight")
        taken = part if taken is None else taken.unionByName(part)
        left -= part.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        first = tight + 1


def quota_by_turns(rows: DataFrame, profile: str, score: str, key: str, n: int) -> DataFrame:
    """(position, key, profile): n rows, an equal quota for each profile in its order (0, 1, ...), by turns.

    A profile takes its best rows that no earlier one took; slots left over go to the first profile's n best rows.
    rows: one for each key and profile, with its score; few profiles, and n rows at most are gathered."""
    order = [F.desc(score), F.asc(key)]
    n_profiles = int(rows.agg(F.max(profile)).first()[0] or 0) + 1
    quota, seen, turns = max(1, n // n_profiles), set(), []
    for p in range(n_profiles):
        # what earlier profiles took is at most n rows, so so many more hold the quota
        best = rows.filter(F.col(profile) == p).orderBy(*order).limit(quota + len(seen)).select(key).collect()
        mine = [r[0] for r in best if r[0] not in seen][:quota]
        seen |= set(mine)
        turns += [(i, p, k) for i, k in enumerate(mine)]
    chosen = [(k, p) for _, p, k in sorted(turns, key=lambda x: x[:2])][:n]
    first = [r[0] for r in rows.filter(F.col(profile) == 0).orderBy(*order).limit(n).select(key).collect()]
    chosen += [(k, 0) for k in first if k not in seen][: n - len(chosen)]
    schema = f"position int, `{key}` {rows.schema[key].dataType.simpleString()}, `{profile}` int"
    return rows.sparkSession.createDataFrame([(i, k, p) for i, (k, p) in enumerate(chosen)], schema)


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str, prefix: str) -> DataFrame:
    """Rows with a sequential id (E001, E002, ...) in an order that ends in a unique key.

    Rows are dealt by ranges and numbered within them; only the ranges' sizes meet in one place."""
    spread = stash(rows.repartitionByRange(*[F.expr(o) if isinstance(o, str) else o for o in order]).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy("__p").agg(F.count("*").alias("__n"))  # one row a range
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    out = spread.withColumn("__i", place).join(F.broadcast(before), "__p")
    return out.withColumn(name, T.numbered(prefix, F.col("__before") + F.col("__i"))).drop("__p", "__i", "__before")


def deduplicated(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key."""
    return top_per_group(rows, keys, order, 1, "__first").drop("__first")


def latest(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Last row of every key, combined before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("r")).select(key, "r.*")
