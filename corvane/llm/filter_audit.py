"""Audit of how five filters interact: what each removes in every order in which they can be applied.

Each document gets a mask of the filters that it fails, by one narrow pass; only digests of texts, ids and masks are
shuffled.  Documents are then counted by part and mask: at most 32 cells a part, whatever its size.  All 120 orders are
visited by swapping two neighbours at a time (Steinhaus, Johnson and Trotter's walk), and a swap changes two steps alone,
which are counted anew from the cells; the sums of removed documents over the walk are the Shapley values times 120.

A document fails
    A  with fewer than 50 words,
    B  if 100 * distinct words < 65 * words,
    C  if 100 * capitals A-Z > 5 * code points,
    D  if it holds one of # $ % & * |,
    E  if the text is that of a smaller id, anywhere in the table.

Cases: a null text counts as an empty one, which fails A, and E if an empty text has a smaller id; a null id is neither
smaller nor larger than any, so its row never fails E; rows that share id and text do not fail each other; a null part
counts as the part ''; several labels of an id count as one that is 1 where any is; labels may be null or lacking; an
empty table gives an empty result; texts are read whole; other columns may have any names, as only the named ones are
read.  Texts are equal if their SHA-256 is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import text_or_empty, words_of

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
MARKS = "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def _text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    fails = (
        n < MIN_WORDS,
        100 * different < DISTINCT_SHARE * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_SHARE * F.length(text).cast("long"),
        text.rlike(MARKS),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """part, mask (bit i: fails the filter i), n documents, of them n_good and n_toxic: a row for each mask that occurs.

    Rows are counted by (text, id) where ids meet their labels, then by (text, part): a text that many rows share comes to
    few rows before its least id is looked up.
    """
    t = docs.select(F.coalesce(docs[part], F.lit("")).alias("part"), docs[doc_id].alias("id"), text_or_empty(docs, text).alias("t"))
    words = F.filter(words_of(F.col("t")), lambda w: w != "")
    t = t.select("part", "id", F.unhex(F.sha2("t", 256)).alias("digest"), _text_mask(F.col("t"), words).alias("mask"))
    one = lambda c: F.max((F.coalesce(labels[c], F.lit(0)) == 1).cast("int")).alias(c)
    known = labels.filter(labels[doc_id].isNotNull()).groupBy(labels[doc_id].alias("label_id")).agg(one("quality"), one("toxic"))
    t = t.join(known, F.col("id") == F.col("label_id"), "left")
    t = t.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    keys = ["part", "digest", "mask", "quality", "toxic"]
    rows = t.groupBy("id", *keys).agg(F.count("*").alias("n"))
    rows = rows.groupBy(*keys, F.col("id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"))
    firsts = rows.filter(~F.col("nameless")).groupBy(F.col("digest").alias("d")).agg(F.min("least").alias("first"), F.sum("n").alias("all"))
    firsts = firsts.filter(F.col("all") > 1).select("d", "first")  # texts that stand alone fail nothing by E
    rows = rows.join(firsts, F.col("digest") == F.col("d"), "left")
    passing = F.when(F.col("nameless") | F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n"))))
    rows = rows.select("part", "quality", "toxic", split.alias("s")).filter("s.n > 0")
    return rows.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("quality")).alias("n_good"), F.sum(F.col("s.n") * F.col("toxic")).alias("n_toxic")
    )


def swaps(n: int) -> list[int]:
    """The walk through all orders of n things: at each move the place whose thing changes with its right neighbour."""
    order, toward, moves = list(range(n)), [-1] * n, []
    while True:
        free = [(v, i) for i, v in enumerate(order) if 0 <= i + toward[v] < n and order[i + toward[v]] < v]
        if not free:
            return moves
        v, i = max(free)
        j = i + toward[v]
        order[i], order[j] = order[j], order[i]
        toward = [-d if u > v else d for u, d in enumerate(toward)]
        moves.append(min(i, j))


MOVES = swaps(len(FILTERS))


def walk(mask: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """From a part's cells (counts: n, n_good, n_toxic): the orders, for each step of each what it removes, and the sum of
    each filter's removed documents over all orders."""
    k = len(FILTERS)

    def lost(before: int, f: int) -> np.ndarray:
        return counts[:, ((mask >> f) & 1 == 1) & (mask & before == 0)].sum(axis=1)

    order, said, steps = list(range(k)), [], []
    now = np.stack([lost(sum(1 << g for g in order[:i]), f) for i, f in enumerate(order)])
    sums = np.zeros(k, np.int64)
    for move in [None, *MOVES]:
        if move is not None:
            order[move], order[move + 1] = order[move + 1], order[move]
            before = sum(1 << g for g in order[:move])
            now = now.copy()
            now[move], now[move + 1] = lost(before, order[move]), lost(before | 1 << order[move], order[move + 1])
        said.append("".join(FILTERS[f] for f in order))
        steps.append(now)
        sums[order] += now[:, 0]
    return said, np.stack(steps), sums


def _audit_part(cell: pd.DataFrame) -> pd.DataFrame:
    mask, counts = cell["mask"].to_numpy(), cell[["n", "n_good", "n_toxic"]].to_numpy(np.int64).T
    said, removed, sums = walk(mask, counts)
    k = len(FILTERS)
    of = np.array([[FILTERS.index(c) for c in order] for order in said])
    fails = np.array([counts[0, (mask >> f) & 1 == 1].sum() for f in range(k)])
    alone = np.array([counts[0, mask == 1 << f].sum() for f in range(k)])
    out = {
        "part": cell["part"].iloc[0],
        "filter_order": np.repeat(said, k),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(said)),
        "kept": (counts[0].sum() - removed[:, :, 0].cumsum(axis=1)).ravel(),
        "removed": removed[:, :, 0].ravel(),
        "redundant": (fails[of] - removed[:, :, 0]).ravel(),
        "unique_fails": alone[of].ravel(),
        "good_lost": removed[:, :, 1].ravel(),
        "toxic_lost": removed[:, :, 2].ravel(),
        "shapley": sums[of].ravel(),
    }
    return pd.DataFrame(out)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """part, filter_order, step and the counts: five rows for each of 120 orders of each part."""
    return cells(docs, labels, part, text, doc_id).groupBy("part").applyInPandas(_audit_part, SCHEMA)


ORACLE_SQL = r"""
with t as (select coalesce(source, '') part, doc_id, coalesce(text, '') t from documents),
l as (select doc_id, max((quality = 1)::int) q, max((toxic = 1)::int) x from labels group by doc_id),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda y: y <> '') w, min(doc_id) over (partition by t) least from t),
m as (select part, coalesce(q, 0) q, coalesce(x, 0) x, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(least < w.doc_id, false)::int mask from w left join l on w.doc_id = l.doc_id),
c as (select part, mask, count(*) n, sum(q) g, sum(x) x from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) f, unnest([1, 2, 4, 8, 16]) b),
o as (select a.f || b.f || c.f || d.f || e.f o, [a.b, b.b, c.b, d.b, e.b] bits from f a join f b on b.b <> a.b
    join f c on c.b not in (a.b, b.b) join f d on d.b not in (a.b, b.b, c.b) join f e on e.b not in (a.b, b.b, c.b, d.b)),
s as (select o, step, bits[step] b, coalesce(list_sum(bits[1:step - 1]), 0)::int before from o, (select unnest(range(1, 6)) step)),
r as (select part, o, step, b, sum(case when mask & (before | b) = 0 then n else 0 end) kept,
    sum(case when mask & b > 0 and mask & before = 0 then n else 0 end) removed, sum(case when mask & b > 0 and mask & before > 0 then n else 0 end) redundant,
    sum(case when mask = b then n else 0 end) unique_fails, sum(case when mask & b > 0 and mask & before = 0 then g else 0 end) good_lost,
    sum(case when mask & b > 0 and mask & before = 0 then x else 0 end) toxic_lost from c, s group by all)
select part, o filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, b))::bigint shapley from r
"""
