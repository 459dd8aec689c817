"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets base counts (words, symbols, repeated lines, words in repeated word triples).  Four rates
made of them go into bucket-count sketches per (language, source): a bucket keeps the five leading bits of a
value, so a sketch is small, merges by adding counts, and its quantiles are right to a sixteenth.  The fences, which
replace fixed cutoffs, are tail quantiles of these sketches: a document stays if each of its rates lies in the bucket of
the quantile 1 - TAIL or below (its word length also in that of the quantile TAIL or above).  A pair with fewer than
MIN_GROUP documents takes the merged sketch of its language, or of all documents.  The fences are joined back.

Cases: a null text has no words, so it fails; null languages and sources are groups of their own; repeated
rows count as often as they occur; ties at a fence are kept; texts are read whole; an empty table gives an
empty result; other columns may have any names, as only the named ones are read.  Triples are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.base import BLANKS, bounded_broadcast, stash, words_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: The least group that has a tail of its own.
MIN_GROUP = 100
BROADCAST_ROWS = 10_000
#: Per cent of a group's documents beyond a fence, at most.
TAIL = 1
#: Rates: per mille, the last in hundredths of characters a word.
RATES = ("symbols", "repeats", "dup_lines", "word_length")


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, by one narrow pass."""
    t = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__t"))
    t = t.select(*keep, "__t", F.btrim("__t", F.lit(BLANKS)).alias("__trim"))
    t = t.select(
        *keep,
        F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(words_of(F.col("__t"))).alias("__w"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("__lines"),
    )
    n = F.size("__w")
    triples = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))
    t = t.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, triples).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    ordered = F.when(some, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s")
    t = t.select(*[c for c in t.columns if c != "__h"], ordered)
    one_less = F.size("__s") - 1
    pairs = F.zip_with(
        F.slice("__s", F.lit(1), one_less), F.slice("__s", F.lit(2), one_less), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))
    )
    at = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    covered = F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))
    return t.select(*[c for c in t.columns if c != "__s"], F.when(F.col("__s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def _rates() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    over = lambda a, b, k: F.floor(F.col(a) * k / b).cast("long")
    return {
        "symbols": over("n_symbols", words, 1000),
        "repeats": over("n_repeat_words", words, 1000),
        "dup_lines": over("n_dup_lines", lines, 1000),
        "word_length": over("word_chars", words, 100),
    }


def _shift(v: Column) -> Column:
    return F.greatest(F.length(F.bin(v)) - 5, F.lit(0))


def bucket(v: Column) -> Column:
    """Lower bound of a value's bucket: its five leading bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", v, _shift(v)), _shift(v))


def bucket_end(low: Column) -> Column:
    """Largest value of the bucket with that lower bound."""
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(low)) - 1


def sketches(counted: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Sketch rows (groups, rate, bucket, n) of the documents that pass the base rules."""
    names = list(_rates())
    long = counted.filter(~F.col("base_failed")).select(
        *groups, F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bucket(F.col(f"__{k}")).alias("bucket")) for k in names])).alias("r")
    )
    return long.groupBy(*groups, "r.rate", "r.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Tail quantiles of every key from its sketch: one row with <rate>_low and <rate>_high, and the count."""
    w = Window.partitionBy(*keys, "rate")
    c = sketch.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    quantile = lambda share: F.min(F.when(100 * F.col("cum") >= share * F.col("total"), F.col("bucket")))
    q = c.groupBy(*keys, "rate").agg(F.max("total").alias("total"), quantile(TAIL).alias("low"), bucket_end(quantile(100 - TAIL)).alias("high"))
    of = lambda name, side: F.max(F.when(F.col("rate") == name, F.col(side))).alias(f"{name}_{side}")
    return q.groupBy(*keys).agg(F.max("total").alias("group_n"), *[of(name, side) for name in RATES for side in ("low", "high")])


def quality_rules(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, base counts, base_failed and kept of every row."""
    counted = base_counts(docs, (*keep, *groups), text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed).withColumns({f"__{k}": v for k, v in _rates().items()})
    counted = stash(counted, "quality-rules")
    sketch = stash(sketches(counted, groups), "sketches")
    lang, source = groups
    # each pair's level: its own sketch, its language's, or that of all documents; levels are (level, lang, source)
    sizes = sketch.filter(F.col("rate") == "symbols").groupBy(*groups).agg(F.sum("n").alias("n"))
    by_lang = sizes.groupBy(lang).agg(F.sum("n").alias("lang_n"))
    pairs = sizes.alias("a").join(by_lang.alias("b"), F.col(f"a.{lang}").eqNullSafe(F.col(f"b.{lang}"))).select(f"a.{lang}", f"a.{source}", "n", "lang_n")
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("lang_n") >= MIN_GROUP, 1).otherwise(2)
    pairs = pairs.withColumn("level", level)
    none = F.lit(None)
    merged = (
        sketch.withColumn("level", F.lit(0))
        .unionByName(sketch.groupBy(lang, "rate", "bucket").agg(F.sum("n").alias("n")).withColumns({"level": F.lit(1), source: none}))
        .unionByName(sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("n")).withColumns({"level": F.lit(2), lang: none, source: none}))
    )
    own = fences(merged, ["level", lang, source]).alias("f")
    p = pairs.alias("p")
    on = (
        (F.col("p.level") == F.col("f.level"))
        & F.when(F.col("p.level") < 2, F.col(f"p.{lang}")).eqNullSafe(F.col(f"f.{lang}"))
        & F.when(F.col("p.level") < 1, F.col(f"p.{source}")).eqNullSafe(F.col(f"f.{source}"))
    )
    sides = [f"{k}_{s}" for k in RATES for s in ("low", "high")]
    resolved = stash(p.join(own, on).select(f"p.{lang}", f"p.{source}", *sides), "fences")
    d, r = counted.alias("d"), bounded_broadcast(resolved, BROADCAST_ROWS).alias("r")
    joined = d.join(r, F.col(f"d.{lang}").eqNullSafe(F.col(f"r.{lang}")) & F.col(f"d.{source}").eqNullSafe(F.col(f"r.{source}")), "left")
    inside = F.lit(True)
    for k in RATES:
        inside &= F.col(f"d.__{k}") <= F.col(f"r.{k}_high")
        if k == "word_length":
            inside &= F.col(f"d.__{k}") >= F.col(f"r.{k}_low")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = F.when(F.col("d.base_failed"), False).otherwise(F.coalesce(inside, F.lit(True)))
    return joined.select(*[f"d.{c}" for c in (*keep, *base)], kept.alias("kept"))


ORACLE_SQL = r"""
with t as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from t),
b as (select rid, doc_id, lang, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
   len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from w),
g as (select rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] g from (select rid, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)),
r as (select rid, count(distinct p) n from (select rid, unnest([i, i+1, i+2]) p from
   (select rid, i, count(*) over (partition by rid, g) c from g) where c > 1) group by rid),
c as (select b.rid, doc_id, lang, source, n_words, word_chars, n_symbols, len(l)::bigint n_lines,
   (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words from b left join r on b.rid = r.rid),
m as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed,
   floor(n_symbols * 1000 / greatest(n_words, 1))::bigint m1, floor(n_repeat_words * 1000 / greatest(n_words, 1))::bigint m2,
   floor(n_dup_lines * 1000 / greatest(n_lines, 1))::bigint m3, floor(word_chars * 100 / greatest(n_words, 1))::bigint m4 from c),
x as (select lang, source, rate, (v >> s) << s bucket from (select lang, source, rate, v, greatest(length(bin(v)) - 5, 0)::bigint s from
   (select lang, source, unnest([1, 2, 3, 4]) rate, unnest([m1, m2, m3, m4]) v from m where not base_failed))),
k as (select lang, source, rate, bucket, count(*) n from x group by all),
z as (select lang, source, sum(n) n from k where rate = 1 group by all),
zl as (select lang, sum(n) n from z group by all),
p as (select z.lang, z.source, case when z.n >= 100 then 0 when zl.n >= 100 then 1 else 2 end lv from z join zl on z.lang is not distinct from zl.lang),
u as (select 0 lv, lang, source, rate, bucket, n from k
   union all select 1, lang, null, rate, bucket, sum(n) from k group by lang, rate, bucket
   union all select 2, null, null, rate, bucket, sum(n) from k group by rate, bucket),
cu as (select *, sum(n) over (partition by lv, lang, source, rate order by bucket) cum, sum(n) over (partition by lv, lang, source, rate) total from u),
q0 as (select lv, lang, source, rate, min(bucket) filter (where 100 * cum >= total) lo, min(bucket) filter (where 100 * cum >= 99 * total) hi0 from cu group by all),
q as (select *, hi0 + (1::bigint << greatest(length(bin(hi0)) - 5, 0)::bigint) - 1 hi from q0),
f as (select lv, lang, source, max(case when rate = 1 then hi end) h1, max(case when rate = 2 then hi end) h2, max(case when rate = 3 then hi end) h3,
   max(case when rate = 4 then hi end) h4, max(case when rate = 4 then lo end) l4 from q group by all),
pf as (select p.lang, p.source, h1, h2, h3, h4, l4 from p join f on p.lv = f.lv
   and (case when p.lv < 2 then p.lang end) is not distinct from f.lang and (case when p.lv < 1 then p.source end) is not distinct from f.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else coalesce(m1 <= h1 and m2 <= h2 and m3 <= h3 and m4 <= h4 and m4 >= l4, true) end kept
from m left join pf on m.lang is not distinct from pf.lang and m.source is not distinct from pf.source
"""
