"""Queries over caches, pools and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import pools, trace
from corvane.plans import carriers as K
from corvane.plans.catalog import query
from corvane.sources import cache
from corvane.sources.scratch import scratch_path


@query(
    """with p as (select page_id, substr(sha256(url), 1, 16) key from pages), v as (select page_id, key, page_id % 6 m from p), l as (select key, max(case when m in (0, 3) then 1 when m = 1 then 2 when m = 5 then 9 when m = 2 then 3 else 0 end) s from v group by key)
    select page_id, key, case when s in (1, 2) then s end found from p join l using (key)"""
)
def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages looked up in a cache: put, put again, invalidated, broken or never stored."""
    p = K.table(spark, sf_dir, "pages").select("page_id", cache.page_key(F.col("url")).alias("key"))
    m = F.col("page_id") % 6
    by = p.groupBy("key").agg(F.max(F.when(m.isin(0, 3), 1).when(m == 1, 2).when(m == 5, 9).when(m == 2, 3).otherwise(0)).alias("s"))
    c = cache.Cache(spark, scratch_path(spark, "page-cache"))
    payload = lambda n: F.concat(F.lit('{"version": '), F.lit(n), F.lit("}"))
    c.put(by.filter("s in (1, 2, 9)").select("key", payload(1).alias("payload")).unionByName(by.filter("s = 3").select("key", F.lit("{").alias("payload"))), 1)
    c.put(by.filter("s = 2").select("key", payload(2).alias("payload")), 2)
    c.invalidate(by.filter("s = 9"), 2)
    return c.get(p).select("page_id", "key", F.get_json_object("payload", "$.version").cast("int").alias("found"))


_POOL_SQL = "select distinct year(o_orderdate) y, l_suppkey s from orders join lineitem on l_orderkey = o_orderkey where l_quantity > 45"


@query(
    f"""with p as ({_POOL_SQL}), y as (select distinct y from p), a as (select y k, s from p), b as (select y - 1 k, s from p where y - 1 in (select y from y))
    select coalesce(a.k, b.k) k, count(*) filter (where a.s is not null and b.s is not null) shared, count(*) filter (where b.s is null) only_a, count(*) filter (where a.s is null) only_b,
    round(count(*) filter (where a.s is not null and b.s is not null) / count(*)::double, 6) jaccard from a full join b on a.k = b.k and a.s = b.s group by 1"""
)
def pool_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of large orders of each year, against those of the next."""
    o = K.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    items = K.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s"))
    p = o.join(items, "o_orderkey").select(F.col("y").alias("k"), "s")
    years = p.select("k").distinct()
    after = p.select((F.col("k") - 1).alias("k"), "s").join(years, "k", "left_semi")
    return pools.comparison(p, after, "k", "s")


@query(
    """with d as (select lang, length(text) n from documents), k as (select * from d where n >= 1000)
    select 'documents' stage, 'rows' metric, count(*)::double as value_ from d union all select 'documents', 'chars', sum(n)::double from d union all select 'long', 'rows', count(*)::double from k union all select 'long', 'chars', sum(n)::double from k
    union all select 'languages', 'rows', count(distinct lang)::double from k union all select 'languages', 'most', max(c)::double from (select count(*) c from k group by lang)"""
)
def stage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of three stages that reports on itself."""
    run, at = trace.Run(spark, "trace"), scratch_path(spark, "traced")
    d = run.stage("documents", K.table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n")), f"{at}/documents", chars=F.sum("n"))
    k = run.stage("long", d.filter("n >= 1000"), f"{at}/long", chars=F.sum("n"))
    run.stage("languages", k.groupBy("lang").count(), f"{at}/languages", most=F.max("count"))
    run.save(f"{at}/trace")
    return trace.traces(spark, f"{at}/trace").select("stage", "metric", F.col("value").alias("value_"))
