"""Queries with vocabularies that are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import classify, link, record, retrieve, terms
from corvane.plans import carriers as K
from corvane.plans import document_queries as D
from corvane.plans import retrieval_queries as Q
from corvane.plans.catalog import query

_VOCABULARY_SQL = "select distinct unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) term from benchmark union select distinct lower(p_brand) from part"


@query(f"select term, count(*) documents, min(doc_id) first_doc from documents, ({_VOCABULARY_SQL}) where contains(lower(text), term) group by term")
def vocabulary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each of thousands of terms, in one pass."""
    words = K.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    vocabulary = words.union(K.table(spark, sf_dir, "part").select(F.lower("p_brand"))).distinct()
    held = terms.labelled(K.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary, label="term")
    return held.select("doc_id", F.explode("labels").alias("term")).groupBy("term").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


_PROFILES = (("compute", ("gpu", "rack", "nvl72", "kw")), ("grid", ("mw", "interconnection", "nerc", "kw")), ("nuclear", ("reactor", "licensing", "months", "mw")))
_HITS = ", ".join(f"{K.sql_hits('claim', terms)}" for _, terms in _PROFILES)


@query(
    f"""with h as (select id, [{_HITS}] h from {K.CLAIMS_SQL})
    select id, case when list_max(h) = 0 then 'general' else [{", ".join(K.quoted(n) for n, _ in _PROFILES)}][list_position(h, list_max(h))] end profile, list_max(h) hits from h"""
)
def profile_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by the profile of which they hold most terms."""
    v = spark.createDataFrame([(n, i, t) for i, (n, terms_) in enumerate(_PROFILES) for t in terms_], "profile string, profile_ord int, term string")
    return link.profile_attribution(K.claims(spark, sf_dir), "id", "claim", v, "general")


@query(f"with a as ({{}}), p as (select unnest([{', '.join(K.quoted(n) for n, _ in _PROFILES)}, 'unused']) profile) select p.profile, count(a.id) n, case when count(a.id) >= 10 then 'STRONG' when count(a.id) >= 3 then 'MODERATE' when count(a.id) > 0 then 'WEAK' else 'NONE' end as level_ from p left join a on a.profile = p.profile group by 1".replace("{}", f"""with h as (select id, [{_HITS}] h from {K.CLAIMS_SQL}) select id, case when list_max(h) = 0 then 'general' else [{", ".join(K.quoted(n) for n, _ in _PROFILES)}][list_position(h, list_max(h))] end profile from h"""))
def attribution_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([(n,) for n, _ in (*_PROFILES, ("unused", ()))], "profile string")
    return link.attribution_levels(profile_attribution(spark, sf_dir), p).withColumnRenamed("level", "level_")


_HINTS = {"primary": ("regulator", "blog"), "secondary": ("vendor",), "synthetic": ("test_",)}
_RULE = (("market", "analysis"), "market_study", 4)
_HINT_SQL = " ".join(f"when {K.sql_any('name', _HINTS[t])} then {{{i}}}" for i, t in enumerate(("synthetic", "primary", "secondary")))


@query(
    f"""with n as (select s_suppkey id, {D._NAME} as name from supplier)
    select id, case {_HINT_SQL.format("'synthetic'", "'authoritative_primary'", "'industry_vendor'")} when contains(lower(name), 'market') and contains(lower(name), 'analysis') then 'market_study' else {D._quality_sql(0)} end source_type,
    case {_HINT_SQL.format(1, 5, 4)} when contains(lower(name), 'market') and contains(lower(name), 'analysis') then 4 else {D._quality_sql(1)} end quality from n"""
)
def tiered_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source quality by a profile's hints and rules before the general ones."""
    k = F.col("s_suppkey")
    name = F.concat(F.get(F.array(*map(F.lit, D._NAMES)), (k % len(D._NAMES)).cast("int")), F.lit(" "), k, F.when(k % 2 == 0, ".txt").otherwise(".pdf"))
    return K.table(spark, sf_dir, "supplier").select(k.alias("id"), classify.source_quality(name, _HINTS, [_RULE]).alias("q")).select("id", "q.source_type", "q.quality")


@query(
    f"""with s as (select doc_id, overall, round(sem * f, 4) score, round(sem, 4) semantic from {Q._HYBRID} where sem > 0)
    select doc_id, score, semantic, row_number() over (order by score desc, overall desc, doc_id) rank from s where score >= 0.01 order by rank limit 40"""
)
def semantic_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best statements by their vectors, weighed by their records."""
    c = retrieve.candidates(Q._statements(spark, sf_dir), Q._metadata(spark, sf_dir), "doc_id")
    e = K.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    r = retrieve.top(retrieve.scored(c.join(e, "doc_id"), "semantic", Q._WORDS, Q._query_vector(spark, sf_dir)), 40, "doc_id")
    return r.select("doc_id", "score", F.round("semantic", 4).alias("semantic"), F.col("rank").cast("long").alias("rank"))


@query("select c_custkey id, count(o_orderkey) streams, (c_custkey % 4)::int n_themes, (c_custkey % 3)::int n_unknowns, coalesce(sum(o_orderkey % 5), 0)::int research_questions from customer left join orders on o_custkey = c_custkey group by c_custkey")
def architecture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact counts of decision architectures: a customer's orders as streams."""
    k = F.col("c_custkey")
    listed = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    o = K.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(listed(F.col("o_orderkey") % 5).alias("questions"))).alias("s"))
    a = K.table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select(k.alias("id"), "s", listed(k % 4).alias("themes"), F.when(k % 3 > 0, listed(k % 3)).alias("unknowns"))
    return record.architecture_counts(a, "id", "s", ("themes", "unknowns"), "questions").withColumn("streams", F.col("streams").cast("long"))
