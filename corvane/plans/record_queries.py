"""Queries over decision records; nations stand for engagements, parts for records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.operators import record
from corvane.plans import carriers as K
from corvane.plans.catalog import ORACLES, query
from corvane.plans.retrieval_queries import benchmark_summary

_PHRASES = ("Power density", "power density ", "Cooling choice", "Grid connection", "Approve site plan", "Supply contracts.", "", "Network fabric", "Staffing", "Licensing path", "cooling choice", "Water supply", "Site access")
_ASKED = ("Which cooling choice saves water?", "What does the grid connection cost?", "Who does the staffing?", "Is it wise?", "When does licensing end?", "Why now?", "What is a path to power density?")
#: list: (start modulus, length, words)
_LISTS = {"areas": (4, 6, _PHRASES), "priorities": (7, 5, _PHRASES), "objectives": (5, 8, _PHRASES), "success_criteria": (3, 9, _PHRASES), "known_unknowns": (6, 3, _PHRASES), "uncertainties": (2, 4, _PHRASES), "questions": (3, 5, _ASKED)}
_CUT = lambda words, mod, n: f"[{', '.join(map(K.quoted, words))}][k % {mod} + 1 : k % {mod} + {n}]"
_FRAMES = "(select k, case when k % 3 = 0 then ' ' else ' Decide for ' || name end objective, 'Engagement ' || name title, case when k % 2 = 0 then '5 years' else ' ' end horizon, " + ", ".join(
    f"case when k % 10 = 0 and {int(n in ('areas', 'priorities'))} = 1 then [] else {_CUT(words, mod, size)} end {n}" for n, (mod, size, words) in _LISTS.items()
) + " from (select n_nationkey k, n_name as name from nation))"


def _distinct_sql(lists: str, most: int) -> str:
    """The items of a list expression, trimmed, without blanks, each once, up to a number."""
    x = f"list_filter(list_transform({lists}, lambda x: trim(x)), lambda x: x <> '')"
    return f"list_filter({x}, lambda x, i: list_position(list_transform({x}, lambda y: lower(y)), lower(x)) = i)[1:{most}]"


_THEMED = f"(select *, {_distinct_sql('list_concat(areas, priorities)', 8)} themes from {_FRAMES})"
_BOARD = "list_transform(list_transform(themes, lambda t: rtrim(t, '.')), lambda t: case when t = '' then 'Approve strategy' when " + " or ".join(f"starts_with(lower(t), '{v}')" for v in L.DECISION_VERBS) + " then t else 'Approve ' || t || ' approach' end)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")

    def cut(name: str) -> Column:
        mod, size, words = _LISTS[name]
        held = F.slice(F.array(*map(F.lit, words)), (k % mod).cast("int") + 1, F.lit(size))
        return F.when(k % 10 != 0, held).otherwise(F.array().cast("array<string>")) if name in ("areas", "priorities") else held

    n = K.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return n.select(
        "k",
        F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" Decide for "), "name")).alias("objective"),
        F.concat(F.lit("Engagement "), "name").alias("title"),
        F.when(k % 2 == 0, "5 years").otherwise(" ").alias("horizon"),
        *[cut(x).alias(x) for x in _LISTS],
    )


@query(
    f"""select k, case when trim(objective) <> '' then trim(objective) else trim(title) end statement_, array_to_string(themes, '|') themes, array_to_string({_distinct_sql("list_concat(themes, objectives)", 12)}, '|') in_scope,
      array_to_string(list_concat({_distinct_sql("success_criteria", 8)}, case when trim(horizon) <> '' then ['Decision horizon: ' || trim(horizon)] else [] end)[1:8], '|') success,
      array_to_string({_distinct_sql("list_concat(known_unknowns, uncertainties)", 6)}, '|') unknowns, array_to_string({_distinct_sql(_BOARD, 6)}, '|') board from {_THEMED}"""
)
def decision_architectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = record.architecture(_frames(spark, sf_dir), "k")
    return a.select("k", F.col("statement").alias("statement_"), *[F.array_join(c, "|").alias(c) for c in ("themes", "in_scope", "success", "unknowns", "board")])


_WORDS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9-]{{2,}}'), lambda w: w not in ({', '.join(map(K.quoted, L.STREAM_STOP))})))"


@query(
    f"""with f as (select k, themes, questions from {_THEMED}),
    t as (select k, unnest(themes) title, generate_subscripts(themes, 1) - 1 place from f), q as (select k, unnest(questions) question, generate_subscripts(questions, 1) ord from f),
    s as (select q.k, ord, place, len(list_intersect({_WORDS("question")}, {_WORDS("title")})) s from q join t on q.k = t.k),
    b as (select q.k, q.ord, question, (select arg_max(place, s * 100 - place) from s where s.k = q.k and s.ord = q.ord and s.s > 0) place from q),
    u as (select *, row_number() over (partition by k, place is null order by ord) - 1 turn from b),
    p as (select u.k, ord, question, coalesce(place, turn % greatest(len(themes), 1)) place from u join f on u.k = f.k)
    select t.k, t.place::int place, title, coalesce(string_agg(question, '|' order by ord), '') questions, count(question) n from t left join p on p.k = t.k and p.place = t.place group by all
    union all select k, 0, 'Primary Decision Workstream', array_to_string(questions, '|'), len(questions) from f where len(themes) = 0 and len(questions) > 0"""
)
def decision_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of every engagement with their questions."""
    f = _frames(spark, sf_dir)
    s = record.streams(record.architecture(f, "k").select("k", "themes").join(f.select("k", "questions"), "k"), "k")
    return s.select("k", "place", "title", F.array_join("questions", "|").alias("questions"), F.size("questions").cast("long").alias("n"))


_SUMMARIES = ('{"a": 1}', "[1]", "[]", "", "3")
_OBJECTS = f"(select p_partkey k, 'R' || p_partkey research_id, case when p_partkey % 6 > 0 then p_name end question, case when p_partkey % 5 > 0 then p_brand else '' end profile, ['running', 'completed', 'failed', 'paused', '', null][p_partkey % 6 + 1] status, '2024-01-01' created_at, [{', '.join(map(K.quoted, _SUMMARIES))}][p_partkey % 5 + 1] summary from part)"


@query(
    " union all ".join(f"select k, 'missing' problem, '{c}' field_ from {_OBJECTS} where coalesce({c}, '') = ''" for c in L.OBJECT_FIELDS)
    + f" union all select k, 'invalid state', 'status' from {_OBJECTS} where coalesce(status, '') not in ('running', 'completed', 'failed') union all select k, 'not an object', 'summary' from {_OBJECTS} where summary in ('[1]', '3')"
)
def object_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    o = K.table(spark, sf_dir, "part").select(
        k.alias("k"), F.concat(F.lit("R"), k.cast("string")).alias("research_id"), F.when(k % 6 > 0, F.col("p_name")).alias("question"), F.when(k % 5 > 0, F.col("p_brand")).otherwise("").alias("profile"),
        F.get(F.array(*map(F.lit, ("running", "completed", "failed", "paused", "", None))), (k % 6).cast("int")).alias("status"), F.lit("2024-01-01").alias("created_at"),
        F.get(F.array(*map(F.lit, _SUMMARIES)), (k % 5).cast("int")).alias("summary"),
    )
    return record.object_problems(o, "k").withColumnRenamed("field", "field_")


@query(
    """select 'contradiction' as "type", 'C' || lpad(s_suppkey::varchar, 6, '0') contradiction_id, coalesce(v, 'unknown') severity, coalesce(t, '') topic, 'Contradiction detected: C' || lpad(s_suppkey::varchar, 6, '0') || ' [' || coalesce(v, '?') || '] topic=' || coalesce(t, '?') message
    from (select s_suppkey, case when s_suppkey % 4 > 0 then ['LOW', 'MEDIUM', 'HIGH'][s_suppkey % 3 + 1] end v, case when s_suppkey % 5 > 0 then n_name end t from supplier join nation on n_nationkey = s_nationkey)"""
)
def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = K.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = K.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    severity = F.when(k % 4 > 0, F.get(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), (k % 3).cast("int")))
    return record.review_issues(s.select(F.concat(F.lit("C"), F.lpad(k.cast("string"), 6, "0")).alias("contradiction_id"), severity.alias("severity"), F.when(k % 5 > 0, F.col("n_name")).alias("topic")))


_HELD = {"evidence_ids": (3, "E"), "hypothesis_ids": (4, "H"), "challenge_ids": (5, "X")}


@query(
    "select p_partkey k, "
    + ", ".join(f"case when p_partkey % {m} > 0 then '{p}' || p_size || '|{p}' || p_partkey else '' end {c}" for c, (m, p) in _HELD.items())
    + ", p_partkey % 60 > 0 traced from part"
)
def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lists = [F.when(k % m > 0, F.array(*[F.concat(F.lit(p), F.col(x).cast("string")) for x in ("p_size", "p_partkey")])).alias(c) for c, (m, p) in _HELD.items()]
    t = record.traceability(K.table(spark, sf_dir, "part").select(k.alias("k"), *lists), "k")
    return t.select("k", *[F.array_join(c, "|").alias(c) for c in _HELD], "traced")


@query(
    """with k as (select o_custkey run, o_orderpriority kind, count(*) n, min(o_orderkey) first_ from orders group by all)
    select run, sum(n)::bigint n, arg_min(kind, first_) primary_kind, string_agg(kind || '=' || n, '|' order by kind) kinds from k group by run"""
)
def target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by kind; customers stand for runs, their orders for targets."""
    o = K.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", F.col("o_orderpriority").alias("kind"))
    t = record.target_counts(o, "run", "o_orderkey")
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return t.select("run", F.col("count").alias("n"), "primary_kind", kinds.alias("kinds"))


@query("select doc_id, coalesce(score, 0)::double keyword_score from documents left join (select doc_id, quality * 0.5 score from labels) using (doc_id)")
def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = K.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 0.5).alias("keyword_score"))
    return record.chunk_scores(K.table(spark, sf_dir, "documents"), scores, "doc_id")


@query(f"select * replace (round(overall - 0.1, 6) as overall, round(coverage - 0.1, 6) as coverage) from ({ORACLES['benchmark_summary']})")
def injected_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.perturbed(benchmark_summary(spark, sf_dir), {"overall": -0.1, "coverage": -0.1})
