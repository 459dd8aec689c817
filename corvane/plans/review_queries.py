"""Queries that plan, review and report: query plans, memo rules, validators, profile and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.operators import classify, decide, evaluate, evidence, link, planner, score, select
from corvane.plans import carriers as K
from corvane.plans.catalog import ORACLES, query
from corvane.plans.document_queries import _QUESTIONS
from corvane.plans.report_queries import _MEMO, _memos
from corvane.sources.scratch import bounded_broadcast

_ASKED_SQL = f"(select n_nationkey id, replace([{', '.join(map(K.quoted, _QUESTIONS))}][n_nationkey % {len(_QUESTIONS)} + 1], '{{x}}', n_name) q from nation)"


def _first_spelling(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position(list_transform({x}, lambda y: lower(y)), lower(x)) = i)"


_LOCKED = " ".join(f"when m = {K.quoted(n)} then [{', '.join('e || ' + K.quoted(q.removeprefix('{e}')) for q in qs[:2])}]" for n, qs in L.METRIC_ANCHORS.items())
_NAMED = ", ".join(f"case when contains(replace(lower(q), ' ', ''), {K.quoted(t.replace(' ', ''))}) or {K.sql_any('q', t.split())} then {K.quoted(t)} end" for t in L.TOPIC_EXPANSIONS)
_EXPANDED = " ".join(f"when {K.quoted(t)} then [{', '.join(map(K.quoted, qs))}]" for t, qs in L.TOPIC_EXPANSIONS.items())
_LEAST = "case mode_ " + " ".join(f"when {K.quoted(m)} then {v[0]}" for m, v in L.MODE_QUERIES.items()) + " end"
_MOST = "case mode_ " + " ".join(f"when {K.quoted(m)} then {v[1]}" for m, v in L.MODE_QUERIES.items()) + " end"
_PLAN_SQL = f"""with a as (select a.id, a.q, p.mode_, p.entity_lock e, p.metric_lock m, list_filter(regexp_extract_all(lower(a.q), '[a-z][a-z0-9-]{{1,}}'), lambda w: w not in ({', '.join(map(K.quoted, L.QUERY_STOP))})) w,
      list_filter([{_NAMED}], lambda x: x is not null) topics from {_ASKED_SQL} a join ({ORACLES["question_plans"]}) p on a.id = p.id),
    b as (select *, list_concat([trim(q)], case when mode_ = 'FACT_LOOKUP' then case when e is not null and m is not null then case {_LOCKED} end
        when e is not null then list_concat(case when len(w) > 0 then [e || ' ' || array_to_string(w[1:4], ' ')] else [] end, [e || {K.quoted(L.GENERIC_ANCHORS[0].removeprefix('{e}'))}])
        when len(w) >= 2 then [array_to_string(w[1:6], ' ')] else [] end
      else list_concat(case when len(w) >= 2 then [array_to_string(w[1:6], ' ')] else [] end, flatten(list_transform(topics, lambda t: case t {_EXPANDED} end))) end) l,
      flatten(list_transform(range(1, len(w)), lambda i: list_transform(range(i + 1, least(i + 4, len(w) + 1)), lambda j: w[i] || ' ' || w[j])))[1:4] f from a),
    c as (select *, {_first_spelling("l")} l1 from b), d as (select *, list_concat(l1, f) l2 from c), g as (select *, {_first_spelling("l2")} l3 from d)
    select id, mode_, case when mode_ = 'FACT_LOOKUP' then e end entity_lock, case when mode_ = 'FACT_LOOKUP' then m end metric_lock, topics, (case when len(l1) < ({_LEAST}) then l3[1:({_LEAST})] else l1 end)[1:({_MOST})] queries from g"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.replace(F.get(F.array(*map(F.lit, _QUESTIONS)), F.col("n_nationkey") % len(_QUESTIONS)), F.lit("{x}"), F.col("n_name"))
    return K.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), q.alias("question"))


@query(f"select id, mode_, entity_lock, metric_lock, array_to_string(topics, '|') topics, array_to_string(queries, '|') queries from ({_PLAN_SQL})")
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planner.plans(_questions(spark, sf_dir), "id")
    return p.select("id", F.col("mode").alias("mode_"), "entity_lock", "metric_lock", F.array_join("topics", "|").alias("topics"), F.array_join("queries", "|").alias("queries"))


@query(
    f"""with p as (select id, unnest(range(0, len(queries))) query_ord, unnest(queries) query from ({_PLAN_SQL})), t as (select *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) w from p),
    c as (select id k, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')) w from {K.CLAIMS_SQL}),
    s as (select t.id * 100 + query_ord q, c.k, len(list_intersect(t.w, c.w)) s from t, c where len(list_intersect(t.w, c.w)) > 0),
    r as (select *, row_number() over (partition by q order by s desc, k) rank from s), f as (select *, row_number() over (partition by k order by q) n from r where rank <= 10)
    select q, rank, k, s from f where n = 1 order by q, rank limit 30"""
)
def expanded_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best claims of every query of the questions, ten each, the first query that finds one keeps it."""
    rows = planner.query_rows(planner.plans(_questions(spark, sf_dir), "id"), "id")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    q = rows.select((F.col("id") * 100 + F.col("query_ord")).cast("long").alias("q"), F.explode(words("query")).alias("t"))
    c = K.claims(spark, sf_dir).select(F.col("id").alias("k"), F.explode(words("claim")).alias("t"))
    s = c.join(bounded_broadcast(q), "t").groupBy("q", "k").agg(F.count("*").alias("s"))
    return select.expanded(s, "q", [F.desc("s"), F.asc("k")], "k", 10, 30).select("q", "rank", "k", "s")


_SECTIONS = tuple(L.TOPIC_SECTIONS.values())
_FACTS = ("[]::varchar[]", "['plain']", "['x [Source: a.pdf, Evidence: E001]']", "['y [Source: b, Evidence: E009] [Source: c, Evidence: E001]']")
_CITED = lambda c: f"flatten(list_transform({c}, lambda f: regexp_extract_all(f, {K.quoted(L.CITATION)}, 1)))"
_RULES = [
    ("mock_llm", "k % 9 = 0"), ("no_sources", "documents = 0"), ("zero_documents_loaded", "documents = 0"), ("few_documents_loaded", "documents < 3"), ("empty_document_text", "empty_documents > 0"),
    ("missing_executive_summary", "trim(summary) = ''"), ("missing_confirmed_facts", "len(facts) = 0"), ("no_evidence", "items = 0"), ("low_evidence_count", "items < 10"),
    ("low_high_quality_evidence_count", "good_items < 10"), ("zero_chunks_for_document", "k % 5 = 0"), ("zero_evidence_for_chunk", "k % 7 = 0"), ("insufficient_source_evidence", "sources < 3"), ("empty_evidence_snippet", "empty_snippets > 0"),
    ("missing_confirmed_fact_citations", f"len(facts) > 0 and len({_CITED('facts')}) = 0"), ("unknown_evidence_citation", "len(list_filter(cited, lambda c: not list_contains(['E001', 'E002'], c))) > 0"),
    ("retrieval_metrics", "k % 2 > 0"), ("coverage_matrix_metrics", "areas > 0"), ("research_gap_metrics", "gaps > 0"), ("high_severity_contradiction", "k % 8 = 0"),
]
for _topic, _section in L.TOPIC_SECTIONS.items():
    _on = K.sql_any("question", dict(L.QUESTION_TOPICS)[_topic])
    _RULES += [(f"missing_{_section}", f"{_on} and len({_section}) = 0"), (f"missing_{_section.removesuffix('_implications')}_citations", f"{_on} and len({_section}) > 0 and len({_CITED(_section)}) = 0")]
_FACTS_OF = lambda i: f"case (k + {i}) % 4 " + " ".join(f"when {n} then {x}" for n, x in enumerate(_FACTS)) + " end"


@query(
    f"""with m as (select m.k, areas, gaps, areas % 4 documents, gaps % 2 empty_documents, case when m.k % 6 = 0 then ' ' else 'said' end summary, items, good_items, covered sources, m.k % 2 empty_snippets, q question,
      {", ".join(f"{_FACTS_OF(i).replace('(k +', '(m.k +')} {name}" for i, name in enumerate(("facts", *_SECTIONS)))} from {_MEMO} m join {_ASKED_SQL} q on q.id = m.k % 25),
    c as (select *, list_distinct(list_concat({_CITED("facts")}, {", ".join(_CITED(s) for s in _SECTIONS)})) cited from m)
    {" union all ".join(f"select k, {K.quoted(code)} code from c where {rule}" for code, rule in _RULES)}"""
)
def memo_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    facts = [F.array().cast("array<string>"), F.array(F.lit("plain")), F.array(F.lit("x [Source: a.pdf, Evidence: E001]")), F.array(F.lit("y [Source: b, Evidence: E009] [Source: c, Evidence: E001]"))]

    def listed(i: int) -> Column:
        n = (k + i) % 4
        return F.when(n == 0, facts[0]).when(n == 1, facts[1]).when(n == 2, facts[2]).otherwise(facts[3])

    m = _memos(spark, sf_dir).join(bounded_broadcast(_questions(spark, sf_dir)), k % 25 == F.col("id"))
    m = m.select(
        "k", "question", (k % 9 == 0).alias("mock"), (F.col("areas") % 4).alias("documents"), (F.col("gaps") % 2).alias("empty_documents"), (k % 5 == 0).cast("int").alias("zero_chunk_documents"), (k % 7 == 0).cast("int").alias("zero_evidence_chunks"),
        F.when(k % 6 == 0, " ").otherwise("said").alias("summary"), "items", "good_items", F.col("covered").alias("sources"), (k % 2).alias("empty_snippets"), (k % 2).alias("chunks"), (k % 8 == 0).cast("int").alias("high_conflicts"), "areas", "gaps",
        F.array(F.lit("E001"), F.lit("E002")).alias("known"), *[listed(i).alias(name) for i, name in enumerate(("facts", *_SECTIONS))],
    )
    return decide.memo_warnings(m, "k")


_SUPPORT = "(select n_nationkey k, count(c_custkey) filter (where c_custkey % 40 = n_nationkey % 40) n from nation left join customer on c_nationkey = n_nationkey group by 1)"


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = K.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    c = K.table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 40 == F.col("c_nationkey") % 40).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return n.join(c, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"select k, n, case when n >= 4 then 'STRONG' when n >= 2 then 'MODERATE' when n >= 1 then 'WEAK' else 'NONE' end level_ from {_SUPPORT}")
def support_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of questions by the pieces of evidence that each has."""
    return _support(spark, sf_dir).select("k", "n", evaluate.support_level(F.col("n")).alias("level_"))


@query(
    f"""select k, 'coverage' as type, case when n = 0 then 'HIGH' else 'MEDIUM' end severity from {_SUPPORT} where n < 2 union all select k, 'evidence_sufficiency', case when n = 0 then 'HIGH' else 'MEDIUM' end from {_SUPPORT} where n < 2"""
)
def support_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.support_issues(_support(spark, sf_dir), "k")


_INFLUENCE_SQL = """(with p as (select r_name profile from region), s as (select s_suppkey, r_name profile from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where s_acctbal > 0),
    o as (select l_orderkey k, list_distinct(list(profile)) ps, bool_or(l_quantity > 45) f, bool_or(l_discount > 0.08) r from lineitem join s on s_suppkey = l_suppkey group by 1),
    e as (select profile, count(*) n from s group by 1), f as (select unnest(ps) profile from o where f), r as (select unnest(ps) profile from o where r)
    select p.profile, coalesce(e.n, 0)::bigint evidence, (select count(*) from f where f.profile = p.profile) findings, (select count(*) from r where r.profile = p.profile) recommendations from p left join e on p.profile = e.profile)"""


def _influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = K.table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("profile"))
    nation = K.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    s = K.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey")).select("s_suppkey", "profile")
    o = K.table(spark, sf_dir, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_orderkey")
    o = o.agg(F.collect_set("profile").alias("profiles"), F.bool_or(F.col("l_quantity") > 45).alias("f"), F.bool_or(F.col("l_discount") > 0.08).alias("r"))
    return evaluate.profile_influence(region.select("profile"), s.select("profile"), o.filter("f"), o.filter("r"))


@query(f"select *, round(case when sum(recommendations) over () > 0 then recommendations / (sum(recommendations) over ())::double else 1.0 / count(*) over () end, 3) balance from {_INFLUENCE_SQL}")
def profile_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _influence(spark, sf_dir)


@query(f"select count(*) profiles_requested, count(*) filter (where evidence > 0) profiles_contributing, count(*) filter (where findings > 0) profiles_represented_in_findings, count(*) filter (where recommendations > 0) profiles_represented_in_recommendations from {_INFLUENCE_SQL}")
def synthesis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.synthesis_counts(_influence(spark, sf_dir))


@query(
    """with c as (select n_name profile, n_nationkey % 3 retrieved, case when n_nationkey % 2 = 0 then 0 else n_nationkey end attributed from nation)
    select profile, 'missing' status, case when retrieved = 0 then 'no evidence retrieved' else 'evidence retrieved but keyword overlap insufficient for attribution' end reason from c where attributed = 0"""
)
def missing_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return evaluate.missing_profiles(K.table(spark, sf_dir, "nation").select(F.col("n_name").alias("profile"), (n % 3).alias("retrieved"), F.when(n % 2 == 0, 0).otherwise(n).alias("attributed")))


@query(
    """with l as (select n_regionkey k, ['strong', 'moderate', 'weak', 'none'][n_nationkey % 4 + 1] lv from nation)
    select k, round(avg(case lv when 'strong' then 1.0 when 'moderate' then 0.6 when 'weak' then 0.2 else 0.0 end), 4)::double coverage_score, count(*) topics from l group by k"""
)
def coverage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = F.get(F.array(*map(F.lit, ("strong", "moderate", "weak", "none"))), F.col("n_nationkey") % 4)
    return evaluate.coverage_score(K.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), lv.alias("level")), "k")


@query(
    f"""with t as (select id, list_filter([{", ".join(f"case when {K.sql_any('claim', t)} then {K.quoted(n)} end" for n, t in L.TOPICS)}], lambda x: x is not null) t from {K.CLAIMS_SQL})
    select topic, count(*) n from (select unnest(t) topic from t) group by topic"""
)
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by topic."""
    return K.claims(spark, sf_dir).select(F.explode(classify.topics(F.col("claim"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query("""with l as (select n_regionkey k, list(n_name order by n_nationkey) a from nation where n_nationkey % 3 > 0 group by 1) select k, array_to_string(a[1:3], ', ') || case when len(a) > 3 then '…' else '' end labels from l""")
def gap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = K.table(spark, sf_dir, "nation").filter("n_nationkey % 3 > 0").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    return n.select("k", evaluate.gap_labels(F.transform("l", lambda x: x["n_name"])).alias("labels"))


@query(
    """with o as (select l_orderkey k, count(distinct l_partkey) a, count(distinct l_suppkey) filter (where l_returnflag = 'R') b from lineitem group by 1)
    select count(*) option_count, round(avg(a), 2) average_assumptions_per_option, round(avg(b), 2) average_risks_per_option from o"""
)
def option_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = K.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("assumptions"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("risks"))
    return evaluate.option_averages(o, ("assumptions", "risks"))


_STAGES = "(select event_id, user_id, event_type, ts, value, event_id % 50 prompt, event_id % 7 completion, event_id % 11 <> 0 success, case when event_id % 13 = 0 then 'failed' end error from events)"


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return K.table(spark, sf_dir, "events").withColumns({"prompt": i % 50, "completion": i % 7, "success": i % 11 != 0, "error": F.when(i % 13 == 0, "failed")})


@query(
    f"""select round(sum(event_id % 100 + 0.5), 1)::double pipeline_wall_ms, round(sum(event_id % 60), 1)::double llm_total_ms, round(sum(event_id % 100 + 0.5) - sum(event_id % 60), 1)::double llm_overhead_ms, sum(event_id % 3)::bigint llm_call_count,
    sum(prompt)::bigint prompt_tokens, sum(completion)::bigint completion_tokens, sum(prompt + completion)::bigint total_tokens from {_STAGES}"""
)
def performance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    r = _stages(spark, sf_dir).select((i % 100 + 0.5).cast("double").alias("wall_ms"), (i % 60).cast("double").alias("llm_ms"), (i % 3).alias("calls"), F.col("prompt").alias("prompt_tokens"), F.col("completion").alias("completion_tokens"))
    return evaluate.performance_totals(r)


@query(
    f"""select user_id, arg_max(event_type, event_id) model_name, arg_min(ts, event_id)::varchar request_timestamp, bool_and(success) response_success, count(error) errors, 'completion=' || sum(completion)::bigint || ',prompt=' || sum(prompt)::bigint usage from {_STAGES} group by user_id"""
)
def trace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every user: what they used, whether all succeeded."""
    t = _stages(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("model"), "ts", "success", "error", F.create_map(F.lit("prompt"), F.col("prompt"), F.lit("completion"), F.col("completion")).alias("usage"))
    s = evaluate.trace_summary(t, "user_id", "event_id")
    used = F.array_join(F.transform("usage", lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), ",")
    return s.select("user_id", "model_name", F.col("request_timestamp").cast("string").alias("request_timestamp"), "response_success", "errors", used.alias("usage"))


@query("select count(*) n, round(avg(value), 2) mean, round(min(value), 2) least, round(max(value), 2) most, round(sum(value), 2) total from events")
def time_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.time_summary(K.table(spark, sf_dir, "events"), "value")


@query(
    """with b as (select doc_id, quality s from labels where toxic = 0), a as (select doc_id, (quality + length(doc_id::varchar) % 2) / 2.0 s from labels)
    select count(*) n, round(avg(b.s), 4) before_, round(avg(a.s), 4) after_, round(avg(a.s) - avg(b.s), 4) delta, count(*) filter (where a.s > b.s) improved from b join a on a.doc_id = b.doc_id"""
)
def improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = K.table(spark, sf_dir, "labels")
    after = lab.select("doc_id", ((F.col("quality") + F.length(F.col("doc_id").cast("string")) % 2) / 2.0).alias("s"))
    return evaluate.improvement(lab.filter("toxic = 0").select("doc_id", F.col("quality").alias("s")), after, "doc_id", "s")


@query(
    f"""select (select count(*) filter (where status = 'fail') from ({ORACLES["regression_metrics"]})) failed_metrics, (select count(*) filter (where status = 'improved') from ({ORACLES["regression_metrics"]})) improved_metrics,
    (select count(*) filter (where status = 'regressed') from ({ORACLES["regression_items"]})) regressed_items, (select count(*) filter (where status = 'improved') from ({ORACLES["regression_items"]})) improved_items,
    case when (select count(*) filter (where status = 'fail') from ({ORACLES["regression_metrics"]})) > 0 then 'fail' else 'pass' end verdict"""
)
def regression_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.plans.retrieval_queries import regression_items, regression_metrics

    return evaluate.regression_verdict(regression_metrics(spark, sf_dir), regression_items(spark, sf_dir))


@query(
    """with q as (select l_orderkey k, count(*) total, count(*) filter (where l_discount > 0.05) hits, list(distinct l_returnflag order by l_returnflag) filter (where l_returnflag in ('A', 'R') and l_tax > 0.07) bad from lineitem group by 1),
    p as (select k, hits / total::double c, hits, total, coalesce(bad, []) bad from q)
    select k, array_to_string(list_concat(case when c < 0.5 then ['low fact coverage: ' || hits || '/' || total] else [] end, list_transform(bad, lambda t: 'prohibited term found: ' || t)), '; ') reasons from p"""
)
def qa_fail_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.array_sort(F.collect_set(F.when(F.col("l_returnflag").isin("A", "R") & (F.col("l_tax") > 0.07), F.col("l_returnflag"))))
    q = K.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("total"), F.count_if(F.col("l_discount") > 0.05).alias("hits"), bad.alias("bad"))
    return q.select("k", F.array_join(evaluate.fail_reasons(F.col("hits") / F.col("total"), F.col("hits"), F.col("total"), F.col("bad")), "; ").alias("reasons"))


@query(
    """with o as (select o_custkey % 20 k, o_orderkey % 50 v, o_orderstatus s, o_orderpriority p from orders), a as (select k, list_sort(list_distinct(list(v))) a from o where s = 'F' group by 1), b as (select k, list_sort(list_distinct(list(v))) b from o where p = '1-URGENT' group by 1),
    j as (select coalesce(a.k, b.k) k, coalesce(a, []) a, coalesce(b, []) b from a full join b on a.k = b.k)
    select k, round(case when len(a) = 0 and len(b) = 0 then 1.0 else len(list_filter(a, lambda x: list_contains(b, x))) / len(list_distinct(list_concat(a, b)))::double end, 3) jaccard, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') shared,
    array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') only_a, array_to_string(list_filter(b, lambda x: not list_contains(a, x)), ',') only_b from j"""
)
def overlap_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = K.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("k"), (F.col("o_orderkey") % 50).alias("v"), "o_orderstatus", "o_orderpriority")
    a = o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.collect_set("v").alias("a"))
    b = o.filter("o_orderpriority = '1-URGENT'").groupBy("k").agg(F.collect_set("v").alias("b"))
    none = F.array().cast("array<bigint>")
    j = a.join(b, "k", "full_outer").select("k", link.overlap_report(F.coalesce("a", none), F.coalesce("b", none)).alias("r"))
    said = lambda c: F.array_join(F.transform(f"r.{c}", lambda x: x.cast("string")), ",").alias(c)
    return j.select("k", "r.jaccard", said("shared"), said("only_a"), said("only_b"))


@query(
    """with r as (select o_orderkey k, list(l_suppkey order by l_linenumber, l_suppkey)[1] e from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 30 group by 1)
    select k, n_name source_id, r_name uri from r left join supplier on s_suppkey = e left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey and r_name <> 'ASIA'"""
)
def result_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the source of their first supporting evidence."""
    li = K.table(spark, sf_dir, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    r = K.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(li, "k", "left").select("k", F.transform("l", lambda x: x["l_suppkey"]).alias("ids"))
    nation = K.table(spark, sf_dir, "nation")
    evidence = K.table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("evidence_id"), F.col("n_name").alias("source_id"))
    manifest = nation.join(K.table(spark, sf_dir, "region").filter("r_name <> 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("source_id"), F.col("r_name").alias("uri"))
    return link.result_sources(r, "k", "ids", evidence, manifest)


_MD = "'# ' || r_name || chr(10) || 'intro' || chr(10) || '## Facts' || chr(10) || '- one ' || r_name || chr(10) || '* two' || chr(10) || '## Gaps' || chr(10) || 'text'"


@query(
    rf"""with l as (select r_regionkey, unnest(a) line, generate_subscripts(a, 1) pos from (select r_regionkey, string_split({_MD}, chr(10)) a from region)),
    h as (select *, last_value(case when regexp_matches(line, '^#+ ') then regexp_replace(line, '^#+ ', '') end ignore nulls) over (partition by r_regionkey order by pos) section from l)
    select r_regionkey, (pos - 1)::int pos, section, regexp_replace(line, '^[-*] ', '') item, regexp_matches(line, '^[-*] ') bullet from h where not regexp_matches(line, '^#+ ')"""
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), "r_name", F.lit("\nintro\n## Facts\n- one "), "r_name", F.lit("\n* two\n## Gaps\ntext"))
    return decide.markdown_sections(K.table(spark, sf_dir, "region").select("r_regionkey", text.alias("t")), "r_regionkey", "t")


@query(
    f"""with p as (select p_partkey id, case p_partkey % 5 when 0 then 'Adobe InDesign' when 1 then '  ' when 2 then ' Jane   Roe ' when 3 then null else 'Microsoft Word' end a, case p_partkey % 4 when 0 then 'ACME' end o, case p_partkey % 3 when 0 then p_name end pb from part),
    q as (select id, {K.sql_any("a", decide.SKIP_AUTHORS)} skipped, nullif(trim(regexp_replace(coalesce(a, ''), '\\s+', ' ', 'g')), '') author, o, pb from p)
    select id, coalesce(skipped, false) skipped, case when not coalesce(skipped, false) then author end author, (case when not coalesce(skipped, false) then author end) is null and o is null and pb is null needs_more from q"""
)
def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors without placeholders, and whether the provenance still needs another tier."""
    i = F.col("p_partkey")
    a = F.when(i % 5 == 0, "Adobe InDesign").when(i % 5 == 1, "  ").when(i % 5 == 2, " Jane   Roe ").when(i % 5 == 4, "Microsoft Word")
    p = K.table(spark, sf_dir, "part").select(i.alias("id"), a.alias("a"), F.when(i % 4 == 0, "ACME").alias("o"), F.when(i % 3 == 0, F.col("p_name")).alias("pb"))
    p = p.withColumn("skipped", decide.skipped_author(F.col("a")))
    p = p.withColumn("author", F.when(~F.col("skipped"), decide.cleaned(F.col("a"))))
    return p.select("id", "skipped", "author", decide.needs_more(F.col("author"), F.col("o"), F.col("pb")).alias("needs_more"))


@query(
    f"""select id, array_to_string(case research_type {" ".join(f"when {K.quoted(k)} then [{', '.join(K.quoted(x.removesuffix('{q}')) + ' || q' if x.endswith('{q}') else K.quoted(x) for x in xs)}]" for k, xs in L.SUBQUESTIONS.items())} end, '|') subquestions
    from (select id, q, {K.sql_first_pattern("lower(q)", decide.RESEARCH_TYPES, "RESEARCH")} research_type from {_ASKED_SQL})"""
)
def subquestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("id", F.array_join(decide.subquestions(F.col("question")), "|").alias("subquestions"))


_INFERRED = f"(select brand k, list(claim order by id) a from {K.CLAIMS_SQL} where id % 9 < 2 group by brand)"
_PROXY = {
    "evidence": f"regexp_matches(x, {K.quoted(L.PROXY_EVIDENCE)})",
    "reasoning": f"regexp_matches(x, {K.quoted(L.PROXY_LOGIC)})",
    "tradeoff": K.sql_any("x", decide.TRADEOFF_WORDS),
    "risk": f"regexp_matches(x, {K.quoted(L.PROXY_RISK)})",
    "actionability": f"length(x) >= 60 and {K.sql_any('x', decide.ACTION_VERBS)}",
}


@query(
    f"""with d as (select k, {", ".join(f"round(least(1.0, 0.40 + len(list_filter(a, lambda x: {hit})) / len(a)::double * 0.60 + least(0.30, len(a) / 4.0 * 0.30)), 3) {name}" for name, hit in _PROXY.items())} from {_INFERRED})
    select *, round({" + ".join(f"{w} * {n}" for n, _, w in score.DIMENSIONS)}, 3)::double total from d"""
)
def inference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the claims of a brand, taken as a memo's inferences."""
    c = K.claims(spark, sf_dir).filter("id % 9 < 2").groupBy(F.col("brand").alias("k")).agg(F.array_sort(F.collect_list(F.struct("id", "claim"))).alias("l"))
    c = c.select("k", F.transform("l", lambda x: x["claim"]).alias("a"))
    c = c.select("k", *[v.alias(n) for n, v in score.inference_dimensions(F.col("a"), decide.ACTION_VERBS, decide.TRADEOFF_WORDS).items()])
    return c.withColumn("total", score.recommendation_score({n: F.col(n) for n, _, _ in score.DIMENSIONS})[0])


@query(
    f"""with c as (select id, claim, brand, case when id % 4 > 0 then 'E' || lpad(id::varchar, 6, '0') else '' end e, case when {K.sql_any("claim", ("cooling", "thermal"))} then 'cooling' when {K.sql_any("claim", ("power", "kw"))} then 'power' end section from {K.CLAIMS_SQL}),
    r as (select *, row_number() over (partition by section order by id) place from c where section is not null)
    select section, place, claim || ' [Source: ' || brand || ', Evidence: ' || coalesce(nullif(e, ''), 'unknown') || ']' as text_ from r where place <= 3"""
)
def implications(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("claim")
    e = K.claims(spark, sf_dir).select("id", "claim", F.col("brand").alias("source"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("E"), F.lpad(F.col("id").cast("string"), 6, "0"))).otherwise("").alias("evidence_id"))
    group = F.when(R.any_term(c, ("cooling", "thermal")), "cooling").when(R.any_term(c, ("power", "kw")), "power")
    return evidence.implications(e, group, ["id"]).withColumnRenamed("text", "text_")


@query(
    """with c as (select doc_id, count(*) n from documents group by 1), s as (select distinct doc_id from labels where quality = 1)
    select count(*) candidate_count, count(s.doc_id) selected_count, count(*) - count(s.doc_id) discarded_count from documents d left join s on d.doc_id = s.doc_id"""
)
def ranking_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.ranking_counts(K.table(spark, sf_dir, "documents"), K.table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")


@query(
    """with c as (select n_nationkey doc_id, count(s_suppkey) chunks, count(s_suppkey) filter (where s_acctbal > 0) sel from nation left join supplier on s_nationkey = n_nationkey group by 1),
    e as (select c_nationkey doc_id, count(*) n, max(c_acctbal) b from customer where c_custkey % 7 = 0 group by 1)
    select c.doc_id, chunks, sel chunks_selected, coalesce(n, 0) evidence, b best_score, row_number() over (order by coalesce(n, 0) desc, c.doc_id) rank from c left join e on c.doc_id = e.doc_id"""
)
def run_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rank of every document of a run; nations stand for documents."""
    n = K.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"))
    c = K.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), (F.col("s_acctbal") > 0).alias("selected"))
    e = K.table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("doc_id"), F.col("c_acctbal").alias("overall_score"))
    return evidence.run_trace(n, c, e)


@query(f"select reason, count(*) n from ({ORACLES['prohibited_terms']}) group by reason")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.plans.claim_queries import prohibited_terms

    return evidence.reason_histogram(prohibited_terms(spark, sf_dir))


_REGISTRY = (("power draw", ("consumption", "kW"), 1), ("rack", ("cabinet", "KW"), 2), ("cooling", (), 3))


@query(
    f"""with r(canonical, synonyms, entry) as (values {", ".join(f"({K.quoted(c)}, [{', '.join(map(K.quoted, s))}]::varchar[], {e})" for c, s, e in _REGISTRY)}), f as (select canonical, entry, lower(unnest(list_concat([canonical], synonyms))) t from r),
    m as (select t, min(canonical) canonical, arg_min(entry, canonical) entry from f group by t), x as (select p_partkey id, [' kw ', 'Cabinet', 'POWER draw', 'nothing', 'cooling'][p_partkey % 5 + 1] term from part)
    select term, canonical, entry, count(*) n from x left join m on lower(trim(term)) = t group by all"""
)
def synonym_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([(c, list(s), e) for c, s, e in _REGISTRY], "canonical string, synonyms array<string>, entry int")
    term = F.get(F.array(*map(F.lit, (" kw ", "Cabinet", "POWER draw", "nothing", "cooling"))), (F.col("p_partkey") % 5).cast("int"))
    found = evidence.synonyms(K.table(spark, sf_dir, "part").select(term.alias("term")), registry)
    return found.groupBy("term", "canonical", "entry").agg(F.count("*").alias("n"))


@query(f"select doc_id, score from ({ORACLES['merged_query_chunks']}) order by score desc, doc_id limit 20")
def capped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of what several queries selected."""
    from corvane.plans.document_queries import merged_query_chunks

    return select.capped_selection(merged_query_chunks(spark, sf_dir), "score", "doc_id", 20).select("doc_id", "score")


@query(
    f"""select id, {K.sql_hits("claim || ' ' || t", ("power", "kw", "rack"))} hits, (1 + id % 5) / 5.0::double priority from (select id, claim, array_to_string(list_filter([{", ".join(f"case when {K.sql_any('claim', t)} then {K.quoted(n)} end" for n, t in L.TOPICS)}], lambda x: x is not null), ' ') t from {K.CLAIMS_SQL})
    order by hits desc, id limit 12"""
)
def profile_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that hold most of a profile's terms, with the priority of their documents."""
    c = K.claims(spark, sf_dir).withColumn("hits", score.profile_terms_score(F.col("claim"), classify.topics(F.col("claim")), ("power", "kw", "rack")))
    return c.orderBy(F.desc("hits"), "id").limit(12).select("id", "hits", score.document_priority(1 + F.col("id") % 5).alias("priority"))
