"""Validators over records drawn from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import validate
from corvane.plans import carriers as K
from corvane.plans.catalog import query

_QUESTION = """(select p_partkey k, case when p_partkey % 50 = 0 then 'dup' when p_partkey % 21 = 0 then ' ' else p_partkey::varchar end question_id, case p_partkey % 4 when 0 then 'chips' when 1 then 'power' when 2 then 'mars' end domain_, case when p_partkey % 9 = 0 then '' else p_name end question,
    case when p_partkey % 5 = 0 then [] when p_partkey % 5 = 1 then null else ['120 kW', lower(p_brand)] end must_include, case p_partkey % 6 when 0 then ['KW '] when 1 then ['120 kw', ' ', 'x'] when 2 then ['rack'] else [] end must_not_include,
    case p_partkey % 3 when 0 then ['a rack', 'Rack'] when 1 then [] end acceptable_alternatives from part)"""
_PAIRS = lambda terms, same: f"(select count(*) from (select unnest(must_not_include) p) a, (select unnest({terms}) r) b where trim(p) <> '' and contains(lower(trim(r)), lower(trim(p))){'' if same else ' and lower(trim(r)) <> lower(trim(p))'})"


@query(
    f"""with q as {_QUESTION}, d as (select question_id, unnest(['missing_required_field', 'unknown_domain', 'must_include_conflict', 'alternative_conflict', 'no_must_include', 'short_prohibited_term']) code, unnest(['error', 'warning', 'error', 'warning', 'warning', 'warning']) severity,
      unnest([(trim(question_id) = '')::int + (domain_ is null)::int + (trim(question) = '')::int, (coalesce(domain_, '') not in ('chips', 'power', 'unknown'))::int, {_PAIRS("must_include", True)}, {_PAIRS("acceptable_alternatives", False)},
        (coalesce(len(must_include), 0) = 0 and coalesce(len(acceptable_alternatives), 0) = 0)::int, len(list_filter(must_not_include, lambda p: length(trim(p)) <= 2))]::bigint[]) n from q)
    select question_id, code, severity, n from d where n > 0 union all select question_id, 'duplicate_question_id', 'error', count(*) - 1 from q group by 1 having count(*) > 1"""
)
def question_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of gold questions."""
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    lits = lambda *x: F.array(*map(F.lit, x))
    q = K.table(spark, sf_dir, "part").select(
        F.when(k % 50 == 0, "dup").when(k % 21 == 0, " ").otherwise(k.cast("string")).alias("question_id"), F.when(k % 4 == 0, "chips").when(k % 4 == 1, "power").when(k % 4 == 2, "mars").alias("domain"),
        F.when(k % 9 == 0, "").otherwise(F.col("p_name")).alias("question"), F.when(k % 5 == 0, none).when(k % 5 > 1, F.array(F.lit("120 kW"), F.lower("p_brand"))).alias("must_include"),
        F.when(k % 6 == 0, lits("KW ")).when(k % 6 == 1, lits("120 kw", " ", "x")).when(k % 6 == 2, lits("rack")).otherwise(none).alias("must_not_include"), F.when(k % 3 == 0, lits("a rack", "Rack")).when(k % 3 == 1, none).alias("acceptable_alternatives"),
    )
    return validate.question_defects(q, ("chips", "power"))


@query(
    """with c as (select case when s_suppkey % 30 = 0 then 'dup' else s_suppkey::varchar end contradiction_id, case s_suppkey % 4 when 0 then 'contradiction' when 1 then 'no_contradiction' when 2 then 'maybe' end expected_result, case when s_suppkey % 7 = 0 then ' ' else s_name end claim_a, s_name claim_b,
      s_suppkey % 3 = 0 fire, s_suppkey % 5 = 0 not_fire, case when s_suppkey % 2 = 0 then 'scope_mismatch' end reason, s_suppkey % 11 = 0 lim from supplier),
    d as (select contradiction_id, unnest(['missing_required_field', 'invalid_expected_result', 'conflicting_suppression_flags', 'missing_suppression_reason', 'contradiction_with_suppression', 'known_limitation']) code, unnest(['error', 'error', 'error', 'warning', 'error', 'warning']) severity,
      unnest([(expected_result is null)::int + (trim(claim_a) = '')::int, (coalesce(expected_result, '') not in ('contradiction', 'no_contradiction'))::int, (fire and not_fire)::int, (fire and reason is null)::int, (fire and coalesce(expected_result, '') = 'contradiction')::int, lim::int]::bigint[]) n from c)
    select contradiction_id, code, severity, n from d where n > 0 union all select contradiction_id, 'duplicate_contradiction_id', 'error', count(*) - 1 from c group by 1 having count(*) > 1"""
)
def case_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of contradiction cases."""
    k = F.col("s_suppkey")
    c = K.table(spark, sf_dir, "supplier").select(
        F.when(k % 30 == 0, "dup").otherwise(k.cast("string")).alias("contradiction_id"), F.when(k % 4 == 0, "contradiction").when(k % 4 == 1, "no_contradiction").when(k % 4 == 2, "maybe").alias("expected_result"), F.when(k % 7 == 0, " ").otherwise(F.col("s_name")).alias("claim_a"), F.col("s_name").alias("claim_b"),
        (k % 3 == 0).alias("suppression_should_fire"), (k % 5 == 0).alias("suppression_should_not_fire"), F.when(k % 2 == 0, "scope_mismatch").alias("expected_suppression_reason"), (k % 11 == 0).alias("known_limitation"),
    )
    return validate.case_defects(c)


#: records of a customer: his orders
_LISTED = lambda on: F.when(on, F.array(F.lit("E001"))).otherwise(F.array().cast("array<string>"))
_WORD = lambda c: F.when(c % 4 == 0, "high").when(c % 4 == 1, "medium").when(c % 4 == 2, "low").otherwise("sure")
_WORD_SQL = "case {x} % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'sure' end"
_VALID = "in ('high', 'medium', 'low')"


@query(
    f"""with h as (select o_custkey g, o_orderkey % 8 < 7 a, {_WORD_SQL.format(x="(o_orderkey // 8)")} {_VALID} b, o_orderkey % 16 > 0 c, o_orderkey % 32 < 31 d from orders), s as (select c_custkey g, count(h.g) n, coalesce(bool_and(a), false) a, coalesce(bool_and(b), false) b, coalesce(bool_and(c), false) c, coalesce(bool_and(d), false) d from customer left join h on h.g = c_custkey group by 1)
    select g, n > 0 present, n, a all_have_evidence_mapping, b all_have_confidence, c all_have_decision_implications, d all_have_disconfirming_evidence_needs, array_to_string(list_filter([case when n = 0 then 'no hypotheses' end, case when n > 0 and not a then 'a hypothesis is mapped to no evidence' end, case when n > 0 and not b then 'a hypothesis has no valid confidence' end,
      case when n > 0 and not c then 'a hypothesis has no implication for the decision' end, case when n > 0 and not d then 'a hypothesis names no evidence that would refute it' end, case when n between 1 and 2 then 'only ' || n || ' hypotheses, 3 are wanted' end], lambda x: x is not null), '; ') issues from s"""
)
def hypothesis_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    h = K.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.when(k % 8 < 7, _LISTED(k % 2 == 0)).alias("supporting_evidence"), F.lit(None).cast("array<string>").alias("contradicting_evidence"), F.lit(None).cast("array<string>").alias("evidence_gaps"),
        _WORD(F.floor(k / 8)).alias("confidence"), _LISTED(k % 16 > 0).alias("decision_implications"), _LISTED(k % 32 < 31).alias("disconfirming_evidence_needed"))
    groups = K.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("g"))
    return validate.hypotheses(h, "g", groups).withColumn("issues", F.array_join("issues", "; "))


@query(
    f"""with o as (select o_custkey g, o_orderkey k from orders), c as (select *, k % 8 < 7 a, k % 16 > 0 b, {_WORD_SQL.format(x="(k // 32)")} {_VALID} r from o where k % 5 > 0),
    s as (select g, count(*) n, bool_and(a) a, bool_and(b) b, bool_and(r) r from c group by 1), m as (select g, count(*) m from o where k % 5 = 0 group by 1), v as (select g, count(*) v, bool_and(k % 12 > 0) ok from o where k % 3 = 0 group by 1),
    j as (select x.g, coalesce(n, 0) n, coalesce(a, false) a, coalesce(b, false) b, coalesce(r, false) r, coalesce(m, 0) m, coalesce(v, 0) v, coalesce(ok, true) ok from (select distinct g from o) x left join s on x.g = s.g left join m on x.g = m.g left join v on x.g = v.g)
    select g, n > 0 present, n, a all_have_falsification_tests, b all_have_hidden_assumptions, r robustness_valid, m unchallenged, v surviving, ok survival_valid, array_to_string(list_filter([case when n = 0 then 'no challenges' end, case when n > 0 and not a then 'a challenge has no test that could refute' end, case when n > 0 and not b then 'a challenge names no hidden assumption' end,
      case when n > 0 and not r then 'a challenge has no valid robustness' end, case when n > 0 and m > 0 then m || ' hypotheses are not challenged' end, case when n > 0 and not ok then 'a surviving hypothesis has no valid status' end], lambda x: x is not null), '; ') issues from j"""
)
def challenge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("hypothesis_id")
    o = K.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("hypothesis_id"))
    c = o.filter(k % 5 > 0).select("g", "hypothesis_id", _LISTED(k % 8 < 7).alias("falsification_tests"), _LISTED(k % 16 > 0).alias("hidden_assumptions"), _WORD(F.floor(k / 32)).alias("robustness"))
    alive = o.filter(k % 3 == 0).select("g", F.when(k % 12 > 0, "strong").otherwise("dead").alias("survival_status"))
    return validate.challenges(c, alive, o, "g").withColumn("issues", F.array_join("issues", "; "))


_HORIZON = "case {x} % 7 when 0 then 'some_day' else 'near_term' end"


@query(
    f"""with r as (select o_custkey g, o_orderkey % 9 > 0 a, o_orderkey % 13 > 0 b, {_WORD_SQL.format(x="(o_orderkey // 4)")} {_VALID} c, o_orderkey % 7 > 0 d, {_WORD_SQL.format(x="(o_orderkey // 16)")} {_VALID} e from orders), s as (select g, count(*) n, bool_and(a) a, bool_and(b) b, bool_and(c) c, bool_and(d) d, bool_and(e) e, bool_or(d) p from r group by 1)
    select g, true present, n, a all_have_evidence, b all_have_hypothesis_links, c all_have_confidence, d all_have_time_horizon, e all_have_priority, p portfolio, array_to_string(list_filter([case when not a then 'a recommendation names no evidence' end, case when not b then 'a recommendation rests on no hypothesis' end, case when not c then 'a recommendation has no valid confidence' end,
      case when not d then 'a recommendation has no valid time horizon' end, case when not e then 'a recommendation has no valid priority' end, case when not p then 'the portfolio is empty' end], lambda x: x is not null), '; ') issues from s"""
)
def recommendation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = K.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), _LISTED(k % 9 > 0).alias("supporting_evidence"), _LISTED(k % 13 > 0).alias("supported_by_hypotheses"), _WORD(F.floor(k / 4)).alias("confidence"), F.when(k % 7 > 0, "near_term").otherwise("some_day").alias("time_horizon"), _WORD(F.floor(k / 16)).alias("priority"))
    return validate.recommendations(r, "g").withColumn("issues", F.array_join("issues", "; "))


@query(
    """select l_suppkey g, count(*) n, round(avg(l_discount), 3) mean_evidence, round(avg(l_tax), 3) mean_risk, round(avg(l_quantity), 3) average, round(min(l_quantity), 3) lowest, round(max(l_quantity), 3) highest from lineitem group by 1"""
)
def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios of scored recommendations: line items by supplier."""
    s = K.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_discount").alias("evidence"), F.col("l_tax").alias("risk"), F.col("l_quantity").alias("overall"))
    return validate.portfolio(s, "g", ("evidence", "risk"), "overall")


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'thin_support' else 'missing_evidence_links' end issue, o_totalprice score from orders where o_orderkey % 3 = 0 or o_orderkey % 4 = 0")
def portfolio_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = K.table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, "thin_support").when(k % 3 == 1, "").alias("penalty"), _LISTED(k % 4 == 0).alias("missing"), F.col("o_totalprice").alias("score"))
    return validate.portfolio_warnings(s, "id", "penalty", "missing", "score")


@query(
    """with p as (select n_regionkey g, n_nationkey profile, n_nationkey % 5 > 1 c from nation), r as (select s_nationkey % 5 g, [s_nationkey, s_suppkey % 25] ps from supplier where s_suppkey % 4 > 0 union all select s_nationkey % 5, [s_nationkey] from supplier where s_suppkey % 4 = 0),
    t as (select r.g, count(distinct u.x) n from r, lateral (select unnest(ps) x) u join p on p.profile = u.x and p.g = r.g group by 1), w as (select g, count(*) n from r where len(ps) >= 2 group by 1)
    select a.g, count(*) requested, count(*) filter (where c) contributing, coalesce(max(t.n), 0) represented, coalesce(max(w.n), 0) integrated, case when count(*) filter (where c) = count(*) then 'sufficient' when count(*) filter (where c) > 0 then 'partial' else 'insufficient' end coverage_status
    from p a left join t on a.g = t.g left join w on a.g = w.g group by a.g"""
)
def synthesis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = K.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("profile"), (F.col("n_nationkey") % 5 > 1).alias("contributing"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    r = K.table(spark, sf_dir, "supplier").select((n % 5).alias("g"), F.when(k % 4 > 0, F.array(n, (k % 25).cast("int"))).otherwise(F.array(n)).alias("profiles"))
    return validate.synthesis(r, p, "g")
