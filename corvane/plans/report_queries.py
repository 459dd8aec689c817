"""Queries for decision records, memo rules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.operators import chunking, decide, evaluate, link, select
from corvane.plans import carriers as K
from corvane.plans.catalog import ORACLES, query

_REC_SQL = f"(select id, 'Plan ' || brand title, claim summary, id % 4 n_risks, id % 3 n_hyp, id % 2 known, substr(claim, 1, (id % 60)::int) rationale, ['near_term', 'later', 'long_term'][id % 3 + 1] horizon, ['high', 'low'][id % 2 + 1] priority, id % 2 n_triggers, id % 5 n_ev from {K.CLAIMS_SQL})"


def _recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (i % n).cast("int"))
    return K.claims(spark, sf_dir).select(
        "id", F.concat(F.lit("Plan "), "brand").alias("title"), F.col("claim").alias("summary"), (i % 4).alias("n_risks"), (i % 3).alias("n_hyp"), (i % 2).alias("known"), F.substring("claim", F.lit(1), (i % 60).cast("int")).alias("rationale"),
        pick(("near_term", "later", "long_term"), 3).alias("horizon"), pick(("high", "low"), 2).alias("priority"), (i % 2).alias("n_triggers"), (i % 5).alias("n_ev"),
    )


_SAID = "title || ' ' || summary"


@query(
    f"""select id, least(1.0, round((case when n_hyp > 0 then 0.40 else 0 end + case when n_hyp > 0 and known > 0 then 0.10 else 0 end + case when length(rationale) >= 20 then 0.25 else 0 end + case when length(summary) >= 100 then 0.25 else 0 end)::double, 3)) reasoning,
    least(1.0, round((case when {K.sql_any("summary", decide.TRADEOFF_WORDS)} then 0.55 else 0 end + case when n_triggers > 0 then 0.30 else 0 end + case when length(summary) >= 150 then 0.15 else 0 end)::double, 3)) tradeoff,
    least(1.0, round((case when {K.sql_any(_SAID, decide.ACTION_VERBS)} then 0.50 else 0 end + case when {K.sql_hits(_SAID, decide.HEDGE_VERBS)} >= 2 and not {K.sql_any(_SAID, decide.ACTION_VERBS)} then 0 else 0.20 end
      + case when horizon in ('near_term', 'medium_term', 'long_term') then 0.15 else 0 end + case when priority in ('high', 'medium') then 0.15 else 0 end)::double, 3)) actionability,
    array_to_string(list_filter([case when not {K.sql_any("summary", decide.TRADEOFF_WORDS)} then 'tradeoff' end, case when n_risks < 2 then 'risk' end, case when n_ev = 0 then 'evidence' end, case when {K.sql_hits(_SAID, decide.HEDGE_VERBS)} >= 2 and not {K.sql_any(_SAID, decide.ACTION_VERBS)} then 'actionability' end,
      case when length(rationale) < 40 or n_hyp = 0 then 'reasoning' end], lambda x: x is not null), ',') repairs from {_REC_SQL}"""
)
def recommendation_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _recs(spark, sf_dir).select(
        "id", decide.reasoning(c("n_hyp"), c("known"), c("rationale"), c("summary")).alias("reasoning"), decide.tradeoff(c("summary"), c("n_triggers")).alias("tradeoff"), decide.actionability(c("title"), c("summary"), c("horizon"), c("priority")).alias("actionability"),
        F.array_join(decide.repairs(c("title"), c("summary"), c("n_risks"), c("n_ev"), c("n_hyp"), c("rationale")), ",").alias("repairs"),
    )


@query(
    """with g as (select c_nationkey k, count(*) filter (where c_mktsegment = 'BUILDING') % 5 critical, count(*) filter (where c_acctbal < 0) % 4 weak, count(*) filter (where c_acctbal > 9000) % 5 high from customer group by 1),
    c as (select *, ['High', 'Medium', 'Low'][k % 3 + 1] a from g), e as (select *, case when a = 'High' and critical <= 2 and weak = 0 then 'High' when a = 'Low' or high >= 3 or weak >= 2 then 'Low' else 'Medium' end overall from c)
    select k, overall, case overall when 'High' then 'Ready for Decision' when 'Low' then 'Not Ready' else 'Needs Additional Validation' end readiness, case overall when 'High' then 'Proceed' when 'Low' then 'Delay Pending Evidence' else 'Proceed with Conditions' end advice,
    case when upper(overall) <> 'LOW' then 'CONTINUE' when critical >= 3 and weak >= 2 then 'REQUEST_REPLAN' when critical >= 1 or weak >= 1 then 'REQUEST_EVIDENCE' else 'CONTINUE' end next_action from e"""
)
def executive_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = K.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        (F.count_if(F.col("c_mktsegment") == "BUILDING") % 5).alias("critical"), (F.count_if(F.col("c_acctbal") < 0) % 4).alias("weak"), (F.count_if(F.col("c_acctbal") > 9000) % 5).alias("high")
    )
    a = F.get(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), F.col("k") % 3)
    e = g.withColumn("e", decide.executive_confidence(a, F.col("critical"), F.col("weak"), F.col("high")))
    return e.select("k", "e.overall", "e.readiness", "e.advice", decide.next_action(F.upper("e.overall"), F.col("critical"), F.col("weak")).alias("next_action"))


_ASKED = ("Compare {x} power versus {x} grid", "Why does {x} cost more?", "How many SMR units in {x}?", "Tell me about NVIDIA GPU cooling and safety in {x}", "List data center deployments of {x}")
_ASKED_SQL = f"(select n_nationkey id, replace([{', '.join(map(K.quoted, _ASKED))}][n_nationkey % {len(_ASKED)} + 1], '{{x}}', n_name) q from nation)"
_OPENED = ", ".join(f"case when contains(lower(q), {K.quoted(w)}) then {K.quoted(a)} end" for w, a in decide.QUESTION_AREAS)


@query(
    f"""select id, {K.sql_first_pattern("lower(q)", decide.RESEARCH_TYPES, "RESEARCH")} research_type, array_to_string(list_concat(['Overview'], list_filter(o, lambda x, i: list_position(o, x) = i), ['Key Findings', 'Open Questions']), '|') areas
    from (select id, q, list_filter([{_OPENED}], lambda x: x is not null) o from {_ASKED_SQL})"""
)
def research_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.replace(F.get(F.array(*map(F.lit, _ASKED)), F.col("n_nationkey") % len(_ASKED)), F.lit("{x}"), F.col("n_name"))
    n = K.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), q.alias("q"))
    return n.select("id", decide.research_type(F.col("q")).alias("research_type"), F.array_join(decide.question_areas(F.col("q")), "|").alias("areas"))


_HEAD = "[p_name || ' Revision b2, March 2024', 'Version 1.2.3 of NUREG-1234 ' || p_name, 'rev. C 005N9751', 'IAEA-TECDOC-2024 May 7, 2019', p_name, 'Foo 2024', 'INL/EXT-24-12345 version 2']"
_HEADS = ("{n} Revision b2, March 2024", "Version 1.2.3 of NUREG-1234 {n}", "rev. C 005N9751", "IAEA-TECDOC-2024 May 7, 2019", "{n}", "Foo 2024", "INL/EXT-24-12345 version 2")


@query(
    f"""select id, case when regexp_extract(t, {K.quoted(decide.REVISION)}, 1) <> '' then 'Revision ' || upper(regexp_extract(t, {K.quoted(decide.REVISION)}, 1)) when regexp_extract(t, {K.quoted(decide.VERSION)}, 1) <> '' then 'Version ' || regexp_extract(t, {K.quoted(decide.VERSION)}, 1) end as version,
    coalesce({", ".join(f"nullif(regexp_extract(left(t, 800), {K.quoted(p)}), '')" for p in decide.DOCUMENT_NUMBERS)}) as number,
    try_strptime(nullif(regexp_extract(t, {K.quoted(decide.MONTH_YEAR)}, 1), '') || ' ' || regexp_extract(t, {K.quoted(decide.MONTH_YEAR)}, 2), '%B %Y')::date::varchar published,
    coalesce(nullif(trim(case when id % 2 = 0 then '' else 'first' end), ''), nullif(trim(case when id % 3 = 0 then '  ' else 'second' end), ''), 'third') author
    from (select p_partkey id, {_HEAD}[p_partkey % 7 + 1] t from part)"""
)
def document_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = K.table(spark, sf_dir, "part")
    t = F.replace(F.get(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % 7).cast("int")), F.lit("{n}"), F.col("p_name"))
    d = p.select(F.col("p_partkey").alias("id"), t.alias("t"))
    author = decide.tiers(F.when(F.col("id") % 2 == 0, "").otherwise("first"), F.when(F.col("id") % 3 == 0, "  ").otherwise("second"), F.lit("third"))
    return d.select("id", decide.document_version(F.col("t")).alias("version"), decide.document_number(F.col("t")).alias("number"), decide.publication_month(F.col("t")).cast("string").alias("published"), author.alias("author"))


_CATS = ", ".join(map(K.quoted, L.CATEGORIES))
_KINDS = " ".join(f"when {K.quoted(k)} then {K.quoted(v)}" for k, v in decide.KIND_CATEGORIES.items())


@query(
    f"""select id, case when lower(trim(raw)) in ({_CATS}) then lower(trim(raw)) else coalesce(case upper(raw) {_KINDS} end, 'other') end category, greatest(1, least(5, round_even(s * 5, 0)::int)) five from
    (select p_partkey id, [' Power ', 'ECONOMIC', 'regulatory', 'nonsense', 'Safety'][p_partkey % 5 + 1] raw, (p_partkey % 23) / 20.0::double s from part)"""
)
def coerced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    raw = F.get(F.array(*map(F.lit, (" Power ", "ECONOMIC", "regulatory", "nonsense", "Safety"))), (i % 5).cast("int"))
    return K.table(spark, sf_dir, "part").select(i.alias("id"), decide.safe_category(raw, L.CATEGORIES).alias("category"), decide.five_scale((i % 23) / 20.0).alias("five"))


_MEMO = "(select o_custkey k, count(*) areas, count(*) filter (where o_orderstatus = 'F') covered, sum(o_orderkey % 4)::bigint items, sum(o_orderkey % 2)::bigint good_items, count(*) filter (where o_orderpriority = '5-LOW') gaps, count(*) filter (where o_orderstatus = 'O') facts, (o_custkey % 2)::double citation from orders group by o_custkey)"


def _memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = K.table(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count("*").alias("areas"), F.count_if(F.col("o_orderstatus") == "F").alias("covered"), F.sum(F.col("o_orderkey") % 4).alias("items"), F.sum(F.col("o_orderkey") % 2).alias("good_items"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("gaps"), F.count_if(F.col("o_orderstatus") == "O").alias("facts")
    )
    return m.withColumn("citation", (F.col("k") % 2).cast("double"))


_DEC = "({x})::varchar::decimal(20, 17)"


@query(
    f"""select k, case when areas > 0 then round({_DEC.format(x="covered / areas::double * 0.7::double + least(1.0::double, areas / 5.0::double) * 0.3::double")}, 3)::double else 0.5 end planner_score,
    round({_DEC.format(x="least(1.0::double, items / 20.0::double) * 0.5::double + case when items > 0 then good_items / items::double else 0.0::double end * 0.5::double")}, 3)::double evidence_score, round(least(1.0::double, gaps / 5.0::double), 3) review_score,
    round({_DEC.format(x="citation * 0.5::double + least(1.0::double, facts / 10.0::double) * 0.5::double")}, 3)::double report_score from {_MEMO}"""
)
def agent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.agent_scores(_memos(spark, sf_dir)).select("k", "planner_score", "evidence_score", "review_score", "report_score")


@query(
    f"""with a as (select p_partkey id, case when p_partkey % 3 = 0 then p_name else p_name || ' [Source: f.pdf, Evidence: E' || lpad(p_partkey::varchar, 3, '0') || ']' end answer, p_partkey % 2 reported from part)
    select id, reported, len(regexp_extract_all(answer, {K.quoted(L.CITATION)})) found, reported <> len(regexp_extract_all(answer, {K.quoted(L.CITATION)})) discrepancy, length(answer) length from a where reported = 0"""
)
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    answer = F.when(i % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" [Source: f.pdf, Evidence: E"), F.when(F.length(i.cast("string")) < 3, F.lpad(i.cast("string"), 3, "0")).otherwise(F.left(i.cast("string"), F.lit(3))), F.lit("]")))
    return decide.citation_audit(K.table(spark, sf_dir, "part").select(i.alias("id"), answer.alias("answer"), (i % 2).alias("reported")), "id")


@query(
    f"""with c as ({ORACLES["chunk_documents"]}), g as (select doc_id, count(*) chunks, sum(end_offset - start_offset)::bigint characters from c group by doc_id)
    select doc_id, chunks, characters, case when chunks >= 3 then 'inspect_parser_output' when characters > 50000 then 'recover_sections' else 'lower_priority' end advice from g where doc_id not in (select doc_id from labels where quality = 1)"""
)
def zero_yield_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunks(K.table(spark, sf_dir, "documents"), 700, 800).select("doc_id", F.length("chunk_text").alias("chars"))
    return decide.zero_yield(c, K.table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")


@query(
    f"""with c as ({ORACLES["chunk_documents"]}), n as (select doc_id, count(*) chunks, floor(avg(end_offset - start_offset))::bigint mean_size from c group by doc_id)
    select d.doc_id, coalesce(chunks, 0) chunks, coalesce(mean_size, 0) mean_size, coalesce(l.n, 0) evidence from documents d left join n on n.doc_id = d.doc_id left join (select doc_id, count(*) n from labels where quality = 1 group by 1) l on l.doc_id = d.doc_id"""
)
def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.table(spark, sf_dir, "documents")
    c = chunking.chunks(d, 700, 800).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.floor(F.avg(F.length("chunk_text"))).alias("mean_size"))
    e = K.table(spark, sf_dir, "labels").filter("quality = 1").groupBy("doc_id").agg(F.count("*").alias("evidence"))
    j = d.select("doc_id").join(c, "doc_id", "left").join(e, "doc_id", "left")
    return j.select("doc_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("chunks", "mean_size", "evidence")])


@query(
    """select event_id, case event_id % 4 when 0 then 3 when 1 then 2 when 2 then 1 else 0 end received, case event_id % 4 when 0 then 2 when 1 then 1 when 2 then 1 else 0 end valid, case event_id % 4 when 0 then 1 when 1 then 1 else 0 end dropped from events"""
)
def normalised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 4
    raw = F.when(m == 0, '[{"id": "a", "x": 1}, "b", {"x": 2}]').when(m == 1, '[{"id": null}, "c"]').when(m == 2, '["d"]').otherwise("nothing")
    _, counts = decide.normalised_items(K.table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "event_id", "raw", ("id",), "id")
    return counts


@query(
    """with o as (select l_orderkey, l_linenumber, max(l_quantity) q, bool_or(l_returnflag = 'R') r from lineitem group by all),
    f as (select *, row_number() over (partition by l_orderkey order by q desc, l_linenumber) place, row_number() over (partition by l_orderkey order by r desc, l_linenumber) = 1 recommended from o)
    select l_orderkey, l_linenumber, place, recommended from f where place <= 3"""
)
def bounded_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = K.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.bool_or(F.col("l_returnflag") == "R").alias("recommended"))
    o = decide.one_recommended(li, "l_orderkey", "l_linenumber")
    return decide.capped(o, "l_orderkey", [F.desc("l_quantity"), F.asc("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "place", "recommended")


@query(
    """with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 i, least(count(*) over (partition by l_orderkey), 9) n from (select distinct l_orderkey, l_linenumber from lineitem))
    select l_orderkey, l_linenumber, floor(i / greatest(1, n // 3))::bigint scenario from r where i < n and floor(i / greatest(1, n // 3)) < 3"""
)
def scenario_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.bucketed(K.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "scenario")


@query(
    """with a as (select n_regionkey g, n_nationkey x, row_number() over (partition by n_regionkey order by n_nationkey) ordinal from nation), b as (select s_nationkey % 5 g, s_suppkey y, row_number() over (partition by s_nationkey % 5 order by s_suppkey) ordinal from supplier)
    select a.g, a.ordinal, x, y from a left join b on a.g = b.g and a.ordinal = b.ordinal"""
)
def ordinal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = K.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("x"))
    b = K.table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("g"), F.col("s_suppkey").alias("y"))
    return decide.by_ordinal(a, b, "g", "x", "y").select("g", "ordinal", "x", "y")


@query(
    f"""with t(template, terms) as (values ('power', ['kw', 'mw']), ('delay', ['months']), ('none', ['zzz'])), h as (select template, id, row_number() over (partition by template order by id) rn from {K.CLAIMS_SQL} c, t where len(list_filter(terms, lambda k: contains(lower(claim), k))) > 0)
    select template, array_to_string(list_sort(list(id)), ',') support from h where rn <= 3 group by template"""
)
def templated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("power", ["kw", "mw"]), ("delay", ["months"]), ("none", ["zzz"])], "template string, terms array<string>")
    f = decide.templated(K.claims(spark, sf_dir), t, "id", "id", "claim")
    return f.select("template", F.array_join(F.transform("support", lambda x: x.cast("string")), ",").alias("support"))


@query(
    """with p as (select s_suppkey id, 'region_' || n_regionkey profile from supplier join nation on n_nationkey = s_nationkey where s_acctbal > 0), r as (select l_orderkey k, list(distinct l_suppkey) ids from lineitem where l_quantity > 40 group by 1),
    e as (select k, unnest(ids) id from r), g as (select k, list_sort(list(distinct profile)) ps from e join p using (id) group by k) select r.k, coalesce(array_to_string(ps, ','), '') profiles from r left join g on r.k = g.k"""
)
def contributing_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").join(K.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    p = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("profile"))
    r = K.table(spark, sf_dir, "lineitem").filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias("ids"))
    return decide.contributing(r, "k", "ids", p).select("k", F.array_join("profiles", ",").alias("profiles"))


@query(
    """with c as (select o_orderkey id, ['contradiction', 'no_contradiction'][o_orderkey % 2 + 1] expected, o_custkey % 3 conflicts, case when o_custkey % 2 = 0 then ['scope_mismatch'] else []::varchar[] end reasons, o_orderkey % 5 = 0 sf, o_orderkey % 7 = 0 snf, case when o_orderkey % 3 = 0 then 'entity_mismatch' else '' end er from orders)
    select id, case when conflicts > 0 then 'contradiction' else 'no_contradiction' end actual, (case when conflicts > 0 then 'contradiction' else 'no_contradiction' end) = expected correct, not ((sf and len(reasons) = 0) or (snf and len(reasons) > 0) or (er <> '' and len(reasons) > 0 and not list_contains(reasons, er))) suppression_correct from c"""
)
def contradiction_case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = K.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, "contradiction").otherwise("no_contradiction").alias("expected"), (c % 3).alias("conflicts"), F.when(c % 2 == 0, F.array(F.lit("scope_mismatch"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        (k % 5 == 0).alias("should_fire"), (k % 7 == 0).alias("should_not_fire"), F.when(k % 3 == 0, "entity_mismatch").otherwise("").alias("expected_reason"),
    )
    return decide.case_scores(o).select("id", "actual", "correct", "suppression_correct")


@query(
    f"""select match_type, confidence, count(*) n, count(*) filter (where matched) matched, round(avg(similarity), 4) similarity from ({ORACLES["qa_term_matches"]}) group by all"""
)
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.plans.retrieval_queries import qa_term_matches

    return qa_term_matches(spark, sf_dir).groupBy("match_type", "confidence").agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.round(F.avg("similarity"), 4).alias("similarity"))


@query(
    f"""with s as ({ORACLES["recommendation_scores"]}) select count(*) n, round(avg(score), 4) mean, min(score) least, max(score) most, count(*) filter (where penalty is not null) weak, mode(penalty) worst from s"""
)
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.plans.retrieval_queries import recommendation_scores

    return recommendation_scores(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.count_if(F.col("penalty").isNotNull()).alias("weak"), F.mode("penalty").alias("worst")
    )


_THEMES = ((0, "that with have"), (1, "eaux les des"), (2, "keit und der"), (3, "que los del"))
_TSTOP = ", ".join(map(K.quoted, link.STOP))
_TTOK = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in (" + _TSTOP + ")))"


@query(
    f"""with t(theme, name) as (values {", ".join(f"({i}, {K.quoted(n)})" for i, n in _THEMES)}), b as (select theme, unnest({_TTOK.format(x="name")}) t from t), i as (select item_id, unnest({_TTOK.format(x="text")}) t from benchmark), p as (select item_id, theme, count(*) n from i join b on i.t = b.t group by all),
    r as (select *, row_number() over (partition by item_id order by n desc, theme) rn from p), m as (select k.item_id, r.theme from benchmark k left join r on r.item_id = k.item_id and rn = 1), u as (select item_id, (row_number() over (order by item_id) - 1) % 4 theme from m where theme is null)
    select m.item_id, coalesce(m.theme, u.theme)::int theme from m left join u on m.item_id = u.item_id"""
)
def question_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to themes by shared words; those without go round the themes (few, so one ordered window is enough)."""
    themes = spark.createDataFrame(list(_THEMES), "theme int, name string")
    b = K.table(spark, sf_dir, "benchmark").select("item_id", "text")
    best = link.best_target(b, "item_id", "text", themes, "theme", "name")
    rest = best.filter("theme is null").select("item_id", link.round_robin(best, "item_id", len(_THEMES)).cast("int").alias("theme"))
    return best.filter("theme is not null").select("item_id", "theme").unionByName(rest)
