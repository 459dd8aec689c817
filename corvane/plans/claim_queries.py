"""Queries over rendered claims: classification, scoring, extraction of values, contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import classify, contradict, evidence, score
from corvane.plans import carriers as K
from corvane.plans.catalog import query

_TYPE = K.sql_first_pattern("claim", L.EVIDENCE_TYPES, "fact")
_STORE = (
    f"case when {K.sql_any('claim', L.ADMINISTRATIVE)} then 'ADMINISTRATIVE' when {K.sql_any('claim', L.PROVENANCE)} then 'PROVENANCE' "
    f"when regexp_matches(claim, {K.quoted(L.TECHNICAL_UNIT)}) then 'TECHNICAL' else 'STRATEGIC' end"
)
_SCOPE = K.sql_first_pattern("claim", L.SCOPES, "unknown")
_KIND = (
    f"case when regexp_matches(claim, {K.quoted(L.RATE)}) then 'rate' when regexp_matches(claim, {K.quoted(L.TARGET)}) or regexp_matches(claim, {K.quoted(L.PROJECTION)}) then 'target' "
    f"when regexp_matches(claim, {K.quoted(L.CURRENT)}) then 'current' else 'unknown' end"
)
_CONTEXT = K.sql_first_pattern("claim", L.CONTEXTS, "@").replace("else '@' end", f"when ({_KIND}) = 'target' then 'future_projection' when ({_KIND}) = 'current' then 'current_deployment' else 'unknown' end")


@query(
    f"""select id, {_TYPE} evidence_type, {_STORE} store_type, {_SCOPE} scope, {_KIND} kind, {_CONTEXT} context,
    not regexp_matches(claim, {K.quoted(L.CROSS_COMPARISON)}) source_local, {K.sql_first_pattern("claim", L.RECOVERY_REASONS, "other")} recovery,
    {K.sql_densest("claim", L.PERSPECTIVES_AI_DC, "general")} perspective, {K.sql_first_terms("claim", L.CATEGORY_LADDER, "other")} category,
    array_to_string(list_filter([{", ".join(f"case when {K.sql_any('claim', t)} then {K.quoted(n)} end" for n, t in L.TOPICS)}], lambda x: x is not null), ',') topics
    from {K.CLAIMS_SQL}"""
)
def claim_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("claim")
    return K.claims(spark, sf_dir).select(
        "id",
        classify.evidence_type(c).alias("evidence_type"),
        classify.store_type(c, F.lit("")).alias("store_type"),
        classify.scope(c).alias("scope"),
        classify.temporal_kind(c).alias("kind"),
        classify.comparison_context(c).alias("context"),
        classify.source_local(c).alias("source_local"),
        classify.recovery_reason(c).alias("recovery"),
        classify.perspective(c, F.lit("ai_dc")).alias("perspective"),
        classify.category(c).alias("category"),
        F.array_join(classify.topics(c), ",").alias("topics"),
    )


def _entity_sql() -> tuple[str, str]:
    name, kind = [], []
    for pattern, shown, change, k in L.ENTITIES:
        hit = f"regexp_matches(claim, {K.quoted(pattern)})"
        value = f"regexp_extract(claim, {K.quoted(pattern)}, 1)"
        if change == "u":
            value = f"upper({value})"
        elif change == "t":
            value = f"upper(substr({value}, 1, 1)) || lower(substr({value}, 2))"
        head = shown.split("{1}")[0]
        text = f"{K.quoted(head)} || {value}" if "{1}" in shown else K.quoted(shown)
        name.append(f"when {hit} then {text}")
        kind.append(f"when {hit} then {K.quoted(k)}")
    return f"case {' '.join(name)} else '' end", f"case {' '.join(kind)} else '' end"


_NATURAL = " ".join(f"when entity_type = {K.quoted(k)} then {K.quoted(v)}" for k, v in L.ENTITY_TYPE_SCOPE.items())


@query(
    f"""select id, entity, entity_type, case when found <> 'unknown' then found {_NATURAL} else 'unknown' end scope
    from (select id, {_entity_sql()[0]} entity, {_entity_sql()[1]} entity_type, {_SCOPE} found from {K.CLAIMS_SQL})"""
)
def claim_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradict.enriched(K.claims(spark, sf_dir)).select("id", "entity", "entity_type", "scope")


@query(
    f"""with e as (select {_entity_sql()[0]} entity, {_SCOPE} scope from {K.CLAIMS_SQL})
    select round(100.0 * count(*) filter (where entity <> '') / count(*), 2) entity_pct, round(100.0 * count(*) filter (where scope <> 'unknown') / count(*), 2) scope_pct, count(*) n from e"""
)
def extraction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = K.claims(spark, sf_dir).select(classify.entity(F.col("claim")).alias("e"), classify.scope(F.col("claim")).alias("scope"))
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 2)
    return e.agg(share(F.col("e.entity") != "").alias("entity_pct"), share(F.col("scope") != "unknown").alias("scope_pct"), F.count("*").alias("n"))


_TERMS = ("power", "kw", "rack", "cooling", "licensing")
_ASKED = ("power", "cooling")
_HAY = "lower(claim || ' ' || claim || ' ' || category || ' ' || '')"


@query(
    f"""with c as (select id, claim, {K.sql_first_terms("claim", L.CATEGORY_LADDER, "other")} category, 1 + id % 5 quality from {K.CLAIMS_SQL}),
    h as (select *, {K.sql_hits("claim || ' ' || category", _TERMS)} n, category in ('power', 'cooling') topical, lower(claim || ' ' || claim) both_low from c),
    s as (select *, case when n >= 4 or (topical and n >= 2) then 5 when n >= 2 or topical then 4 when n = 1 or category <> 'other' then 3 when {K.sql_any("claim", L.DOMAIN_TERMS)} then 2 else 1 end relevance_score,
      {K.sql_count("both_low", L.SPECIFIC_NUMBER)} num, {K.sql_hits("claim", L.SPECIFIC_TERMS)} hits, {K.sql_count("both_low", L.UNIT_NUMBER)} units, {K.sql_count("both_low", L.BARE_NUMBER)} bare from h),
    q as (select *, case when num >= 2 or hits >= 5 then 5 when num >= 1 or hits >= 3 then 4 when hits >= 1 or length(claim) >= 140 then 3 when length(claim) >= 60 then 2 else 1 end specificity_score,
      case when units >= 3 then 5 when units >= 2 then 4 when units >= 1 or bare >= 3 then 3 when bare >= 1 then 2 else 1 end quantitative_score from s)
    select id, relevance_score, specificity_score, quantitative_score, round(0.40 * relevance_score::double + 0.22 * quality::double + 0.25 * specificity_score::double + 0.13 * quantitative_score::double, 2) overall_score from q"""
)
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.claims(spark, sf_dir).select("id", "claim", F.col("claim").alias("snippet"), classify.category(F.col("claim")).alias("category"), F.lit("").alias("relevance"), (1 + F.col("id") % 5).alias("quality"))
    return evidence.scored(c, _TERMS, _ASKED).select("id", "relevance_score", "specificity_score", "quantitative_score", "overall_score")


def _default_sql(i: int) -> str:
    return "case store_type " + " ".join(f"when {K.quoted(k)} then {str(v[i]).lower()}" for k, v in L.RETRIEVAL_DEFAULTS.items()) + " end"


@query(
    f"""with c as (select id, claim, 1 + id % 5 quality, {_STORE} store_type, case id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end confidence from {K.CLAIMS_SQL})
    select id, store_type, case confidence when 'high' then 0.85 when 'medium' then 0.60 else 0.35 end::double confidence_value, round((3 + quality + 2) / 3.0::double, 2) overall,
    case when quality >= 4 then 'HIGH' when quality <= 2 then 'LOW' else 'MEDIUM' end credibility, {_default_sql(0)} enabled, {_default_sql(1)} priority, {_default_sql(2)}::double strategic from c"""
)
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.claims(spark, sf_dir).withColumns({
        "quality": 1 + F.col("id") % 5,
        "confidence": F.when(F.col("id") % 3 == 0, "high").when(F.col("id") % 3 == 1, "medium").otherwise("low"),
        "category": F.lit(""),
        "relevance_score": F.lit(3),
        "specificity_score": F.lit(2),
    })
    m = evidence.store_metadata(c)
    return m.select("id", "store_type", "confidence_value", "overall", "credibility", F.col("defaults.enabled").alias("enabled"), F.col("defaults.priority").alias("priority"), F.col("defaults.value").alias("strategic"))


_TOPICS = L.CONTRADICTION_TOPICS_AI_DC


def _pairs_of(values: tuple) -> str:
    return ", ".join(K.quoted("|".join(sorted(p))) for p in values)


_PRODUCT_BITS = " + ".join(f"case when {K.sql_any('claim', terms)} then {bit << 2 * i} else 0 end" for i, (_, xs, ys) in enumerate(L.DISTINCT_PRODUCTS) for bit, terms in ((1, xs), (2, ys)))
_TOPIC_BITS = " + ".join(f"case when {K.sql_any('claim', terms)} then {1 << i} else 0 end" for i, (_, terms) in enumerate(_TOPICS))
_TOPIC = "case " + " ".join(f"when ((a.topics | b.topics) & {1 << i}) <> 0 then {K.quoted(name)}" for i, (name, _) in enumerate(_TOPICS)) + " else 'other' end"
_QUALITY = "(select p_partkey id, case when p_retailprice > 1000 then 1 + p_partkey % 5 else 3 end quality from part)"
#: Every claim with what both kinds of comparison need.
_SUBJECTS_SQL = f"""(select c.id, claim, lower(claim) low, lower(trim(entity)) e, case when found <> 'unknown' then found {_NATURAL} else 'unknown' end s, {_CONTEXT} ctx, {_KIND} kind,
    {_PRODUCT_BITS} prod, {_TOPIC_BITS} topics, quality from (select id, claim, {_entity_sql()[0]} entity, {_entity_sql()[1]} entity_type, {_SCOPE} found from {K.CLAIMS_SQL}) c join {_QUALITY} q on c.id = q.id)"""
_NAMES = "(a.e = '' or b.e = '' or contains(a.e, b.e) or contains(b.e, a.e))"
_PRODUCT = " ".join(
    f"when ((a.prod & {1 << 2 * i}) <> 0 and (b.prod & {2 << 2 * i}) <> 0) or ((a.prod & {2 << 2 * i}) <> 0 and (b.prod & {1 << 2 * i}) <> 0) then {K.quoted(reason)}"
    for i, (reason, _, _) in enumerate(L.DISTINCT_PRODUCTS)
)
_SCOPES_DIFFER = f"""not (a.s = 'unknown' or b.s = 'unknown' or replace(a.s, 'reactor', 'unit') = replace(b.s, 'reactor', 'unit')
    or (least(replace(a.s, 'reactor', 'unit'), replace(b.s, 'reactor', 'unit')) || '|' || greatest(replace(a.s, 'reactor', 'unit'), replace(b.s, 'reactor', 'unit'))) not in ({_pairs_of(L.INCOMPATIBLE_SCOPES)}))"""
_CONTEXTS_CLASH = f"(a.ctx = 'example_deployment' or b.ctx = 'example_deployment' or (least(a.ctx, b.ctx) || '|' || greatest(a.ctx, b.ctx)) in ({_pairs_of(L.INCOMPATIBLE_CONTEXTS)}))"


def _numeric_sql(also: str = "topics") -> str:
    """All pairs of claims, compared one by one: a, b (claims), ra, rb (their classes), unit, outcome, ratio and the like."""
    rows = []
    for o, u in enumerate(L.UNITS):
        x = contradict._escaped(u)
        v = f"coalesce(nullif(regexp_extract(low, '\\b(\\d+(?:\\.\\d+)?)\\s*{x}\\b', 1), ''), nullif(regexp_extract(low, '\\b{x}\\s*(\\d+(?:\\.\\d+)?)\\b', 1), ''))::double"
        f, g = f"regexp_extract(low, '\\b\\d+(?:\\.\\d+)?\\s*{x}\\b')", f"regexp_extract(low, '\\b{x}\\s*\\d+(?:\\.\\d+)?\\b')"
        lo = f"nullif(regexp_extract(low, '\\b(\\d+(?:\\.\\d+)?)\\s*[-–]\\s*(\\d+(?:\\.\\d+)?)\\+?\\s*{x}\\b', {{n}}), '')::double"
        rows.append(f"select *, {o} o, '{u}' unit, {v} v, {f} f, coalesce(nullif({f}, ''), {g}) ff, {lo.format(n=1)} rlo, {lo.format(n=2)} rhi from c where contains(low, '{u}')")
    prefix = " ".join(f"when {K.quoted(k)} then {K.quoted(x)}" for k, x in L.SCOPE_POWER.items())
    power = lambda x: f"regexp_matches({x}.metric, '{L.SCOPED_POWER}')"
    unit_topic = " ".join(f"when {K.quoted(k)} then {K.quoted(x)}" for k, x in L.UNIT_TOPIC.items())
    return f"""with c as (select * from {_SUBJECTS_SQL}), u as ({" union all ".join(rows)}),
    w as (select *, strpos(low, f) - 1 p, strpos(low, ff) - 1 pp from u where v is not null),
    x as (select *, substr(low, greatest(pp - 80, 0) + 1, least(pp, 80) + length(ff) + 80) near, substr(low, greatest(p - 120, 0) + 1, p - greatest(p - 120, 0)) before_ from w),
    m as (select *, case when unit = 'w' then case when s in ('node', 'chip') then 'gpu_power_w' else 'w_value' end when unit not in ('kw', 'mw', 'gw') then unit || '_value' else
      coalesce(case s {prefix} end || '_' || unit, unit || '_' || case when regexp_matches(near, {K.quoted(L.RATE)}) then 'rate' when regexp_matches(near, {K.quoted(L.TARGET)}) then 'target'
      when regexp_matches(near, {K.quoted(L.CURRENT)}) then 'current' else 'level' end) end metric,
      case when f = '' then 'primary' when regexp_matches(right(before_, 50), {K.quoted(L.THRESHOLD_BEFORE)}) then 'threshold'
        when regexp_matches(right(before_, 80) || substr(low, p + 1, 80), {K.quoted(L.HISTORICAL)}) or regexp_matches(before_, {K.quoted(L.COMPARISON_CLAUSE)}) then 'historical_comparison' else 'primary' end meaning from x),
    h as (select id, e || '|' || s || '|' || ctx || '|' || prod || '|' || kind || '|' || concat_ws('|', {also}) || '|' || string_agg(concat_ws(':', o, v, metric, coalesce(rlo::varchar, '-'), coalesce(rhi::varchar, '-'), meaning), ';' order by o) sig
      from m group by id, e, s, ctx, prod, kind, topics, quality),
    r as (select id, min(id) over (partition by sig) rep from h), n as (select m.*, rep from m join r on m.id = r.id),
    p as (select a.id a, b.id b, least(a.rep, b.rep) class_a, greatest(a.rep, b.rep) class_b, a.rep <= b.rep in_order, a.quality qa, b.quality qb, a.unit, a.o, abs(a.v - b.v) / nullif(greatest(a.v, b.v), 0) ratio,
      {_TOPIC} profile_topic, coalesce(case a.unit {unit_topic} end, 'numeric specification') unit_topic, case
      when not {_NAMES} then 'entity_mismatch' {_PRODUCT} when {_SCOPES_DIFFER} then 'scope_mismatch'
      when a.metric <> b.metric and (({power("a")} and {power("b")}) or (suffix(a.metric, '_rate') <> suffix(b.metric, '_rate'))) then case when {power("a")} and {power("b")} then 'metric_scope_mismatch' end
      when least(a.kind, b.kind) = 'current' and greatest(a.kind, b.kind) in ('target', 'rate') then 'temporal_progression' when {_CONTEXTS_CLASH} then 'context_mismatch'
      when (a.rlo is not null and b.rlo is null and b.v >= a.rlo * 0.85::double and b.v <= a.rhi * 1.15::double) or (b.rlo is not null and a.rlo is null and a.v >= b.rlo * 0.85::double and a.v <= b.rhi * 1.15::double) then 'range_average_compatible'
      when a.meaning = 'threshold' or b.meaning = 'threshold' then 'threshold_vs_measurement'
      when a.meaning = 'historical_comparison' or b.meaning = 'historical_comparison' then 'historical_progression'
      when coalesce(abs(a.v - b.v) / nullif(greatest(a.v, b.v), 0), 0) > 0.20::double then 'conflict' end outcome
      from n a join n b on a.unit = b.unit and a.id < b.id),
    q as (select *, min(case when outcome = 'conflict' then o end) over (partition by a, b) first_ from p)
    select * from q where outcome is not null and (first_ is null or o <= first_)"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with entity, scope, topics (bits) and the quality of their source."""
    q = F.when(F.col("p_retailprice") > 1000, 1 + F.col("p_partkey") % 5).otherwise(3)
    quality = K.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), q.alias("quality"))
    return contradict.enriched(K.claims(spark, sf_dir)).withColumn("topics", contradict.topic_bits(F.col("claim"), _TOPICS)).join(quality, "id")


def _numeric(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ("topics",)) -> DataFrame:
    return contradict.classes(contradict.numeric_signatures(_subjects(spark, sf_dir), also=also))


@query(
    f"""select class_a, class_b, unit, outcome, round(ratio, 6) ratio, case when outcome = 'conflict' then case when ratio >= 0.5 then 'high' else 'medium' end end severity,
    case when outcome = 'conflict' then unit_topic end topic, count(*) pairs from ({_numeric_sql()}) where outcome <> 'entity_mismatch' group by all"""
)
def numeric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradict.numeric_pairs(_numeric(spark, sf_dir)).select("class_a", "class_b", "unit", "outcome", "ratio", "severity", "topic", "pairs")


@query(f"select id k, rep \"class\" from ({_numeric_sql().split(', n as (select m.*')[0]} select id, rep from r)")
def numeric_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradict.members(contradict.numeric_signatures(_subjects(spark, sf_dir), also=("topics",)))


def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _numeric(spark, sf_dir)
    return contradict.suppression_metrics(contradict.numeric_counts(found), contradict.mismatches(found, "unit"))


@query(f"select outcome, count(*) n from ({_numeric_sql()}) group by outcome")
def suppression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppressed(spark, sf_dir)


_FLAGS_SQL = ", ".join(f"count(*) filter (where outcome in ({', '.join(map(K.quoted, reasons))})) > 0 {flag}" for flag, reasons in contradict.FLAGS.items())


@query(f"select count(*) candidate_count, count(*) filter (where outcome <> 'conflict') suppressed_count, count(*) filter (where outcome = 'conflict') final_count, {_FLAGS_SQL} from ({_numeric_sql()})")
def suppression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradict.suppression_summary(_suppressed(spark, sf_dir))


@query(f"select profile_topic topic, count(*) n from ({_numeric_sql()}) where outcome = 'conflict' group by all")
def conflict_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric conflicts by the topic that a domain profile gives them."""
    return contradict.numeric_counts(_numeric(spark, sf_dir), _TOPICS).filter("outcome = 'conflict'").select("topic", "n")


_SIDES = " union all ".join(
    f"select *, {o} o, {side} side, coalesce({', '.join(f'case when contains(low, {K.quoted(t)}) then {K.quoted(t)} end' for t in terms)}) term from c"
    for o, two in enumerate(L.EXCLUSIVE)
    for side, terms in enumerate(two)
)
_NEAR_YEAR = "substr(low, greatest(strpos(low, term) - 1 - 80, 0) + 1, strpos(low, term) - 1 - greatest(strpos(low, term) - 1 - 80, 0) + 84)"
_LIFE = ", ".join(map(K.quoted, L.LIFECYCLE))
_BOTH = "term_a || ' ' || term_b"
_CATEGORICAL_SQL = f"""with c as (select * from {_SUBJECTS_SQL}), s as (select * from ({_SIDES}) where term is not null),
    m as (select *, case when regexp_matches(term, '^20[0-9][0-9]$') then {K.sql_first_pattern(_NEAR_YEAR, L.MILESTONES, "year_generic")} when regexp_matches(term, 'cool|dlc|liquid') then 'cooling_method'
      when contains(term, 'phase') then 'cooling_phase' when contains(term, 'gpu') then 'gpu_count' when contains(term, 'nvl') then 'rack_type' else 'categorical_specification' end metric from s),
    h as (select id, e || '|' || s || '|' || ctx || '|' || prod || '|' || string_agg(concat_ws(':', o, side, term, metric), ';' order by o, side) sig from m group by id, e, s, ctx, prod),
    r as (select id, min(id) over (partition by sig) rep from h), n as (select m.*, rep from m join r on m.id = r.id),
    p as (select a.id a, b.id b, a.rep class_a, b.rep class_b, a.o pair, a.side, a.term term_a, b.term term_b, case when not {_NAMES} then 'entity_mismatch' {_PRODUCT}
      when (a.metric in ({_LIFE}) or starts_with(a.metric, 'year_') or b.metric in ({_LIFE}) or starts_with(b.metric, 'year_')) and (a.metric in ('year_generic', 'year_event') or b.metric in ('year_generic', 'year_event') or (a.metric in ({_LIFE}) and b.metric in ({_LIFE}) and a.metric <> b.metric))
        then case when a.metric in ({_LIFE}) and b.metric in ({_LIFE}) and a.metric <> b.metric then 'milestone_progression' end
      when {_SCOPES_DIFFER} then 'scope_mismatch' when {_CONTEXTS_CLASH} then 'context_mismatch' else 'conflict' end outcome
      from n a join n b on a.o = b.o and a.side <> b.side and (a.rep < b.rep or (a.rep = b.rep and a.id < b.id))),
    q as (select *, min(case when outcome = 'conflict' then 2 * pair + side end) over (partition by a, b) first_ from p)
    select * from q where outcome is not null and (first_ is null or 2 * pair + side <= first_)"""


@query(
    f"""select class_a, class_b, pair, term_a, term_b, outcome, case when outcome = 'conflict' then case when regexp_matches({_BOTH}, 'cool|liquid|dlc|water|air') then 'high' else 'medium' end end severity,
    case when outcome = 'conflict' then case when regexp_matches({_BOTH}, 'cool|liquid|dlc|water|air') then 'cooling type' when contains({_BOTH}, 'phase') then 'cooling phase' when regexp_matches({_BOTH}, '20(2[5-9]|30)') then 'timeline'
      when contains({_BOTH}, 'gpu') then 'gpu count' when contains({_BOTH}, 'nvl') then 'rack type' else 'specification' end end topic, count(*) pairs from ({_CATEGORICAL_SQL}) where outcome <> 'entity_mismatch' group by all"""
)
def categorical_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contradict.classes(contradict.categorical_signatures(_subjects(spark, sf_dir)))
    return contradict.categorical_pairs(found).select("class_a", "class_b", "pair", "term_a", "term_b", "outcome", "severity", "topic", "pairs")


@query(f"select outcome, count(*) n from ({_CATEGORICAL_SQL}) group by outcome")
def categorical_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contradict.classes(contradict.categorical_signatures(_subjects(spark, sf_dir)))
    return contradict.suppression_metrics(contradict.categorical_pairs(found), contradict.mismatches(found, "o"))


_STOP = ", ".join(map(K.quoted, L.DURATION_STOP))
_MONTHS = f"case when starts_with(lower(regexp_extract(claim, {K.quoted(L.DURATION)}, 3)), 'year') then 12 else 1 end"


@query(
    f"""with d as (select id, nullif(regexp_extract(claim, {K.quoted(L.DURATION)}, 1), '')::double * {_MONTHS} lo, nullif(regexp_extract(claim, {K.quoted(L.DURATION)}, 2), '')::double * {_MONTHS} h,
      {K.sql_first_pattern("claim", L.DURATION_METRICS, "duration_generic")} metric, list_sort(list_distinct(list_filter(regexp_extract_all(lower(claim), '\\b[a-z][a-z0-9_-]*\\b'), lambda w: length(w) >= 3 and w not in ({_STOP})))) w from {K.CLAIMS_SQL}),
    e as (select id, lo, coalesce(h, lo) hi, metric, w, min(id) over (partition by lo, coalesce(h, lo), metric, w) rep from d where lo is not null),
    p as (select least(a.rep, b.rep) class_a, greatest(a.rep, b.rep) class_b, abs((a.lo + a.hi) / 2 - (b.lo + b.hi) / 2) / greatest((a.lo + a.hi) / 2, (b.lo + b.hi) / 2) ratio, a.metric from e a join e b
      on a.id < b.id and (a.hi < b.lo or b.hi < a.lo) and a.metric = b.metric and len(list_intersect(a.w, b.w)) > 0)
    select class_a, class_b, round(ratio, 6) ratio, case when ratio >= 0.5 then 'high' else 'medium' end severity, case when metric = 'duration_construction' then 'construction duration' else 'timeline' end topic, count(*) pairs from p group by all"""
)
def duration_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradict.duration_pairs(contradict.classes(contradict.duration_signatures(K.claims(spark, sf_dir))))


@query(
    f"""select class_a, class_b, unit, qa, qb, case when qa >= 4 and qb >= 4 then 'high' when abs(qa - qb) >= 3 then 'low' else 'medium' end confidence, count(*) pairs from (
    select class_a, class_b, unit, case when in_order then qa else qb end qa, case when in_order then qb else qa end qb from ({_numeric_sql("topics, quality")}) where outcome = 'conflict') group by all"""
)
def conflict_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contradict.numeric_pairs(_numeric(spark, sf_dir, ("topics", "quality")), also=("quality",)).filter("outcome = 'conflict'")
    c = c.select("class_a", "class_b", "unit", F.col("a_quality").alias("qa"), F.col("b_quality").alias("qb"), "pairs")
    return c.withColumn("confidence", score.contradiction_confidence(F.col("qa"), F.col("qb")))


_PROHIBITED = ("legacy", "limited", "kw", "safety concern")


def _prohibited_sql() -> str:
    parts = " union all ".join(f"select id, claim, lower(claim) low, {K.quoted(t)} term, strpos(lower(claim), {K.quoted(t)}) - 1 p from {K.CLAIMS_SQL}" for t in _PROHIBITED)
    sent = r"lower(trim(regexp_extract(substr(claim, 1, greatest(p, 0)), '([^.!?\n]*)$', 1) || regexp_extract(substr(claim, p + 1), '^(.[^.!?\n]*[.!?\n]?)', 1)))"
    return f"""with t as ({parts}), s as (select *, {sent} sentence, substr(low, greatest(p - 40, 0) + 1, p - greatest(p - 40, 0)) before_ from t)
    select id, term, reason, reason = 'no_exemption_found' penalty from (select id, term, case when p < 0 then 'term_absent' when regexp_matches(before_, {K.quoted(L.NEGATION)}) then 'pre_term_negation'
      when regexp_matches(sentence, {K.quoted(L.EXEMPT)}) then 'sentence_exemption' when suffix(rtrim(sentence), '?') then 'interrogative_sentence' when regexp_matches(sentence, {K.quoted(L.CONTRASTIVE)}) then 'contrastive_context'
      when regexp_matches(low, {K.quoted(L.EXEMPT)}) then 'paragraph_exemption' when regexp_matches(low, {K.quoted(L.CONTRASTIVE)}) then 'paragraph_contrastive' else 'no_exemption_found' end reason from s)"""


@query(_prohibited_sql())
def prohibited_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.claims(spark, sf_dir).select("id", "claim", F.explode(F.array(*map(F.lit, _PROHIBITED))).alias("term"))
    c = c.select("id", "term", classify.prohibited_use(F.col("claim"), F.col("term")).alias("reason"))
    return c.withColumn("penalty", classify.penalised(F.col("reason")))


@query(f"select reason, count(*) n, count(*) filter (where penalty) penalties from ({_prohibited_sql()}) group by reason")
def prohibition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prohibited_terms(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), F.count_if("penalty").alias("penalties"))


@query(
    f"""select id, {K.COMPACT_SQL.format(x="claim")} c, case when length(claim) > 180 then 'Power note: ' || rtrim(substr(claim, 1, 177)) || '...' else 'Power note: ' || claim end note, hits,
    case when hits >= 3 and length(claim) >= 80 then 'high' when hits >= 1 and length(claim) >= 60 then 'medium' else 'low' end confidence,
    case when len(found) > 0 then 'Directly relevant to the question through these terms: ' || array_to_string(found[1:5], ', ') || '.' when hits > 0 then 'Relevant as infrastructure context for the question.'
      else 'Indirect context; review against stronger source evidence before relying on it.' end relevance
    from (select id, claim, {K.sql_hits("claim", _TERMS)} hits, list_filter([{", ".join(f"case when contains(lower(claim), {K.quoted(t)}) then {K.quoted(t)} end" for t in sorted(_TERMS))}], lambda x: x is not null) found from {K.CLAIMS_SQL})"""
)
def claim_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, hits = F.col("claim"), R.term_hits(F.col("claim"), _TERMS)
    return K.claims(spark, sf_dir).select("id", T.compact(c).alias("c"), T.claim_text(c, F.lit("power")).alias("note"), hits.alias("hits"), T.confidence(c, hits).alias("confidence"), T.relevance(c, _TERMS, hits).alias("relevance"))


@query(
    f"""select evidence_type, perspective, count(*) n, round(count(*) / sum(count(*)) over (), 4) share from (select {_TYPE} evidence_type, {K.sql_densest("claim", L.PERSPECTIVES_AI_DC, "general")} perspective from {K.CLAIMS_SQL}) group by all"""
)
def evidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence.enriched(K.claims(spark, sf_dir).withColumn("source", F.lit("report.pdf")))
    g = e.groupBy("evidence_type", "perspective").agg(F.count("*").alias("n"))
    total = e.agg(F.count("*").alias("total"))
    return g.join(F.broadcast(total), F.lit(True)).select("evidence_type", "perspective", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query(
    f"""with c as (select {K.sql_densest("claim", L.PERSPECTIVES_AI_DC, "general")} p from {K.CLAIMS_SQL})
    select count(distinct p) filter (where p <> 'general') perspectives, round(least(count(distinct p) filter (where p <> 'general') / 7.0, 1.0), 4) diversity, count(*) n from c"""
)
def perspective_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = K.claims(spark, sf_dir).select(classify.perspective(F.col("claim"), F.lit("ai_dc")).alias("p"))
    n = F.countDistinct(F.when(F.col("p") != "general", F.col("p")))
    return p.agg(n.alias("perspectives"), F.round(F.least(n / 7.0, F.lit(1.0)), 4).alias("diversity"), F.count("*").alias("n"))
