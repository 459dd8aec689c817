"""Queries for retrieval, links, benchmark scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.operators import classify, evaluate, link, retrieve, score, select
from corvane.plans import carriers as K
from corvane.plans.catalog import ORACLES, query
from corvane.sources.scratch import bounded_broadcast

_META = "(select doc_id, toxic = 0 enabled, 1 + doc_id % 5 priority, round((doc_id % 11) / 10.0, 2)::double as worth, (1 + doc_id % 4 + quality)::double overall from labels)"
_FACTOR = "((0.8::double + (overall - 1.0::double) / 4.0::double * 0.4::double) * (0.9::double + (priority - 1) / 4.0::double * 0.2::double) * (0.9::double + worth * 0.2::double))"
_WORDS = ("that", "with", "risk", "eaux")
_BOOST = f"least(0.45::double, {K.sql_hits('text', L.RISK_VOCABULARY)} / 5.0::double * 0.45::double)"
_LEX = f"case when {K.sql_hits('text', _WORDS)} > 0 then {K.sql_hits('text', _WORDS)} / {len(_WORDS)}.0::double + {_BOOST} else 0.0::double end"


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "labels").select(
        "doc_id",
        (F.col("toxic") == 0).alias("enabled"),
        (1 + F.col("doc_id") % 5).alias("priority"),
        F.round((F.col("doc_id") % 11) / 10.0, 2).alias("value"),
        (1 + F.col("doc_id") % 4 + F.col("quality")).cast("double").alias("overall"),
    )


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("statement"))


@query(
    f"""with s as (select d.doc_id, round({_LEX} * {_FACTOR}, 4) score, overall from documents d join {_META} m on d.doc_id = m.doc_id where enabled)
    select doc_id, score, row_number() over (order by score desc, overall desc, doc_id) as rank from s where score >= 0.01 order by score desc, overall desc, doc_id limit 40"""
)
def lexical_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieve.candidates(_statements(spark, sf_dir), _metadata(spark, sf_dir), "doc_id")
    return retrieve.top(retrieve.scored(c, "lexical", _WORDS), 40, "doc_id").select("doc_id", "score", "rank")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return K.table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()["embedding"]


_COS = "(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i]::double * q[i]::double)) / ((sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))) + 1e-9) * (sqrt(list_sum(list_transform(q, lambda x: x::double * x::double))) + 1e-9)))"
_SEM = f"(select vec_id, {_COS} sem from (select vec_id, embedding e, (select embedding from embeddings where vec_id = 0) q from embeddings))"


@query(f"select vec_id, round(sem, 4) similarity, row_number() over (order by round(sem, 4) desc, vec_id) as rank from {_SEM} where sem > 0 order by round(sem, 4) desc, vec_id limit 50")
def semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    e = K.table(spark, sf_dir, "embeddings").select("vec_id", score.cosine(F.col("embedding"), q).alias("s")).filter("s > 0").withColumn("similarity", F.round("s", 4))
    return select.ranked_top(e, [F.desc("similarity"), F.asc("vec_id")], 50).select("vec_id", "similarity", "rank")


_HYBRID = f"""(select d.doc_id, {_LEX} lex, greatest(coalesce(sem, 0), 0) sem, overall, {_FACTOR} f from documents d join {_META} m on d.doc_id = m.doc_id left join {_SEM} e on e.vec_id = d.doc_id where enabled)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieve.candidates(_statements(spark, sf_dir), _metadata(spark, sf_dir), "doc_id")
    e = K.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieve.scored(c.join(e, "doc_id", "left"), "hybrid", _WORDS, _query_vector(spark, sf_dir))


@query(
    f"""with s as (select *, round((0.4::double * lex + 0.6::double * sem) * f, 4) score from {_HYBRID} where lex > 0 or sem > 0)
    select doc_id, score, round(lex, 4) lexical, round(sem, 4) semantic from s where score >= 0.01 order by score desc, overall desc, doc_id limit 40"""
)
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.top(_hybrid(spark, sf_dir), 40, "doc_id").select("doc_id", "score", F.round("lexical", 4).alias("lexical"), F.round("semantic", 4).alias("semantic"))


@query(
    f"""select count(*) filter (where lex > 0) lexical, count(*) filter (where sem > 0) semantic, count(*) filter (where lex > 0 and sem > 0) both_, count(*) merged from {_HYBRID} where (lex > 0 or sem > 0) and round((0.4::double * lex + 0.6::double * sem) * f, 4) >= 0.01"""
)
def hybrid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hybrid(spark, sf_dir)
    return h.agg(F.count_if(F.col("lexical") > 0).alias("lexical"), F.count_if(F.col("semantic") > 0).alias("semantic"), F.count_if((F.col("lexical") > 0) & (F.col("semantic") > 0)).alias("both_"), F.count("*").alias("merged"))


@query(
    f"""with s as (select d.doc_id, round({_LEX} * {_FACTOR}, 4) score from documents d join {_META} m on d.doc_id = m.doc_id where enabled), o as (select doc_id, min(position) position from (select doc_id, doc_id % 17 position from labels where toxic = 1 union all select doc_id, 99 from labels where quality = 1) group by doc_id)
    select s.doc_id, row_number() over (order by o.position is null, o.position, score desc, s.doc_id) as rank from s left join o on s.doc_id = o.doc_id where score >= 0.01 order by o.position is null, o.position, score desc, s.doc_id limit 30"""
)
def reranked_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieve.scored(retrieve.candidates(_statements(spark, sf_dir), _metadata(spark, sf_dir), "doc_id"), "lexical", _WORDS)
    lab = K.table(spark, sf_dir, "labels")
    order = lab.filter("toxic = 1").select("doc_id", (F.col("doc_id") % 17).alias("position")).unionByName(lab.filter("quality = 1").select("doc_id", F.lit(99).cast("long").alias("position")))
    return retrieve.reranked(c, order, "doc_id", 30).select("doc_id", "rank")


_LSTOP = ", ".join(map(K.quoted, link.STOP))
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2 and w not in (" + _LSTOP + ")))"


@query(
    f"""with i as (select conv_id * 1000 + turn id, unnest({_TOK.format(x="text")}) t from conversations), b as (select item_id, unnest({_TOK.format(x="text")}) t from benchmark), p as (select id, item_id, count(*) n from i join b on i.t = b.t group by all),
    r as (select *, row_number() over (partition by id order by n desc, item_id) rn from p) select c.conv_id * 1000 + c.turn id, coalesce(r.item_id, -1) item_id, coalesce(r.n, 0) overlap from conversations c left join r on r.id = c.conv_id * 1000 + c.turn and rn = 1"""
)
def subquestion_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    b = K.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return link.best_target(c, "id", "text", b, "item_id", "question", -1)


_N0, _N1 = "count(*) filter (where n = 0)", "count(*) filter (where n = 1)"
_COV = f"greatest(0.0::double, 1.0::double - {_N0} / count(*)::double)"
_EV = f"least(1.0::double, greatest(0.0::double, 1.0::double - ({_N0} * 0.3::double + {_N1} * 0.1::double) / count(*)) + 0.1::double)"


def _level(x: str) -> str:
    return f"case when {x} >= 0.7 then 'HIGH' when {x} >= 0.4 then 'MEDIUM' else 'LOW' end"


@query(
    f"""with m as (select item_id, count(*) n from ({ORACLES["subquestion_mapping"]}) where item_id >= 0 group by item_id), s as (select b.item_id, coalesce(n, 0) n from benchmark b left join m on b.item_id = m.item_id)
    select count(*) questions, round({_COV}, 4) coverage_score, {_level(_COV)} coverage, round({_EV}, 4) evidence_score, {_level(_EV)} evidence from s"""
)
def investigation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = subquestion_mapping(spark, sf_dir).filter("item_id >= 0").groupBy("item_id").agg(F.count("*").alias("n"))
    s = K.table(spark, sf_dir, "benchmark").select("item_id").join(m, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))
    return evaluate.sufficiency(s, F.lit(25))


_AREA_ROWS = ("Power", "Cooling", "Networking", "Rack Architecture", "Grid Integration", "Other")


@query(
    f"""with e as (select id, category, {{topics}} topics from (select id, claim, {K.sql_first_terms("claim", L.CATEGORY_LADDER, "other")} category from {K.CLAIMS_SQL})), a(area) as (values {", ".join(f"({K.quoted(x)})" for x in _AREA_ROWS)}),
    t as (select id, unnest({_TOK.format(x="category || ' ' || array_to_string(topics, ' ')")}) t from e), b as (select area, unnest({_TOK.format(x="area")}) t from a)
    select distinct id, area from t join b on t.t = b.t union select id, area from e join a on a.area = case category {" ".join(f"when {K.quoted(k)} then {K.quoted(v)}" for k, v in link.AREAS.items())} end""".replace(
        "{topics}", "list_filter([" + ", ".join(f"case when {K.sql_any('claim', t)} then {K.quoted(n)} end" for n, t in L.TOPICS) + "], lambda x: x is not null)"
    )
)
def area_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("claim")
    e = K.claims(spark, sf_dir).select("id", classify.category(c).alias("category"), classify.topics(c).alias("topics"))
    return link.area_links(e, spark.createDataFrame([(a,) for a in _AREA_ROWS], "area string"))


@query(
    """with r as (select l_orderkey rec, list_distinct(list(l_partkey)) p, list_distinct(list(l_suppkey % 7)) h from lineitem where l_quantity > 45 group by l_orderkey), a as (select l_orderkey asm, list_distinct(list(l_partkey)) p, list_distinct(list(100 + l_suppkey)) h from lineitem where l_quantity < 3 group by l_orderkey),
    l as (select distinct rec, asm from (select rec, unnest(p) v from r) x join (select asm, unnest(p) v from a) y on x.v = y.v union select distinct rec, asm from (select rec, unnest(h) v from r) x join (select asm, unnest(h) v from a) y on x.v = y.v)
    select rec, count(*) linked, min(asm) first_ from l group by rec"""
)
def recommendation_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = K.table(spark, sf_dir, "lineitem")
    r = li.filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("rec")).agg(F.collect_set("l_partkey").alias("p"), F.collect_set(F.col("l_suppkey") % 7).alias("h"))
    a = li.filter("l_quantity < 3").groupBy(F.col("l_orderkey").alias("asm")).agg(F.collect_set("l_partkey").alias("p"), F.collect_set(100 + F.col("l_suppkey")).alias("h"))
    return link.shared_links(r, "rec", a, "asm", ("p", "h")).groupBy("rec").agg(F.count("*").alias("linked"), F.min("asm").alias("first_"))


@query("select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49 and l_discount > 0.06)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = K.table(spark, sf_dir, "lineitem").filter("l_quantity > 49 and l_discount > 0.06").select(F.col("l_suppkey").alias("s_suppkey"))
    return link.orphans(K.table(spark, sf_dir, "supplier"), used, "s_suppkey")


@query(
    """with p as (select distinct l_partkey % 200 a, l_suppkey b from lineitem where l_quantity > 40), s as (select a id, b other from p union all select b, a from p)
    select id, array_to_string(list_sort(list(distinct other)), ',') conflicts_with from s where id <> other group by id"""
)
def conflict_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = K.table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select((F.col("l_partkey") % 200).alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return link.closure(p, "a", "b").select("id", F.array_join(F.transform("conflicts_with", lambda x: x.cast("string")), ",").alias("conflicts_with"))


@query(
    """with a as (select o_custkey % 20 k, list(distinct o_orderkey % 50) s from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey % 20 k, list(distinct o_orderkey % 50) s from orders where o_orderpriority = '1-URGENT' group by 1)
    select coalesce(a.k, b.k) k, round(case when len(coalesce(a.s, [])) = 0 and len(coalesce(b.s, [])) = 0 then 1.0::double else len(list_intersect(coalesce(a.s, []), coalesce(b.s, []))) / len(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, []))))::double end, 6) jaccard,
    len(list_intersect(coalesce(a.s, []), coalesce(b.s, []))) shared from a full join b on a.k = b.k"""
)
def run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = K.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("k"), (F.col("o_orderkey") % 50).alias("v"), "o_orderstatus", "o_orderpriority")
    a = o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.collect_set("v").alias("a"))
    b = o.filter("o_orderpriority = '1-URGENT'").groupBy("k").agg(F.collect_set("v").alias("b"))
    none = F.array().cast("array<bigint>")
    j = a.join(b, "k", "full_outer").select("k", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return j.select("k", F.round(link.set_overlap(F.col("a"), F.col("b")), 6).alias("jaccard"), F.size(F.array_intersect("a", "b")).alias("shared"))


@query(
    """with l as (select l.doc_id, quality, toxic, lang from labels l join documents d using (doc_id)), b as (select doc_id, quality = 1 passed from l where lang <> 'fr'), c as (select doc_id, (quality + toxic) % 2 = 1 passed from l where lang <> 'es')
    select coalesce(b.doc_id, c.doc_id) doc_id, case when b.doc_id is null then 'new' when c.doc_id is null then 'removed' when not b.passed and c.passed then 'improved' when b.passed and not c.passed then 'regressed' when b.passed then 'unchanged_pass' else 'unchanged_fail' end as status from b full join c on b.doc_id = c.doc_id"""
)
def regression_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier run knew no French items, the later one no Spanish ones."""
    lab = K.table(spark, sf_dir, "labels").join(K.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    b = lab.filter("lang <> 'fr'").select("doc_id", (F.col("quality") == 1).alias("passed"))
    c = lab.filter("lang <> 'es'").select("doc_id", ((F.col("quality") + F.col("toxic")) % 2 == 1).alias("passed"))
    return evaluate.item_diff(b, c, "doc_id")


@query(
    """with m as (select source k, avg(quality) q, avg((quality + toxic) % 2) c from labels join documents using (doc_id) group by 1), b as (select k metric, round(q, 6) v from m where k <> 'src3'), c as (select k metric, round(c, 6) v from m where k <> 'src4')
    select coalesce(b.metric, c.metric) metric, coalesce(b.v, 0) baseline, coalesce(c.v, 0) as current, round(coalesce(c.v, 0) - coalesce(b.v, 0), 6) delta,
    case when (case when coalesce(b.metric, c.metric) = 'src1' then -1 else 1 end) * round(coalesce(c.v, 0) - coalesce(b.v, 0), 6) < -0.03::double then 'fail' when (case when coalesce(b.metric, c.metric) = 'src1' then -1 else 1 end) * round(coalesce(c.v, 0) - coalesce(b.v, 0), 6) > 0.03::double then 'improved' else 'pass' end as status
    from b full join c on b.metric = c.metric"""
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = K.table(spark, sf_dir, "labels").join(K.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("metric")), "doc_id")
    m = lab.groupBy("metric").agg(F.avg("quality").alias("q"), F.avg((F.col("quality") + F.col("toxic")) % 2).alias("c"))
    return evaluate.metric_diff(m.filter("metric <> 'src3'").select("metric", F.round("q", 6).alias("value")), m.filter("metric <> 'src4'").select("metric", F.round("c", 6).alias("value")), ("src1",))


@query(
    """with s as (select d.doc_id, lang as domain, quality::double coverage, quality = 1 passed, round((quality + toxic) / 2.0, 2)::double overall, toxic = 1 e, n_chars < 100 k from labels l join documents d using (doc_id))
    select domain, count(*) n, round(avg(coverage), 4) coverage, round(avg(passed::int), 4) pass_rate, round(avg(overall), 4) overall from s where not e and not k group by grouping sets ((domain), ())"""
)
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.table(spark, sf_dir, "labels").join(K.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("domain")), "doc_id")
    s = d.select(
        "doc_id", "domain", F.col("quality").cast("double").alias("coverage"), (F.col("quality") == 1).alias("passed"), F.round((F.col("quality") + F.col("toxic")) / 2.0, 2).alias("overall"), (F.col("toxic") == 1).alias("benchmark_error"), (F.col("n_chars") < 100).alias("known_limitation")
    )
    return evaluate.benchmark_summary(s, "domain")


_QA = [("power draw", ["kW today"], ["legacy"]), ("licensing work", ["licensing delays"], []), ("construction of the reactor takes months", [], []), ("capacity target", ["annual target"], []), ("safety concern", ["hazard"], [])]
_MSTOP = ", ".join(map(K.quoted, evaluate.MATCH_STOP))
_MTOK = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) >= 2 and w not in (" + _MSTOP + ")))"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(K.quoted, xs)) + "]::varchar[]"


_MATCH_SQL = f"""with t(term, syn, blk) as (values {", ".join(f"({K.quoted(t)}, {_list(s)}, {_list(a)})" for t, s, a in _QA)}), r as (select id, claim, term, syn, blk, lower(claim) low from {K.CLAIMS_SQL}, t),
    x as (select *, contains(low, lower(term)) ex, list_filter(syn, lambda s: contains(low, lower(s)))[1] sy, list_transform(list_filter(regexp_split_to_array(claim, '[.!?;]|\\s{{3,}}'), lambda w: trim(w) <> ''), lambda w: struct_pack(v := len(list_intersect({_MTOK.format(x="term")}, {_MTOK.format(x="w")}))
      / greatest(len(list_distinct(list_concat({_MTOK.format(x="term")}, {_MTOK.format(x="w")}))), 1)::double, w := w)) ws from r),
    y as (select *, list_max(ws) b from x), z as (select *, case when ex then 1.0::double when sy is not null then 0.95::double else coalesce(b.v, 0) end sim from y), k as (select *, case when ex then 'exact' when sy is not null then 'synonym' when sim >= 0.85 then 'token_overlap' else 'none' end kind, lower(coalesce(sy, b.w)) phrase from z)
    select id, term, kind match_type, round(sim, 3) similarity, case when kind in ('exact', 'synonym') or sim >= 0.92 then 'HIGH' when sim >= 0.85 then 'MEDIUM' else 'LOW' end confidence, kind = 'exact' or (kind <> 'none' and not len(list_filter(blk, lambda a: contains(phrase, lower(a)))) > 0) matched from k"""


@query(_MATCH_SQL)
def qa_term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, s)).cast("array<string>").alias("synonyms"), F.array(*map(F.lit, a)).cast("array<string>").alias("blocked")) for t, s, a in _QA]))
    c = K.claims(spark, sf_dir).select("id", F.col("claim").alias("answer"), each.alias("m")).select("id", "answer", "m.*")
    return evaluate.term_matches(c, ("id",))


@query(
    f"""with m as ({_MATCH_SQL}), c as (select id, count(*) filter (where matched) / count(*)::double cov from m group by id), f as (select id, contains(lower(claim), 'legacy')::int v, id % 2 cit from {K.CLAIMS_SQL})
    select f.id, round(cov, 6) coverage, case when v > 0 then 1.0 else 0.0 end penalty, case when cit > 0 then 1.0 else 0.0 end citation, round(cov * (1.0::double - v) * 0.9::double + cit * 0.1::double, 4) overall, cov >= 0.5 and v = 0 passed from f join c on f.id = c.id"""
)
def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = K.claims(spark, sf_dir).select("id", F.contains(F.lower("claim"), F.lit("legacy")).cast("int").alias("violations"), (F.col("id") % 2).alias("citations"))
    return evaluate.qa_scores(qa_term_matches(spark, sf_dir), "id", facts)


@query(
    """with q as (select case when item_id % 9 = 0 then 'dup' else item_id::varchar end id, case when item_id % 5 = 0 then ' ' else substr(text, 1, 20) end question, case when item_id % 4 = 0 then [] else ['rack power', 'x'] end inc, case item_id % 3 when 0 then ['kw'] when 1 then ['Rack'] else [' '] end exc from benchmark)
    select id, 'missing_required_field' code from q where trim(question) = '' union all select id, 'no_must_include' from q where len(inc) = 0 union all select id, 'short_prohibited_term' from q where len(list_filter(exc, lambda p: length(trim(p)) <= 2)) > 0
    union all select id, 'must_include_conflict' from q where len(list_filter(exc, lambda p: trim(p) <> '' and len(list_filter(inc, lambda r: contains(lower(r), lower(trim(p))) and lower(r) <> lower(trim(p)))) > 0)) > 0 union all select id, 'duplicate_id' from q group by id having count(*) > 1"""
)
def definition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    q = K.table(spark, sf_dir, "benchmark").select(
        F.when(i % 9 == 0, "dup").otherwise(i.cast("string")).alias("id"),
        F.when(i % 5 == 0, " ").otherwise(F.substring("text", 1, 20)).alias("question"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("rack power"), F.lit("x"))).alias("must_include"),
        F.when(i % 3 == 0, F.array(F.lit("kw"))).when(i % 3 == 1, F.array(F.lit("Rack"))).otherwise(F.array(F.lit(" "))).alias("must_not"),
    )
    return evaluate.definition_problems(q)


_SETS = {"power": ("power", "grid"), "cooling": ("cooling", "liquid"), "capital": ("million", "cost"), "inter": ("interconnection",), "trans": ("transmission", "campus.")}


def _has(n: str) -> str:
    return f"list_has_any(w, [{', '.join(map(K.quoted, _SETS[n]))}])"


@query(
    f"""with r as (select id, regexp_split_to_array(lower(claim), '\\s+') w, id % 4 n from {K.CLAIMS_SQL}), f as (select id, n >= 2 risky, {_has("power")} or {_has("trans")} grid, {_has("capital")} or {_has("cooling")} or {_has("inter")} up, {_has("inter")} inter from r),
    s as (select id, case when grid and risky then 1.0 when not risky then 0.6 else 0.75 end b, case when up then 1.0 else 0.75 end u, greatest(0.3, case when risky then least(1.0, case when grid then 0.75 else 0.6 end + case when inter then 0.15 else 0 end) else 0.3 end) d from f)
    select id, case when b >= 0.75 then 'strong' when b >= 0.45 then 'medium' else 'weak' end as base, case when u >= 0.75 then 'strong' when u >= 0.45 then 'medium' else 'weak' end upside, case when d >= 0.75 then 'strong' when d >= 0.45 then 'medium' else 'weak' end downside,
    round(((case when b >= 0.75 then 1.0 when b >= 0.45 then 0.6 else 0.3 end) + (case when u >= 0.75 then 1.0 when u >= 0.45 then 0.6 else 0.3 end) + (case when d >= 0.75 then 1.0 when d >= 0.45 then 0.6 else 0.3 end))::double / 3, 3) robustness from s"""
)
def scenario_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = K.claims(spark, sf_dir).select("id", F.split(F.lower("claim"), r"\s+").alias("w"), (F.col("id") % 4).alias("n"))
    base, up, down, robust = evaluate.scenario_fit(F.col("w"), F.col("n"), _SETS["power"], _SETS["cooling"], _SETS["capital"], _SETS["inter"], _SETS["trans"])
    return r.select("id", base.alias("base"), up.alias("upside"), down.alias("downside"), robust.alias("robustness"))


@query(
    """with r as (select o_orderkey id, count(l_partkey) n, count(*) filter (where l_partkey % 3 = 0) k, o_custkey % 4 risks, o_custkey % 3 specific from orders join lineitem on l_orderkey = o_orderkey group by all),
    s as (select id, least(1.0::double, (case n when 1 then 0.50 when 2 then 0.70 when 3 then 0.85 else 1.0 end)::double + k / n::double * 0.1::double) e0, case when risks = 0 then 0.0::double else least(1.0::double, round((case risks when 1 then 0.50 when 2 then 0.75 else 1.0 end)::double + least(0.15::double, specific / risks::double * 0.15::double), 3)) end rk, (id % 5) / 4.0::double a, (id % 7) / 6.0::double b, (id % 3) / 2.0::double c from r),
    t as (select id, round(e0, 3) e, rk, a, b, c from s), u as (select *, least(e, a, b, rk, c) lo from t)
    select id, e evidence, rk risk, round((0.25::double * e + 0.25::double * a + 0.15::double * b + 0.20::double * rk + 0.15::double * c)::varchar::decimal(20, 17), 3)::double score,
    case when lo >= 0.5 then null when e = lo then 'missing_evidence_links' when a = lo then 'weak_reasoning' when b = lo then 'no_tradeoff_awareness' when rk = lo then 'no_risk_identification' else 'low_actionability' end penalty from u"""
)
def recommendation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = K.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("l_partkey").alias("n"), F.count_if(F.col("l_partkey") % 3 == 0).alias("k"))
    o = K.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("risks"), (F.col("o_custkey") % 3).alias("specific"))
    r = li.join(o, "id")
    parts = {
        "evidence": score.evidence_support(F.col("n"), F.col("k")),
        "risk": score.risk_support(F.col("risks"), F.col("specific")),
        "reasoning": (F.col("id") % 5) / 4.0,
        "tradeoff": (F.col("id") % 7) / 6.0,
        "actionability": (F.col("id") % 3) / 2.0,
    }
    r = r.withColumns(parts)
    total, penalty = score.recommendation_score({n: F.col(n) for n in parts})
    return r.select("id", "evidence", "risk", total.alias("score"), penalty.alias("penalty"))


_TAKEN = "select p_partkey k, {p} profile, row_number() over (order by {s} desc, p_partkey) - 1 i from part where p_partkey not in ({seen}) qualify i < 3"


@query(
    f"""with b0 as ({_TAKEN.format(p=0, s="p_size", seen="-1")}), b1 as ({_TAKEN.format(p=1, s="p_retailprice", seen="select k from b0")}), b2 as ({_TAKEN.format(p=2, s="-p_size", seen="select k from b0 union all select k from b1")}),
    u as (select *, row_number() over (order by i, profile) - 1 as position from (select * from b0 union all select * from b1 union all select * from b2)),
    f as (select p_partkey k, row_number() over (order by o) + 8 as position from (select p_partkey, row_number() over (order by p_size desc, p_partkey) o from part qualify o <= 10) where p_partkey not in (select k from u))
    select position::int as position, k, profile::int profile from u union all select position::int, k, 0 from f where position < 10"""
)
def profile_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten parts for three profiles by turns: the largest, the dearest, the smallest."""
    wants = [(F.lit(0), F.col("p_size").cast("double")), (F.lit(1), F.col("p_retailprice").cast("double")), (F.lit(2), -F.col("p_size").cast("double"))]
    rows = K.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array(*[F.struct(p.alias("profile"), s.alias("s")) for p, s in wants])).alias("w"))
    return select.quota_by_turns(rows.select("k", "w.*"), "profile", "s", "k", 10).select("position", "k", "profile")


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) rn from events) where rn = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.latest(K.table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_type", "value")


@query(
    f"""with r as (select conv_id, turn, role, length(text) n, row_number() over (partition by conv_id order by turn) o from conversations), c as (select conv_id, count(*) turns, sum(n)::bigint chars, count(*) filter (where role = 'assistant') answers from r group by conv_id)
    select turns, count(*) conversations, sum(chars)::bigint chars, round(avg(answers / turns::double), 4) answer_share from c group by turns"""
)
def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = K.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return c.groupBy("turns").agg(F.count("*").alias("conversations"), F.sum("chars").alias("chars"), F.round(F.avg(F.col("answers") / F.col("turns")), 4).alias("answer_share"))


@query(
    """with e as (select l_suppkey % 9 e, n_regionkey p, count(*) n from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by all)
    select p profile, count(*) findings, sum(n)::bigint evidence, round(sum(n) / sum(sum(n)) over (), 6) share from e group by p"""
)
def profile_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.table(spark, sf_dir, "supplier").join(bounded_broadcast(K.table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_regionkey")
    e = K.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    e = e.groupBy((F.col("l_suppkey") % 9).alias("e"), F.col("n_regionkey").alias("profile")).agg(F.sum("n").alias("n"))
    g = e.groupBy("profile").agg(F.count("*").alias("findings"), F.sum("n").alias("evidence"))
    return g.withColumn("share", F.round(F.col("evidence") / F.sum("evidence").over(Window.partitionBy(F.lit(0))), 6))


@query(f"select source, count(*) documents, count(distinct substr(sha256(text), 1, 32)) sources, count(*) filter (where {K.sql_any('text', ('license',))}) flagged, count(*) - count(distinct substr(sha256(text), 1, 32)) <= 0.05 * count(*) consistent from documents group by source")
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.table(spark, sf_dir, "documents").select("source", F.substring(F.sha2("text", 256), 1, 32).alias("sid"), R.any_term(F.col("text"), ("license",)).alias("f"))
    g = d.groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("sid").alias("sources"), F.sum(F.col("f").cast("int")).alias("flagged"))
    return g.withColumn("consistent", F.col("documents") - F.col("sources") <= 0.05 * F.col("documents"))
