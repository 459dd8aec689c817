"""Queries over chunks in a whole pass: budgeted selection, attribution, diagnosis of failures, recovery."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.operators import chunking, classify, evidence, score, select
from corvane.plans import carriers as K
from corvane.plans.catalog import ORACLES, query
from corvane.plans.document_queries import _ASCII, _CLASS, _EXTRACTED_SQL, _QUALITY, _TERMS, _TOPICS, _extracted
from corvane.sources.scratch import dealt, scan_bytes, stash

_BUDGET = 60_000
_COMPACT = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_GARBLED = "(length(trim(text)) < 50 or length(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g')) / greatest(length(text), 1)::double < 0.70)"
_TOUCHED = K.sql_any("{x}", tuple(t for _, terms in _TOPICS for t in terms))
#: chunks with class, relevance, combined score and place in the competition for the budget
_CHUNKS_SQL = f"""ch as (select c.doc_id, c.chunk_number, d.source, {_QUALITY.replace("source", "d.source")} quality, substr(d.text, (c.start_offset + 1)::bigint, (c.end_offset - c.start_offset)::bigint) text from ({ORACLES["chunk_documents"]}) c join documents d on c.doc_id = d.doc_id),
    {_CLASS.removeprefix("with ").replace(f"d as (select doc_id, {_ASCII.format(x='text')} t from documents)", f"d as (select *, {_ASCII.format(x='text')} t from ch)")},
    cs as (select doc_id, chunk_number, source, quality, text, length(text) size, split_part(class, '/', 1) chunk_type, split_part(class, '/', 2) priority, least(100, s_numeric + s_entity + 3 * s_unit + 2 * s_policy + s_date + 2 * s_comparative) signal_strength,
      round({K.sql_hits("text", _TERMS)} / {len(_TERMS)}.0::double, 4) relevance, strength signal_score from k),
    co as (select *, case when priority <> 'skip' then relevance + case priority when 'high' then 1.0 when 'medium' then 0.5 else 0.0 end::double * 0.30::double + signal_score * 0.25::double end combined from cs),
    ro as (select doc_id, chunk_number, size, row_number() over (order by round(combined, 6) desc, doc_id, chunk_number) o from co where combined is not null),
    fo as (select list_reduce(list({{'u': size, 't': [o]}} order by o), lambda a, x: case when a.u + x.u <= {_BUDGET} then {{'u': a.u + x.u, 't': list_concat(a.t, x.t)}} else a end).t t from ro),
    se as (select doc_id, chunk_number from ro where o in (select unnest(t) from fo)),
    sc_ as (select co.*, se.doc_id is not null selected from co left join se on co.doc_id = se.doc_id and co.chunk_number = se.chunk_number)"""
_EVIDENCE_SQL = _EXTRACTED_SQL.removeprefix("with ")
#: Claims of a report, and the sentence after each.
_PER_REPORT, _FOLLOWS = 40, " This follows from the record with that plant, noted on day {n}."
_REPORTS_SQL = f"""docs_ as (select doc_id, text, source from documents union all select 1000000000 + id // {_PER_REPORT}, string_agg(claim || replace({K.quoted(_FOLLOWS)}, '{{n}}', id::varchar), ' ' order by id), 'src' || (id // {_PER_REPORT} % 7) from {K.CLAIMS_SQL} group by id // {_PER_REPORT})"""


def reported(sql: str) -> Callable:
    """A query over the documents and the reports of claims, which have numbers and units."""
    over = re.sub(r"(from|join) documents", lambda m: m[1] + " docs_", sql.removeprefix("with "))
    return query(f"with {_REPORTS_SQL}, {over}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and the claims as reports (doc_id, text, source); both are dealt to all cores, as they may be few row groups for much work."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    said = F.concat("claim", F.replace(F.lit(_FOLLOWS), F.lit("{n}"), F.col("id").cast("string")))
    c = K.claims(spark, sf_dir).withColumn("g", F.floor(F.col("id") / _PER_REPORT)).repartition(n, "g").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", said.alias("t")))).alias("l"))
    reports = c.select((1_000_000_000 + F.col("g")).alias("doc_id"), F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"), F.concat(F.lit("src"), F.col("g") % 7).alias("source"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dealt(docs.select("doc_id", "text", "source"), scan_bytes(docs), "doc_id", "text").unionByName(reports)


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with class, signals, relevance, combined score and selected, written once."""
    docs = documents(spark, sf_dir).withColumn("quality", 1 + F.substring("source", 4, 9).cast("int") % 5)
    c = classify.classified(chunking.chunks(docs, 700, 800, keep=("source", "quality")))
    c = c.withColumns({"relevance": score.chunk_relevance(F.col("chunk_text"), _TERMS), "size": F.length("chunk_text")})
    c = c.withColumn("combined", F.round(select.combined_score(F.col("relevance"), F.col("priority"), classify.signal_score(F.col("signals"))), 6))
    c = stash(c.withColumn("chunk_id", F.struct("doc_id", "chunk_number")).drop("start_offset", "end_offset"), "chunks")
    taken = select.within_budget(c.filter("combined is not null").select("doc_id", "chunk_number", "size", "combined"), [-F.col("combined"), F.col("doc_id"), F.col("chunk_number")], "size", _BUDGET)
    taken = taken.select("doc_id", "chunk_number", F.lit(True).alias("__in"))
    return c.join(taken, ["doc_id", "chunk_number"], "left").withColumn("selected", F.coalesce("__in", F.lit(False))).drop("__in", "chunk_id")


@reported(f"with {_CHUNKS_SQL} select doc_id, chunk_number, round(combined, 6) combined, row_number() over (order by doc_id, chunk_number) position from sc_ where selected")
def budget_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that fit the character budget, in reading order."""
    c = chunk_table(spark, sf_dir).filter("selected").select("doc_id", "chunk_number", "combined")
    return select.numbered(c, ["doc_id", "chunk_number"], "position", "").withColumn("position", F.col("position").cast("long"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stash(_extracted(spark, sf_dir, documents(spark, sf_dir), 3.5).select("doc_id", "ord", "snippet", "claim", "overall_score"), "evidence")


_ITEMS_SQL = f"""ev as materialized (select doc_id, ord, snippet from (with {_EVIDENCE_SQL} select * from overall) where overall_score >= 3.5),
    hit as (select e.doc_id, e.ord, min(c.chunk_number) chunk_number from ev e join cs c on e.doc_id = c.doc_id and contains(c.text, left(trim(e.snippet), 200)) group by all),
    ni as (select doc_id, chunk_number, count(*) n from hit group by all),
    it as (select sc_.*, coalesce(ni.n, 0) items from sc_ left join ni on sc_.doc_id = ni.doc_id and sc_.chunk_number = ni.chunk_number)"""
_DIAGNOSED_SQL = f"""fa as (select * from it where items = 0 and chunk_type = 'evidence_dense'), de as (select doc_id, count(*) n from ev group by doc_id),
    ma as (select distinct f.doc_id, f.chunk_number from fa f join ev e on f.doc_id = e.doc_id and {_COMPACT.format(x="left(trim(e.snippet), 300)")} <> '' and contains({_COMPACT.format(x="f.text")}, {_COMPACT.format(x="left(trim(e.snippet), 300)")})),
    di as (select f.*, coalesce(de.n, 0) doc_items, ma.doc_id is not null snippet_match from fa f left join de on f.doc_id = de.doc_id left join ma on f.doc_id = ma.doc_id and f.chunk_number = ma.chunk_number),
    st as (select *, case when not selected then 'BUDGET_EXCLUSION' when {_GARBLED} then 'PARSER_FAILURE' when doc_items > 0 and snippet_match then 'ATTRIBUTION_FAILURE' when doc_items > 0 then 'CROSS_CHUNK'
      when not {_TOUCHED.replace("{x}", "text")} then 'EMPTY_EXTRACTION' else 'DUPLICATE_SUPPRESSION' end stage from di),
    fd_ as (select *, case stage {" ".join(f"when {K.quoted(k)} then {K.quoted(v)}" for k, v in evidence.FAILURE_REASONS.items())} end reason,
      len(list_filter({K.SENTENCES_SQL.format(x=_COMPACT.format(x="text"))}, lambda s: {_TOUCHED.replace("{x}", "s")})) parsed from st)"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, e = chunk_table(spark, sf_dir), _evidence(spark, sf_dir)
    return evidence.chunk_items(c, evidence.attributed(e, c.select("doc_id", "chunk_number", "chunk_text"))), e


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = _items(spark, sf_dir)
    return evidence.failures(c, e, _TOPICS)


@reported(f"with {_CHUNKS_SQL}, {_ITEMS_SQL} select e.doc_id, e.ord, hit.chunk_number from ev e left join hit on e.doc_id = hit.doc_id and e.ord = hit.ord")
def evidence_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with the first of its document's chunks that holds it."""
    c = chunk_table(spark, sf_dir)
    return evidence.attributed(_evidence(spark, sf_dir), c.select("doc_id", "chunk_number", "chunk_text")).select("doc_id", "ord", "chunk_number")


@reported(f"with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_DIAGNOSED_SQL} select doc_id, chunk_number, doc_items, snippet_match, stage, reason, signal_strength, parsed from fd_")
def failure_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).select("doc_id", "chunk_number", "doc_items", "snippet_match", "stage", "reason", "signal_strength", "parsed")


#: what an extractor reports on chunks, by their numbers: called, raw, valid, clean
_REPORT = lambda k: {"called": f"{k} % 13 < 6", "raw_items": f"case when {k} % 13 > 0 then 3 end", "valid_items": f"case when {k} % 13 = 1 then 0 else 2 end", "clean_items": f"case when {k} % 13 = 2 then 0 else {k} % 13 % 2 end", "lost": f"{k} % 17 = 0"}
_ALL_STAGES_SQL = _DIAGNOSED_SQL.replace("st as (select *, case when not selected", """rp_ as (select *, """ + ", ".join(f"{v} {n}" for n, v in _REPORT("(doc_id + chunk_number)").items()) + """ from di),
    st as (select *, case when lost then 'UNKNOWN' when not selected""").replace("then 'PARSER_FAILURE' when doc_items", """then 'PARSER_FAILURE' when called and raw_items is null then 'NO_LLM_OUTPUT' when called and raw_items > 0 and valid_items = 0 then 'SCHEMA_VALIDATION_FAILURE'
      when called and valid_items > 0 and clean_items = 0 then 'POST_PROCESSING_REJECTION' when called and clean_items > 0 then 'QUALITY_THRESHOLD_REJECTION' when doc_items""").replace("end stage from di)", "end stage from rp_)").replace("parsed from st)", "parsed from st where true)")


@reported(f"with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_ALL_STAGES_SQL} select doc_id, chunk_number, stage, reason, signal_strength from fd_")
def failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages at which chunks lose their evidence, with what an extractor reported."""
    c, e = _items(spark, sf_dir)
    said = _REPORT("(doc_id + chunk_number)")
    failed = evidence.failures(c, e, _TOPICS).select("doc_id", "chunk_number", "chunk_text", "selected", "doc_items", "snippet_match", "signal_strength")
    failed = failed.withColumns({n: F.expr(v) for n, v in said.items()}).withColumn("chunk_text", F.when(~F.col("lost"), F.col("chunk_text")))
    return evidence.failure_stage(failed, _TOPICS).select("doc_id", "chunk_number", "stage", "reason", "signal_strength")


@reported(f"with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_DIAGNOSED_SQL}, al(stage) as (values {', '.join(f'({K.quoted(x)})' for x in evidence.FAILURE_STAGES)}) select al.stage, count(f.stage) n from al left join fd_ f on al.stage = f.stage group by al.stage")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.failure_summary(_diagnosed(spark, sf_dir))


@reported(f"with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_DIAGNOSED_SQL} select doc_id, chunk_number, signal_strength, stage, relevance from fd_ order by signal_strength desc, doc_id, chunk_number limit 10")
def top_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.top_missed(_diagnosed(spark, sf_dir)).select("doc_id", "chunk_number", "signal_strength", "stage", "relevance")


@reported(
    f"""with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_DIAGNOSED_SQL}, ss as (select doc_id, stage, count(*) n from fd_ group by all), rr as (select doc_id, reason, count(*) n from fd_ group by all)
    select a.doc_id, a.stage top_stage, (select sum(n) from ss x where x.doc_id = a.doc_id)::bigint failed_chunks, b.reason top_reason
    from (select *, row_number() over (partition by doc_id order by n desc, stage) r from ss) a join (select *, row_number() over (partition by doc_id order by n desc, reason) r from rr) b on a.doc_id = b.doc_id and a.r = 1 and b.r = 1"""
)
def document_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.document_failures(_diagnosed(spark, sf_dir))


_RECOVERED_SQL = f"""el as (select * from it where selected and items = 0 and chunk_type = 'evidence_dense' and relevance >= 0.3),
    rp as (select doc_id, chunk_number, quality, unnest(a) sentence, generate_subscripts(a, 1) pos from (select doc_id, chunk_number, quality, list_filter({K.SENTENCES_SQL.format(x=_COMPACT.format(x="text"))}, lambda s: length(s) >= 40) a from el)),
    rr_ as (select *, {K.sql_first_pattern(_ASCII.format(x="sentence"), L.RECOVERY_REASONS, "other")} reason from rp),
    rf as (select *, row_number() over (partition by doc_id, chunk_number, substr(sentence, 1, 100) order by pos) d from rr_ where reason <> 'other'),
    rn as (select *, row_number() over (partition by doc_id, chunk_number order by pos) n, substr(sentence, 1, 500) snippet, {K.sql_first_terms("substr(sentence, 1, 500)", L.CATEGORY_LADDER, "other")} category from rf where d = 1)"""


@reported(f"with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_RECOVERED_SQL} select el.doc_id, el.chunk_number, el.relevance, (select count(*) from rn where rn.doc_id = el.doc_id and rn.chunk_number = el.chunk_number and n <= 4) recovered_evidence_count from el")
def recovery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the recovery pass reads again, with what it finds in each."""
    c, _ = _items(spark, sf_dir)
    return evidence.recovery_pass(c, _TERMS, ("power",))[1].select("doc_id", "chunk_number", "relevance", "recovered_evidence_count")


@reported(f"with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_RECOVERED_SQL} select doc_id, chunk_number, n, reason, md5(snippet) digest from rn where n <= 4")
def recovery_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the recovery pass finds, whatever its score."""
    c, _ = _items(spark, sf_dir)
    kept, _, _ = evidence.recovery_pass(c, _TERMS, ("power",), least_score=0.0)
    return kept.select("doc_id", "chunk_number", "n", "reason", F.md5(F.col("snippet").cast("binary")).alias("digest"))


#: what the recovery pass finds, scored like other evidence; ord is the chunk's number and the place in it
_SCORED_SQL = f"""rq as (with capped as (select doc_id, 10 * chunk_number + n as ord, category, snippet from rn where n <= 4), {re.sub(r"where not regexp_matches.*?'[)][)],", "),", _EXTRACTED_SQL[_EXTRACTED_SQL.index("said as"):], count=1, flags=re.DOTALL)} select doc_id, ord // 10 chunk_number, ord % 10 n, claim, overall_score from overall)"""


@reported(
    f"""with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_RECOVERED_SQL}, {_SCORED_SQL}, cn as (select el.doc_id, el.chunk_number, count(rn.n) filter (where rn.n <= 4) c from el left join rn on el.doc_id = rn.doc_id and el.chunk_number = rn.chunk_number group by all),
    kc as (select doc_id, chunk_number, count(*) k from rq where overall_score >= 3.5 group by all), af as (select it.items, coalesce(k, 0) k from it left join kc on it.doc_id = kc.doc_id and it.chunk_number = kc.chunk_number), e as (select (select count(*) from el) n, (select count(*) from rq where overall_score >= 3.5) kept)
    select n eligible_chunks, (select count(*) from cn where c > 0) chunks_recovered, kept recovered_evidence_items, (select count(*) from it where selected) chunks_selected, (select count(*) from it where items > 0) with_evidence_before, (select count(*) from af where items + k > 0) with_evidence_after,
    (select sum(items)::bigint from it) items_before, (select sum(items + k)::bigint from af) items_after, case when n > 0 then round(kept / n::double, 3) else 0.0 end recovery_yield from e"""
)
def recovery_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yield before and after the recovery pass."""
    c, _ = _items(spark, sf_dir)
    return evidence.recovery_pass(c, _TERMS, ("power",))[2]


@reported(
    f"""with {_CHUNKS_SQL}, {_ITEMS_SQL}, {_RECOVERED_SQL}, {_SCORED_SQL}, ol as (select doc_id, ord, claim, overall_score from (with {_EVIDENCE_SQL} select * from overall) where overall_score >= 3.5),
    un as (select false recovered, doc_id, ord, claim, overall_score from ol union all select true, doc_id, 10 * chunk_number + n, claim, overall_score from rq where overall_score >= 3.5)
    select 'E' || case when r < 1000 then lpad(r::varchar, 3, '0') else r::varchar end evidence_id, recovered, doc_id, ord, md5(claim) claim, overall_score from (select *, row_number() over (order by recovered, doc_id, ord) r from un)"""
)
def recovered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with what recovery keeps: the latter continues the numbering."""
    c, e = _items(spark, sf_dir)
    kept = evidence.recovery_pass(c, _TERMS, ("power",))[0].withColumn("ord", (10 * F.col("chunk_number") + F.col("n")).cast("long"))
    found = evidence.with_recovered(e.withColumn("ord", F.col("ord").cast("long")), kept, ["doc_id", "ord"])
    return found.select("evidence_id", "recovered", "doc_id", "ord", F.md5(F.col("claim").cast("binary")).alias("claim"), "overall_score")


#: chunks as documents for the counts of a run
@reported(
    f"""with {_CHUNKS_SQL}, {_ITEMS_SQL} select count(*) chunks_total, count(*) filter (where selected) chunks_selected, count(*) filter (where items > 0) chunks_with_evidence, sum(items)::bigint evidence_items, count(*) filter (where priority = 'skip') skipped_boilerplate,
    count(*) - count(*) filter (where items > 0) zero_evidence_chunks, greatest(0, count(*) filter (where selected) - count(*) filter (where items > 0)) zero_evidence_selected,
    round(sum(items) / (count(*) filter (where selected))::double, 3) yield_per_selected, round(sum(items) / count(*)::double, 3) yield_per_total from it"""
)
def chunk_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.yield_metrics(_items(spark, sf_dir)[0])


@reported(f"with {_CHUNKS_SQL} select doc_id, chunk_number from sc_ where combined is not null and not selected")
def rejected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that competed for the budget and were not selected."""
    c = chunk_table(spark, sf_dir).filter("combined is not null")
    return select.rejected(c, c.filter("selected"), ["doc_id", "chunk_number"]).select("doc_id", "chunk_number")
