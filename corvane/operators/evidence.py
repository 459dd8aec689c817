"""Evidence: extraction from documents, store records, attribution, recovery, diagnostics."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import chunking, classify, score, select, terms
from corvane.sources.scratch import bounded_broadcast, stash


def extracted(docs: DataFrame, terms: Sequence[str], groups: Sequence[tuple[str, Sequence[str]]] = L.TOPICS, per_doc: int = 20, least: int = 4, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (), may_score: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Evidence of documents: topic sentences, at most per_doc; documents with fewer than least get plain snippets too.

    (key, keep, ord, category, snippet, claim, relevance, confidence), distinct in (category, snippet).  One narrow pass.
    With may_score only items that it holds for (by keep, category, snippet) are made; ord counts the others too."""
    item = lambda category: lambda x: F.struct(category(x).alias("category"), x.alias("snippet"))
    # blank texts give no items; a filter on the compacted text would compact every text twice
    d = docs.filter(F.col(text) != "").select(key, *keep, T.compact(F.col(text)).alias("__t"))
    d = d.select(key, *keep, "__t", F.explode(F.array(chunking.topic_lists(F.col("__t"), groups))).alias("__l"))
    of_topics = F.flatten(F.array(*[F.transform(F.get("__l", i)["snippets"], item(lambda x, name=name: F.lit(name))) for i, (name, _) in enumerate(groups)]))
    plain = F.transform(chunking.snippet_list(F.col("__t"), least, 12), item(classify.category))
    every = R.bound(of_topics, lambda s: F.when(F.size(s) < least, F.concat(s, plain)).otherwise(s))
    rows = d.select(key, *keep, F.posexplode(F.slice(F.array_distinct(every), 1, per_doc)).alias("__o", "__r"))
    rows = rows.select(key, *keep, (F.col("__o") + 1).alias("ord"), "__r.category", "__r.snippet")
    rows = rows if may_score is None else rows.filter(may_score(rows))
    rows = R.once(rows, "claim", T.claim_text(F.col("snippet"), F.col("category")))
    hits = R.term_hits(F.col("snippet"), terms)
    return rows.select(
        key,
        *keep,
        "ord",
        classify.normal_category(F.col("category")).alias("category"),
        "snippet",
        "claim",
        T.relevance(F.col("snippet"), terms, hits).alias("relevance"),
        T.confidence(F.col("snippet"), hits).alias("confidence"),
    )


def may_score(terms: Sequence[str], topics: Sequence[str], least: float, quality: str = "quality") -> Callable[[DataFrame], Column]:
    """For extracted: whether an item may score at least so much overall, told from its snippet, category and quality before its texts are made.

    A run of ASCII letters and digits in a claim or a relevance stands in the snippet, the category or the fixed words around them,
    so the longest run of a term has to; digits are in a claim only if they are in the snippet or the category."""

    def hits(low: Column, sought: Sequence[str], fixed: Sequence[str]) -> Column:
        runs = [max(re.findall("[a-z0-9]+", t.lower()), key=len, default="") for t in sought]
        return sum((F.lit(1) if any(r in f.lower() for f in fixed) else F.contains(low, F.lit(r)).cast("int") for r in runs), F.lit(0))

    def worth(rows: DataFrame) -> Column:
        category, n_chars = classify.normal_category(F.col("category")), F.length("snippet")
        on_topic = category.isin(*topics)
        reaches = lambda r, spec, quant: score.overall_score(r, F.col(quality), F.lit(spec) if isinstance(spec, int) else spec, F.lit(quant)) >= least
        relevance = lambda n: F.when((n >= 4) | (on_topic & (n >= 2)), 5).when((n >= 2) | on_topic, 4).otherwise(3)
        plain = lambda s: F.when(s >= 5, 5).when(s >= 3, 4).when((s >= 1) | (n_chars >= 140), 3).when(n_chars >= 60, 2).otherwise(1)

        def by(low: Column) -> Column:
            words = lambda r: R.bound(hits(low, L.SPECIFIC_TERMS, ("note",)), lambda s: reaches(r, plain(s), 1))
            return R.bound(R.bound(hits(low, terms, ("note", *T.RELEVANCE)), relevance), lambda r: F.when(~reaches(r, 5, 5), False).when(low.rlike("[0-9]"), True).when(~reaches(r, 5, 1), False).otherwise(words(r)))

        return R.bound(F.lower(F.concat_ws(" ", F.col("snippet"), T.capitalised(F.col("category")), category)), by)

    return worth


def scored(evidence: DataFrame, terms: Sequence[str], topics: Sequence[str], quality: str = "quality", least: float | None = None) -> DataFrame:
    """Evidence (claim, snippet, category, relevance, quality) with its four scores and the overall one; with least, what scores
    at least so much: a row is dropped as soon as the best of the scores that are left would not suffice."""
    both = F.concat_ws(" ", "claim", "snippet")
    hay = F.lower(F.concat_ws(" ", "claim", "snippet", "category", "relevance"))
    made = {
        "relevance_score": score.relevance_score(hay, F.col("category"), terms, topics),
        "specificity_score": score.specificity_score(both, F.col("snippet")),
        "quantitative_score": score.quantitative_score(both),
    }
    overall = lambda have: score.overall_score(*[F.col(n) if n in have else F.lit(5) for n in ("relevance_score", quality, "specificity_score", "quantitative_score")])
    e = evidence if least is not None else evidence.withColumns(made)
    if least is not None:
        for n, value in made.items():
            e = R.once(e, n, value)
            e = e.filter(overall(e.columns) >= least)
    e = R.once(e, "overall_score", overall(e.columns))
    return e if least is None else e.filter(F.col("overall_score") >= least)


def enriched(evidence: DataFrame, claim: str = "claim", name: str = "source") -> DataFrame:
    """Evidence type, topics and perspective, where they are not set yet."""
    have = set(evidence.columns)
    made = {
        "evidence_type": classify.evidence_type(F.col(claim)),
        "topics": classify.topics(F.col(claim)),
        "perspective": classify.perspective(F.col(claim), classify.domain(F.col(name))),
    }
    empty = lambda c: F.size(c) == 0 if c == "topics" else F.coalesce(F.col(c), F.lit("")) == ""
    return evidence.withColumns({c: F.when(empty(c), v).otherwise(F.col(c)) if c in have else v for c, v in made.items()})


def sanitised(evidence: DataFrame, claim: str = "claim") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): claims that compare across documents are rejected."""
    e = R.once(evidence, "__local", classify.source_local(F.col(claim)))
    return e.filter("__local").drop("__local"), e.filter(~F.col("__local")).drop("__local")


def new_statements(batch: DataFrame, stored: DataFrame, statement: str = "statement", order: str = "ord") -> DataFrame:
    """Rows of a batch whose statement is not stored; the first of equal ones."""
    b = batch.withColumn("fingerprint", T.fingerprint(F.col(statement)))
    first = b.withColumn("__rn", F.row_number().over(Window.partitionBy("fingerprint").orderBy(order))).filter("__rn = 1").drop("__rn")
    return first.join(stored.select("fingerprint").distinct(), "fingerprint", "left_anti")


def store_metadata(evidence: DataFrame) -> DataFrame:
    """Store record of evidence: confidence value, mean score, credibility and retrieval defaults by type."""
    conf = F.when(F.col("confidence") == "high", 0.85).when(F.col("confidence") == "medium", 0.60).otherwise(0.35)
    q = F.col("quality")
    e = evidence.withColumn("store_type", classify.store_type(F.col("claim"), F.col("category")))
    return e.withColumns({
        "confidence_value": conf,
        "overall": score.store_overall(F.col("relevance_score"), q, F.col("specificity_score")),
        "credibility": F.when(q >= 4, "HIGH").when(q <= 2, "LOW").otherwise("MEDIUM"),
        "defaults": classify.retrieval_defaults(F.col("store_type")),
    })


def attributed(evidence: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Evidence with the number of the first chunk of its document that holds its snippet's first 200 characters."""
    e, c = evidence.alias("e"), chunks.select(F.col(doc).alias("__d"), "chunk_number", "chunk_text").alias("c")
    on = (F.col(f"e.{doc}") == F.col("c.__d")) & F.contains("c.chunk_text", F.left(F.trim("e.snippet"), F.lit(200)))
    hit = e.join(c, on).groupBy(F.col(f"e.{doc}").alias(doc), F.col("e.ord").alias("ord")).agg(F.min("c.chunk_number").alias("chunk_number"))
    return evidence.join(hit, [doc, "ord"], "left")


def chunk_items(chunks: DataFrame, attributed_evidence: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks with items, the evidence attributed to them."""
    n = attributed_evidence.filter("chunk_number is not null").groupBy(doc, "chunk_number").agg(F.count("*").alias("__n"))
    return chunks.join(n, [doc, "chunk_number"], "left").withColumn("items", F.coalesce("__n", F.lit(0))).drop("__n")


def recovery_eligible(chunks: DataFrame, least: float = 0.3) -> DataFrame:
    """Selected evidence-dense chunks (selected, chunk_type, relevance, items) without evidence."""
    return chunks.filter(F.col("selected") & (F.col("items") == 0) & (F.col("chunk_type") == "evidence_dense") & (F.col("relevance") >= least))


def recovery_pass(chunks: DataFrame, terms: Sequence[str], topics: Sequence[str], least_score: float = 3.5, quality: str = "quality") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, queue, metrics): recovered evidence with an overall score of at least so much; eligible chunks with what was
    found in each; one row of metrics with the yield before and after.

    chunks: doc_id, chunk_number, chunk_text, quality, selected, chunk_type, relevance and items."""
    keys = ["doc_id", "chunk_number"]
    eligible = recovery_eligible(chunks)
    raw = recovered(eligible.select(*keys, T.compact(F.col("chunk_text")).alias("chunk_text"), quality), keys=(*keys, quality)).withColumn("snippet", F.left("sentence", F.lit(500)))
    category = classify.normal_category(classify.category(F.col("snippet")))
    hits = R.term_hits(F.col("snippet"), terms)
    raw = raw.withColumn("category", category)
    raw = raw.withColumns({"claim": T.claim_text(F.col("snippet"), F.col("category")), "relevance": T.relevance(F.col("snippet"), terms, hits), "confidence": T.confidence(F.col("snippet"), hits)})
    raw = stash(scored(raw, terms, topics, quality).drop("sentence", "pos"), "recovered")
    kept = raw.filter(F.col("overall_score") >= least_score)
    per = raw.groupBy(*keys).agg(F.count("*").alias("recovered_evidence_count"))
    queue = eligible.join(per, keys, "left").withColumn("recovered_evidence_count", F.coalesce("recovered_evidence_count", F.lit(0)))
    now = kept.groupBy(*keys).agg(F.count("*").alias("__k"))
    both = chunks.join(per, keys, "left").join(now, keys, "left").withColumn("__e", F.col("selected") & (F.col("items") == 0) & (F.col("chunk_type") == "evidence_dense") & (F.col("relevance") >= 0.3))
    after = F.col("items") + F.coalesce("__k", F.lit(0))
    count = lambda c: F.count_if(c)
    m = both.agg(
        count(F.col("__e")).alias("eligible_chunks"),
        count(F.col("recovered_evidence_count") > 0).alias("chunks_recovered"),
        F.coalesce(F.sum("__k"), F.lit(0)).alias("recovered_evidence_items"),
        count(F.col("selected")).alias("chunks_selected"),
        count(F.col("items") > 0).alias("with_evidence_before"),
        count(after > 0).alias("with_evidence_after"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items_before"),
        F.coalesce(F.sum(after), F.lit(0)).alias("items_after"),
    )
    share = F.when(F.col("eligible_chunks") > 0, F.round(F.col("recovered_evidence_items") / F.col("eligible_chunks"), 3)).otherwise(0.0)
    return kept, queue, m.withColumn("recovery_yield", share)


def with_recovered(evidence: DataFrame, kept: DataFrame, order: Sequence[str]) -> DataFrame:
    """Evidence and what a recovery pass kept, with recovered and evidence_id: the recovered continue the numbering."""
    both = evidence.withColumn("recovered", F.lit(False)).unionByName(kept.withColumn("recovered", F.lit(True)), allowMissingColumns=True)
    return select.numbered(both, ["recovered", *order], "evidence_id", "E")


def recovered(chunks: DataFrame, text: str = "chunk_text", keys: Sequence[str] = ("doc_id", "chunk_number"), most: int = 4) -> DataFrame:
    """Signal sentences of chunks: at most so many each, distinct in 100 characters."""
    s = chunks.select(*keys, F.posexplode(T.sentences(F.col(text), 40)).alias("pos", "sentence"))
    s = s.withColumn("reason", classify.recovery_reason(F.col("sentence"))).filter("reason <> 'other'")
    w = Window.partitionBy(*keys, F.left("sentence", F.lit(100))).orderBy("pos")
    s = s.withColumn("__d", F.row_number().over(w)).filter("__d = 1")
    return s.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).filter(F.col("n") <= most).drop("__d")


def yield_metrics(chunks: DataFrame) -> DataFrame:
    """One row from chunks (selected, priority, items)."""
    m = chunks.agg(
        F.count("*").alias("chunks_total"),
        F.count_if("selected").alias("chunks_selected"),
        F.count_if(F.col("items") > 0).alias("chunks_with_evidence"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("evidence_items"),
        F.count_if(F.col("priority") == "skip").alias("skipped_boilerplate"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3)).otherwise(0.0)
    return m.withColumns({
        "zero_evidence_chunks": F.col("chunks_total") - F.col("chunks_with_evidence"),
        "zero_evidence_selected": F.greatest(F.lit(0), F.col("chunks_selected") - F.col("chunks_with_evidence")),
        "yield_per_selected": share("evidence_items", "chunks_selected"),
        "yield_per_total": share("evidence_items", "chunks_total"),
    })


def chunk_decisions(chunks: DataFrame) -> DataFrame:
    """Decision and reason of chunks (selected, priority, relevance, items)."""
    decision = F.when(~F.col("selected"), "not_sent").when(F.col("items") > 0, "accepted").otherwise("rejected")
    reason = (
        F.when(F.col("selected") & (F.col("items") > 0), F.lit(None))
        .when(F.col("selected"), "no evidence extracted")
        .when(F.col("priority") == "skip", "skipped")
        .when(F.col("relevance") == 0, "not relevant to question")
        .otherwise("excluded by character budget")
    )
    return chunks.withColumns({"decision": decision, "reason": reason})


#: Stages in the order of the summary.
FAILURE_STAGES = (
    "NO_LLM_OUTPUT", "EMPTY_EXTRACTION", "PARSER_FAILURE", "SCHEMA_VALIDATION_FAILURE", "QUALITY_THRESHOLD_REJECTION", "DUPLICATE_SUPPRESSION",
    "POST_PROCESSING_REJECTION", "UNKNOWN", "ATTRIBUTION_FAILURE", "CROSS_CHUNK", "BUDGET_EXCLUSION",
)
#: Why a chunk is held to have failed at a stage.
FAILURE_REASONS = {
    "BUDGET_EXCLUSION": "not selected: the character budget was spent",
    "PARSER_FAILURE": "garbled or nearly empty text",
    "SCHEMA_VALIDATION_FAILURE": "items were found, none had the fields of evidence",
    "NO_LLM_OUTPUT": "the extractor was called and gave nothing",
    "POST_PROCESSING_REJECTION": "all valid items were sanitised away",
    "QUALITY_THRESHOLD_REJECTION": "all items scored below the threshold",
    "ATTRIBUTION_FAILURE": "a snippet is in the chunk once blanks are normalised",
    "CROSS_CHUNK": "the document's evidence comes from other chunks",
    "EMPTY_EXTRACTION": "no topic keyword in the chunk",
    "DUPLICATE_SUPPRESSION": "topic keywords, but no item: a duplicate or beyond the document's cap",
    "UNKNOWN": "no text for this chunk",
}


def failure_stage(chunks: DataFrame, groups: Sequence[tuple[str, Sequence[str]]] = L.TOPICS) -> DataFrame:
    """Chunks without evidence with the stage at which they lost it, and the reason.

    chunks: selected, chunk_text, doc_items, snippet_match; where an extractor reported on a chunk also called (it was
    asked), raw_items, valid_items, clean_items (after sanitising): null where it did not."""
    touched = F.size(R.labels(F.col("chunk_text"), groups)) > 0
    stage = F.when(F.col("chunk_text").isNull(), "UNKNOWN").when(~F.col("selected"), "BUDGET_EXCLUSION").when(T.garbled(F.col("chunk_text")), "PARSER_FAILURE")
    if "called" in chunks.columns:
        asked = F.coalesce("called", F.lit(False))
        stage = (
            stage.when(asked & F.col("raw_items").isNull(), "NO_LLM_OUTPUT")
            .when(asked & (F.col("raw_items") > 0) & (F.col("valid_items") == 0), "SCHEMA_VALIDATION_FAILURE")
            .when(asked & (F.col("valid_items") > 0) & (F.col("clean_items") == 0), "POST_PROCESSING_REJECTION")
            .when(asked & (F.col("clean_items") > 0), "QUALITY_THRESHOLD_REJECTION")
        )
    stage = (
        stage.when((F.col("doc_items") > 0) & F.col("snippet_match"), "ATTRIBUTION_FAILURE")
        .when(F.col("doc_items") > 0, "CROSS_CHUNK")
        .when(~touched, "EMPTY_EXTRACTION")
        .otherwise("DUPLICATE_SUPPRESSION")
    )
    reasons = F.create_map(*[F.lit(x) for kv in FAILURE_REASONS.items() for x in kv])
    return chunks.withColumn("stage", stage).withColumn("reason", F.element_at(reasons, F.col("stage")))


def failures(chunks: DataFrame, evidence: DataFrame, groups: Sequence[tuple[str, Sequence[str]]] = L.TOPICS) -> DataFrame:
    """Diagnosis of every evidence-dense chunk without items: doc_items, snippet_match, stage, reason, signal_strength and
    parsed, its sentences with a topic keyword.

    chunks: doc_id, chunk_number, chunk_text, signals, selected, chunk_type, items; evidence: doc_id, snippet."""
    failed = chunks.filter((F.col("items") == 0) & (F.col("chunk_type") == "evidence_dense"))
    per = evidence.groupBy("doc_id").agg(F.count("*").alias("doc_items"))
    snippet = T.compact(F.left(F.trim("snippet"), F.lit(300)))
    e = evidence.select(F.col("doc_id").alias("__d"), snippet.alias("__s")).filter("__s <> ''")
    c = failed.select("doc_id", "chunk_number", T.compact(F.col("chunk_text")).alias("__t"))
    match = c.join(e, (F.col("doc_id") == F.col("__d")) & F.contains("__t", F.col("__s"))).select("doc_id", "chunk_number").distinct().withColumn("snippet_match", F.lit(True))
    j = failed.join(per, "doc_id", "left").join(match, ["doc_id", "chunk_number"], "left")
    j = j.withColumns({"doc_items": F.coalesce("doc_items", F.lit(0)), "snippet_match": F.coalesce("snippet_match", F.lit(False)), "signal_strength": score.signal_strength(F.col("signals"))})
    parsed = F.size(F.filter(T.sentences(T.compact(F.col("chunk_text")), compacted=True), lambda s: F.size(R.labels(s, groups)) > 0))
    return failure_stage(j, groups).withColumn("parsed", parsed)


def failure_summary(failed: DataFrame) -> DataFrame:
    """Chunks by stage, with a zero for stages that did not occur."""
    stages = failed.sparkSession.createDataFrame([(s,) for s in FAILURE_STAGES], "stage string")
    return stages.join(failed.groupBy("stage").agg(F.count("*").alias("n")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def top_missed(failed: DataFrame, k: int = 10, keys: Sequence[str] = ("doc_id", "chunk_number")) -> DataFrame:
    """The diagnosed chunks of strongest signals."""
    return failed.orderBy(F.desc("signal_strength"), *keys).limit(k)


def document_failures(failed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Failures of every document, its most frequent stage and reason; of equally frequent ones the first by name."""
    by = lambda c: failed.groupBy(doc, c).agg(F.count("*").alias("n")).groupBy(doc).agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(f"top_{c}"), F.sum("n").alias(f"n_{c}"))
    return by("stage").join(by("reason").drop("n_reason"), doc).withColumnRenamed("n_stage", "failed_chunks")


def coverage(evidence: DataFrame, topics: DataFrame, source: str = "source", text: str = "snippet") -> DataFrame:
    """Coverage of every topic (topic, terms array): items, sources, mean quality of the sources, level.

    Rows are matched with all topics at once and counted before the shuffle."""
    e = evidence.select(F.col(source).alias("__s"), F.col("quality").alias("__q"), F.col(text).alias("__t"))
    hits = terms.labelled(e, "__t", topics.select("topic", F.explode("terms").alias("term")), label="topic", out="__l")
    hits = hits.select(F.explode("__l").alias("topic"), "__s", "__q")
    per = hits.groupBy("topic", "__s").agg(F.count("*").alias("n"), F.max("__q").alias("q"))
    per = per.groupBy("topic").agg(F.sum("n").alias("n"), F.count("*").alias("sources"), F.avg("q").alias("q"))
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("sources", F.lit(0))
    quality = F.round(F.coalesce("q", F.lit(3.0)), 4)
    return topics.select("topic").join(per, "topic", "left").select("topic", n.alias("evidence_count"), s.alias("source_count"), quality.alias("avg_quality"), score.coverage_level(n, s).alias("level"))


def gaps(evidence: DataFrame, topics: DataFrame, text: str = "snippet") -> DataFrame:
    """Topics (topic, terms, priority) that no evidence touches, most urgent first, then by name; place is that order."""
    found = terms.labelled(evidence.select(F.col(text).alias("__t")), "__t", topics.select("topic", F.explode("terms").alias("term")), label="topic", out="__l")
    left = topics.join(found.select(F.explode("__l").alias("topic")).distinct(), "topic", "left_anti")
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    ranked = select.numbered(left.select("topic", "priority", order.alias("urgency")), [F.col("urgency"), F.col("topic")], "place", "")
    return ranked.withColumn("place", F.col("place").cast("long")).orderBy("place")


def cited(claim: Column, source: Column, evidence_id: Column) -> Column:
    """A claim with its citation."""
    return F.concat(claim, F.lit(" [Source: "), source, F.lit(", Evidence: "), F.coalesce(F.nullif(evidence_id, F.lit("")), F.lit("unknown")), F.lit("]"))


def implications(evidence: DataFrame, group: Column, order: Sequence[Column | str], most: int = 3) -> DataFrame:
    """(section, place, text): of every section the first claims with their citations; rows of a null section drop out.

    evidence: claim, source, evidence_id."""
    e = evidence.withColumn("section", group).filter("section is not null")
    e = e.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).filter(F.col("place") <= most)
    return e.select("section", "place", cited(F.col("claim"), F.col("source"), F.col("evidence_id")).alias("text"))


def candidate_pool(evidence: DataFrame) -> DataFrame:
    """Candidates before ranking, under the names of a pool."""
    return evidence.select("claim", "category", F.col("snippet").alias("supporting_quote"), "source", "confidence", "relevance_score", F.col("quality").alias("source_quality_score"), "specificity_score", "quantitative_score", F.col("overall_score").alias("candidate_score"))


def ranking_counts(candidates: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """One row: candidates, those selected, those discarded."""
    hit = selected.select(key).distinct().withColumn("__s", F.lit(True))
    c = candidates.select(key).join(hit, key, "left").agg(F.count("*").alias("candidate_count"), F.count("__s").alias("selected_count"))
    return c.withColumn("discarded_count", F.col("candidate_count") - F.col("selected_count"))


def run_trace(documents: DataFrame, chunks: DataFrame, evidence: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: chunks, selected chunks, evidence and its best score, and its rank by evidence, then by name."""
    c = chunks.groupBy(doc).agg(F.count("*").alias("chunks"), F.count_if("selected").alias("chunks_selected"))
    e = evidence.groupBy(doc).agg(F.count("*").alias("evidence"), F.max("overall_score").alias("best_score"))
    t = documents.select(doc).join(c, doc, "left").join(e, doc, "left").fillna(0, ["chunks", "chunks_selected", "evidence"])
    return select.numbered(t, [-F.col("evidence"), F.col(doc)], "rank", "").withColumn("rank", F.col("rank").cast("long"))


def reason_histogram(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Reasons by how often they occur, the most frequent first."""
    return rows.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def synonyms(terms: DataFrame, registry: DataFrame) -> DataFrame:
    """(term, canonical, entry): terms by the registry's canonical spelling, found as itself or as a synonym, whatever its case.

    registry: canonical, synonyms array, entry; a vocabulary."""
    r = registry.select("canonical", "entry", F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical"), "synonyms"), F.lower))).alias("__t"))
    r = r.groupBy("__t").agg(F.min_by(F.struct("canonical", "entry"), "canonical").alias("r"))
    return terms.select("term").join(bounded_broadcast(r), F.lower(F.trim("term")) == F.col("__t"), "left").select("term", "r.canonical", "r.entry")
