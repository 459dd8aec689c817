"""Engagements and decision models as tables, and the comparison of two extractions.

An engagement is a row of texts and lists, read from records or made from a question; a decision model is made from the framing of a
question.  Ids are made of a stamp that the caller gives and the row's number, so that a rerun gives the same ones.  Links are
appended without repetition, in their order.

Cases: missing texts are '', missing lists empty; an engagement without content, or with a field that is not known, is an
error; links of unknown engagements are left out; null links are none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import select
from corvane.sources import records

TEXTS = ("title", "client", "industry", "current_situation", "decision_horizon")
LISTS = ("objectives", "constraints", "stakeholders", "assumptions", "success_criteria", "priorities", "risks", "known_unknowns")
#: Fields whose absence is noted.
IMPORTANT = ("title", "current_situation", "objectives")


def engagements(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(engagements, errors) of records; an engagement may stand under a key of that name.  missing: important fields without content."""
    inner = F.get_json_object("body", "$.engagement")
    good = found.filter("error is null").withColumn("body", F.when(inner.startswith("{"), inner).otherwise(F.col("body")))
    listed = {n: records.plain_list(n) for n in LISTS}
    e = good.select("path", "ord", "body", *[records.field(n).alias(n) for n in TEXTS], *[c.alias(n) for n, c in listed.items()])
    full = lambda n: F.col(n) != "" if n in TEXTS else F.size(n) > 0
    some = F.lit(False)
    for n in (*TEXTS, *LISTS):
        some = some | full(n)
    foreign = F.array_except(F.json_object_keys("body"), F.array(*map(F.lit, (*TEXTS, *LISTS))))
    error = F.when(F.size(foreign) > 0, F.concat(F.lit("unknown fields: "), F.array_join(F.array_sort(foreign), ", "))).when(~some, "no usable field")
    e = e.withColumn("error", error)
    missing = F.array_compact(F.array(*[F.when(~full(n), F.lit(n)) for n in IMPORTANT]))
    bad = found.filter("error is not null").select("path", "ord", "error").unionByName(e.filter("error is not null").select("path", "ord", "error"))
    return e.filter("error is null").select("path", "ord", *TEXTS, *LISTS, missing.alias("missing")), bad


def _numbered(rows: DataFrame, prefix: str, stamp: str, order: Sequence[str], name: str) -> DataFrame:
    n = select.numbered(rows, list(order), "__n", "")
    return n.withColumn(name, F.concat(F.lit(f"{prefix}-{stamp}-"), F.col("__n"))).drop("__n")


def from_questions(questions: DataFrame, stamp: str, key: str = "id", question: str = "question", client: str = "internal") -> DataFrame:
    """An engagement for each question, which is its brief as well: engagement_id, client, brief, strategic_question, type, status, research_object_ids."""
    e = _numbered(questions.select(key, question), "ENG", stamp, [key], "engagement_id")
    none = F.array().cast("array<string>")
    return e.select("engagement_id", F.col(key), F.lit(client).alias("client"), F.col(question).alias("brief"), F.col(question).alias("strategic_question"), F.lit("general").alias("type"), F.lit("active").alias("status"), none.alias("research_object_ids"))


def decision_models(framings: DataFrame, stamp: str, key: str = "id") -> DataFrame:
    """Decision models from framings (key, engagement_id, strategic_question, objective, critical_uncertainties, decision_areas):
    the objective, uncertainties as criteria of high weight, areas to investigate."""
    m = _numbered(framings, "DM", stamp, [key], "decision_model_id")
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    criteria = F.transform(none("critical_uncertainties"), lambda u: F.struct(u.alias("name"), u.alias("description"), F.lit("high").alias("weight")))
    return m.select(
        "decision_model_id", key, "engagement_id", "strategic_question", F.lit("research").alias("decision_type"), F.array(F.struct(F.col("objective"), F.lit("").alias("rationale"))).alias("objectives"),
        criteria.alias("decision_criteria"), none("decision_areas").alias("investigation_areas"), F.lit("medium").alias("required_confidence"),
    )


def linked(rows: DataFrame, links: DataFrame, key: str, column: str, link: str, order: str) -> DataFrame:
    """rows with the links (key, link, order) appended to an array column: each once, in order, after those that are there."""
    first = links.filter(F.col(link).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(link).alias("__l")).agg(F.min(order).alias("__o"))
    more = first.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__l"))), lambda x: x["__l"]).alias("__more"))
    old = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return rows.join(more, F.col(key) == F.col("__k"), "left").withColumn(column, F.array_union(old, F.coalesce("__more", F.array().cast("array<string>")))).drop("__k", "__more")


#: Items more that the plain extraction must give for the other to count as too strict.
GAIN = 2


def diagnosis(production: Column, simple: Column, production_ok: Column, simple_ok: Column) -> Column:
    """Why two extractions of a chunk differ, from their items and whether each could be used."""
    return (
        F.when(~(production_ok & simple_ok), "TOOL_FAILURE")
        .when(simple - production >= GAIN, "PRODUCTION_PROMPT_TOO_CONSERVATIVE")
        .when((production == 0) & (simple == 0), "NO_EXTRACTABLE_FACTS")
        .otherwise("PROMPTS_EQUIVALENT")
    )


def analysed(chunks: DataFrame, limit: int, keys: Sequence[str]) -> DataFrame:
    """The evidence-dense chunks without items that promise most: by relevance, then numbers, names and policy terms (signals)."""
    c = chunks.filter((F.col("chunk_type") == "evidence_dense") & (F.col("items") == 0))
    return c.orderBy(F.desc("relevance"), F.desc("signals.numeric"), F.desc("signals.entity"), F.desc("signals.policy"), *keys).limit(limit)


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row over compared chunks (production, simple, diagnosis): counts, mean gain of the usable ones, likeliest failure mode."""
    of = lambda d: F.count_if(F.col("diagnosis") == d)
    ok = F.col("diagnosis") != "TOOL_FAILURE"
    s = compared.agg(
        F.count("*").alias("chunks_analyzed"), F.count_if(ok).alias("successful"), of("TOOL_FAILURE").alias("tool_failures"), of("PRODUCTION_PROMPT_TOO_CONSERVATIVE").alias("simple_wins"), of("PROMPTS_EQUIVALENT").alias("equivalent"), of("NO_EXTRACTABLE_FACTS").alias("empty"),
        F.coalesce(F.sum(F.when(ok, F.col("production"))), F.lit(0)).alias("production_evidence"), F.coalesce(F.sum(F.when(ok, F.col("simple"))), F.lit(0)).alias("simple_evidence"),
    )
    n = F.col("successful")
    mode = (
        F.when((n > 0) & (2 * F.col("simple_wins") >= n), "production_prompt_too_conservative")
        .when((n > 0) & (2 * F.col("empty") >= n), "chunks_genuinely_empty")
        .when(2 * F.col("tool_failures") >= F.col("chunks_analyzed"), "tool_failures_dominate")
        .otherwise("mixed")
    )
    return s.withColumns({"average_gain": F.round((F.col("simple_evidence") - F.col("production_evidence")) / F.greatest(n, F.lit(1)), 1), "failure_mode": mode})


def synthesis_tokens(calls: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """(run, tokens): input tokens of a run's first synthesis call (ord, operation, input_tokens; of equal ones the fewest), else
    the run's estimate, else 0."""
    tokens = F.coalesce("input_tokens", F.lit(0))
    said = calls.filter("operation = 'synthesize_memo'").groupBy(run).agg(F.min(F.struct("ord", tokens.alias("t")))["t"].alias("__t"))
    return runs.join(said, run, "left").select(run, F.coalesce("__t", "estimate", F.lit(0)).cast("long").alias("tokens"))
