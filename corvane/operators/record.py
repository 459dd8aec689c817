"""Decision records: architectures derived from a framing, checks of research objects, issues and traces of records.

Everything but target_counts is a narrow pass: the lists of one record stay arrays of its row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import text as T


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _listed(*columns: str, most: str) -> Column:
    """The items of lists, trimmed, blank ones left out, the first spelling of each, up to the cap."""
    held = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])
    return F.slice(T.distinct_ignoring_case(F.filter(F.transform(held, _strip), lambda x: x != "")), 1, L.RECORD_CAPS[most])


def board_decision(theme: Column) -> Column:
    """A theme as an item to approve; one that is a decision already stays."""
    t = F.rtrim(_strip(theme), F.lit("."))
    decided = F.lower(t).rlike("^(" + "|".join(L.DECISION_VERBS) + ")")
    return F.when(t == "", "Approve strategy").when(decided, t).otherwise(F.concat(F.lit("Approve "), t, F.lit(" approach")))


def architecture(framings: DataFrame, key: str) -> DataFrame:
    """(key, statement, themes, in_scope, success, unknowns, board) of framings.

    framings: objective, title, horizon, and lists areas, priorities, objectives, success_criteria, known_unknowns,
    uncertainties.  Null lists are empty; a blank objective gives way to the title; the horizon is the last sign of
    success, where the cap leaves room for it."""
    rows = framings.withColumn("__themes", _listed("areas", "priorities", most="themes"))
    horizon = _strip(F.col("horizon"))
    ends = F.when(horizon != "", F.array(F.concat(F.lit("Decision horizon: "), horizon))).otherwise(F.array().cast("array<string>"))
    objective = _strip(F.col("objective"))
    return rows.select(
        key,
        F.when(objective != "", objective).otherwise(_strip(F.col("title"))).alias("statement"),
        F.col("__themes").alias("themes"),
        _listed("__themes", "objectives", most="in_scope").alias("in_scope"),
        F.slice(F.concat(_listed("success_criteria", most="success"), ends), 1, L.RECORD_CAPS["success"]).alias("success"),
        _listed("known_unknowns", "uncertainties", most="unknowns").alias("unknowns"),
        F.slice(T.distinct_ignoring_case(F.transform("__themes", board_decision)), 1, L.RECORD_CAPS["board"]).alias("board"),
    )


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9-]{2,}"), F.lit(0)), lambda w: ~w.isin(*L.STREAM_STOP)))


def streams(records: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, place, title, questions): a stream for each theme with the questions that share most words with it.

    The first of equal themes takes a question; those that share none go round the themes in order.  Without themes one
    stream holds all questions.  most keeps the first questions of a stream, for reports.  records: key, themes,
    questions; nulls in questions are left out."""
    lists = records.select(key, "themes", F.filter(F.coalesce("questions", F.array().cast("array<string>")), lambda q: q.isNotNull()).alias("questions"))
    words = lists.withColumn("__t", F.transform("themes", _words))
    shared = lambda q: F.transform("__t", lambda t: F.size(F.array_intersect(t, _words(q))))
    best = words.withColumn("__s", F.transform("questions", shared))
    best = best.withColumn("__m", F.transform("__s", lambda s: F.when(F.array_max(s) > 0, F.array_position(s, F.array_max(s)).cast("int") - 1)))
    turn = lambda m, i: F.coalesce(m, F.size(F.filter(F.slice("__m", F.lit(1), i), lambda x: x.isNull())) % F.greatest(F.size("themes"), F.lit(1)))
    placed = best.withColumn("__p", F.transform("__m", turn))
    held = lambda i: F.filter("questions", lambda q, j: F.get("__p", j) == i)
    own = F.transform("themes", lambda t, i: F.struct(i.alias("place"), t.alias("title"), held(i).alias("questions")))
    one = F.array(F.struct(F.lit(0).alias("place"), F.lit("Primary Decision Workstream").alias("title"), F.col("questions")))
    every = F.when(F.size("themes") > 0, own).when(F.size("questions") > 0, one)
    out = placed.select(key, F.explode(every).alias("s")).select(key, "s.*")
    return out if most is None else out.withColumn("questions", F.slice("questions", 1, most))


def object_problems(objects: DataFrame, key: str) -> DataFrame:
    """(key, problem, field): what makes a research object invalid.  objects: the required fields as strings, summary as
    JSON text; an empty value of another kind than an object stands for none."""
    problem = lambda what, field: F.struct(F.lit(what).alias("problem"), F.lit(field).alias("field"))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    summary = _strip(F.col("summary"))
    other = (summary != "") & ~summary.startswith("{") & ~summary.isin("[]", "0", '""', "false", "null")
    found = F.array(
        *[F.when(blank(f), problem("missing", f)) for f in L.OBJECT_FIELDS],
        F.when(~F.coalesce(F.col("status").isin(*L.OBJECT_STATES), F.lit(False)), problem("invalid state", "status")),
        F.when(other, problem("not an object", "summary")),
    )
    return objects.select(key, F.explode(F.array_compact(found)).alias("p")).select(key, "p.*")


def review_issues(contradictions: DataFrame) -> DataFrame:
    """A review's issue for every contradiction (contradiction_id, severity, topic)."""
    said = lambda c: F.coalesce(F.col(c), F.lit("?"))
    return contradictions.select(
        F.lit("contradiction").alias("type"),
        F.coalesce("contradiction_id", F.lit("")).alias("contradiction_id"),
        F.coalesce("severity", F.lit("unknown")).alias("severity"),
        F.coalesce("topic", F.lit("")).alias("topic"),
        F.concat(F.lit("Contradiction detected: "), said("contradiction_id"), F.lit(" ["), said("severity"), F.lit("] topic="), said("topic")).alias("message"),
    )


def traceability(recommendations: DataFrame, key: str, lists: Sequence[str] = ("evidence_ids", "hypothesis_ids", "challenge_ids")) -> DataFrame:
    """The ids that support every recommendation, empty lists for null ones, and whether there are any."""
    held = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists}
    return recommendations.select(key, *[v.alias(c) for c, v in held.items()], (sum((F.size(v) for v in held.values()), F.lit(0)) > 0).alias("traced"))


def target_counts(targets: DataFrame, run: str, order: str, kind: str = "kind") -> DataFrame:
    """(run, count, primary_kind, kinds): how many targets a run reasons over, the first one's kind, a map of counts by kind."""
    k = targets.groupBy(run, kind).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return k.groupBy(run).agg(F.sum("n").alias("count"), F.min_by(kind, "first").alias("primary_kind"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"))


def chunk_scores(chunks: DataFrame, scores: DataFrame, key: str, score: str = "keyword_score") -> DataFrame:
    """(key, score) of all chunks; 0 for those that retrieval did not score."""
    return chunks.select(key).join(scores.select(key, score), key, "left").select(key, F.coalesce(F.col(score), F.lit(0.0)).alias(score))


def perturbed(rows: DataFrame, changes: Mapping[str, float]) -> DataFrame:
    """The rows with amounts added to columns, to six places: a planted regression that a comparison has to find."""
    return rows.withColumns({c: F.round(F.col(c) + F.lit(d), 6) for c, d in changes.items()})


def architecture_counts(architectures: DataFrame, key: str, streams: str, lists: Sequence[str], questions: str) -> DataFrame:
    """(key, streams, n_<list>..., research_questions): compact counts of decision architectures.

    streams: an array of structs with an array of questions; lists: arrays."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    asked = F.aggregate(F.coalesce(F.transform(streams, lambda s: size(s[questions])), F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n)
    return architectures.select(key, size(F.col(streams)).alias("streams"), *[size(F.col(c)).alias(f"n_{c}") for c in lists], asked.alias("research_questions"))
