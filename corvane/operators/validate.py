"""Validators: defects of gold sets, structure of the record sets of a decision, portfolios of recommendations.

Rules are columns over records; a set's verdict is a count per rule, so sets of any size are never gathered.  Issues are in our
own words, in the order of the rules.

Cases: null lists and texts count as empty; a group without records (groups are given) is not present and has one issue;
ids that repeat count once less than they occur.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("high", "medium", "low")
HORIZONS = ("near_term", "medium_term", "long_term")
STRENGTHS = ("strong", "moderate", "weak")
OUTCOMES = ("contradiction", "no_contradiction")


def _codes(*found: tuple[str, str, Column]) -> Column:
    """(code, severity, n) of the rules with a count above zero."""
    rows = [F.when(n > 0, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.cast("long").alias("n"))) for code, severity, n in found]
    return F.array_compact(F.array(*rows))


def _repeats(rows: DataFrame, key: str, code: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").select(key, F.lit(code).alias("code"), F.lit("error").alias("severity"), (F.col("c") - 1).alias("n"))


def _said(name: str) -> Column:
    return (F.trim(F.coalesce(name, F.lit(""))) == "").cast("int")


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def question_defects(questions: DataFrame, domains: Sequence[str], key: str = "question_id") -> DataFrame:
    """(key, code, severity, n) of the defects of gold questions (key, domain, question and the lists of terms).

    A prohibited term within a required one makes the question unsatisfiable; within an alternative it is a warning."""
    low = lambda c: F.transform(_empty(c), lambda x: F.lower(F.trim(x)))
    no, must, other = low("must_not_include"), low("must_include"), low("acceptable_alternatives")
    within = lambda terms, same: F.aggregate(
        F.transform(F.filter(no, lambda p: p != ""), lambda p: F.size(F.filter(terms, lambda r: F.contains(r, p) & (F.lit(same) | (r != p))))), F.lit(0), lambda a, n: a + n
    )
    codes = _codes(
        ("missing_required_field", "error", _said(key) + _said("domain") + _said("question")),
        ("unknown_domain", "warning", (~F.coalesce(F.col("domain").isin(*domains, "unknown"), F.lit(False))).cast("int")),
        ("must_include_conflict", "error", within(must, True)),
        ("alternative_conflict", "warning", within(other, False)),
        ("no_must_include", "warning", ((F.size(_empty("must_include")) == 0) & (F.size(_empty("acceptable_alternatives")) == 0)).cast("int")),
        ("short_prohibited_term", "warning", F.size(F.filter(no, lambda p: F.length(p) <= 2))),
    )
    return questions.select(key, F.explode(codes).alias("d")).select(key, "d.*").unionByName(_repeats(questions, key, "duplicate_question_id"))


def case_defects(cases: DataFrame, key: str = "contradiction_id") -> DataFrame:
    """(key, code, severity, n) of the defects of contradiction cases."""
    fire, not_fire = F.col("suppression_should_fire"), F.col("suppression_should_not_fire")
    codes = _codes(
        ("missing_required_field", "error", _said(key) + _said("expected_result") + _said("claim_a") + _said("claim_b")),
        ("invalid_expected_result", "error", (~F.coalesce(F.col("expected_result").isin(*OUTCOMES), F.lit(False))).cast("int")),
        ("conflicting_suppression_flags", "error", (fire & not_fire).cast("int")),
        ("missing_suppression_reason", "warning", (fire & (_said("expected_suppression_reason") == 1)).cast("int")),
        ("contradiction_with_suppression", "error", (fire & F.coalesce(F.col("expected_result") == "contradiction", F.lit(False))).cast("int")),
        ("known_limitation", "warning", F.col("known_limitation").cast("int")),
    )
    return cases.select(key, F.explode(codes).alias("d")).select(key, "d.*").unionByName(_repeats(cases, key, "duplicate_contradiction_id"))


def filled(name: str) -> Column:
    return F.coalesce(F.size(F.col(name)) > 0, F.lit(False))


def one_of(name: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def record_sets(records: DataFrame, group: str, what: str, rules: Mapping[str, tuple[Column, str]], groups: DataFrame | None = None, least: int = 1) -> DataFrame:
    """For each group: present, n, a flag for each rule (whether all records keep it) and issues.

    rules: flag -> (condition of a record, issue).  least: records that a set should have."""
    sums = records.groupBy(group).agg(F.count("*").alias("n"), *[F.bool_and(c).alias(flag) for flag, (c, _) in rules.items()])
    if groups is not None:
        sums = groups.select(group).distinct().join(sums, group, "left")
    n = F.coalesce("n", F.lit(0))
    issues = [F.when(n == 0, F.lit(f"no {what}"))]
    issues += [F.when((n > 0) & ~F.col(flag), F.lit(issue)) for flag, (_, issue) in rules.items()]
    issues.append(F.when((n > 0) & (n < least), F.concat(F.lit("only "), n.cast("string"), F.lit(f" {what}, {least} are wanted"))))
    flags = [F.coalesce(flag, F.lit(False)).alias(flag) for flag in rules]
    return sums.select(group, (n > 0).alias("present"), n.alias("n"), *flags, F.array_compact(F.array(*issues)).alias("issues"))


def hypotheses(records: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """Structure of sets of hypotheses: evidence lists, confidence, decision_implications, disconfirming_evidence_needed."""
    mapped = F.col("supporting_evidence").isNotNull() | F.col("contradicting_evidence").isNotNull() | F.col("evidence_gaps").isNotNull()
    return record_sets(records, group, "hypotheses", {
        "all_have_evidence_mapping": (mapped, "a hypothesis is mapped to no evidence"),
        "all_have_confidence": (one_of("confidence", LEVELS), "a hypothesis has no valid confidence"),
        "all_have_decision_implications": (filled("decision_implications"), "a hypothesis has no implication for the decision"),
        "all_have_disconfirming_evidence_needs": (filled("disconfirming_evidence_needed"), "a hypothesis names no evidence that would refute it"),
    }, groups, 3)


def challenges(records: DataFrame, surviving: DataFrame, of: DataFrame, group: str, key: str = "hypothesis_id") -> DataFrame:
    """Structure of the challenges to hypotheses (of: group, key), and to those that survive them (survival_status).

    Adds unchallenged (hypotheses without a challenge), surviving and survival_valid."""
    sets = record_sets(records, group, "challenges", {
        "all_have_falsification_tests": (filled("falsification_tests"), "a challenge has no test that could refute"),
        "all_have_hidden_assumptions": (filled("hidden_assumptions"), "a challenge names no hidden assumption"),
        "robustness_valid": (one_of("robustness", LEVELS), "a challenge has no valid robustness"),
    }, of)
    missed = of.select(group, key).distinct().join(records.select(group, key).distinct(), [group, key], "left_anti").groupBy(group).agg(F.count("*").alias("unchallenged"))
    alive = surviving.groupBy(group).agg(F.count("*").alias("surviving"), F.bool_and(one_of("survival_status", STRENGTHS)).alias("survival_valid"))
    s = sets.join(missed, group, "left").join(alive, group, "left").na.fill(0, ["unchallenged", "surviving"]).withColumn("survival_valid", F.coalesce("survival_valid", F.lit(True)))
    more = F.array_compact(F.array(
        F.when(F.col("present") & (F.col("unchallenged") > 0), F.concat(F.col("unchallenged").cast("string"), F.lit(" hypotheses are not challenged"))),
        F.when(F.col("present") & ~F.col("survival_valid"), F.lit("a surviving hypothesis has no valid status")),
    ))
    return s.withColumn("issues", F.concat("issues", more))


def recommendations(records: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """Structure of sets of recommendations: evidence, hypotheses, confidence, time horizon, priority; portfolio tells whether any has a horizon."""
    sets = record_sets(records, group, "recommendations", {
        "all_have_evidence": (filled("supporting_evidence"), "a recommendation names no evidence"),
        "all_have_hypothesis_links": (filled("supported_by_hypotheses"), "a recommendation rests on no hypothesis"),
        "all_have_confidence": (one_of("confidence", LEVELS), "a recommendation has no valid confidence"),
        "all_have_time_horizon": (one_of("time_horizon", HORIZONS), "a recommendation has no valid time horizon"),
        "all_have_priority": (one_of("priority", LEVELS), "a recommendation has no valid priority"),
    }, groups)
    some = records.filter(one_of("time_horizon", HORIZONS)).select(group).distinct().withColumn("portfolio", F.lit(True))
    s = sets.join(some, group, "left").withColumn("portfolio", F.coalesce("portfolio", F.lit(False)))
    return s.withColumn("issues", F.when(F.col("present") & ~F.col("portfolio"), F.array_append("issues", F.lit("the portfolio is empty"))).otherwise(F.col("issues")))


def portfolio(scored: DataFrame, group: str, scores: Sequence[str], overall: str) -> DataFrame:
    """(group, n, mean_<score>..., average, lowest, highest) of recommendations with their scores."""
    means = [F.round(F.avg(s), 3).alias(f"mean_{s}") for s in scores]
    return scored.groupBy(group).agg(F.count("*").alias("n"), *means, F.round(F.avg(overall), 3).alias("average"), F.round(F.min(overall), 3).alias("lowest"), F.round(F.max(overall), 3).alias("highest"))


def portfolio_warnings(scored: DataFrame, key: str, penalty: str, missing: str, overall: str) -> DataFrame:
    """(key, issue, score) of recommendations with a penalty, else with evidence links (array missing) that lead nowhere."""
    issue = F.coalesce(F.nullif(F.col(penalty), F.lit("")), F.when(filled(missing), F.lit("missing_evidence_links")))
    return scored.select(key, issue.alias("issue"), F.col(overall).alias("score")).filter("issue is not null")


def synthesis(recommendations_: DataFrame, profiles: DataFrame, group: str) -> DataFrame:
    """For each group: profiles requested, contributing and represented in recommendations, integrated recommendations (of two
    profiles or more) and coverage_status.  profiles: group, profile, contributing; recommendations: group, profiles array."""
    asked = profiles.groupBy(group).agg(F.count("*").alias("requested"), F.count_if("contributing").alias("contributing"))
    touched = recommendations_.select(group, F.explode("profiles").alias("profile")).distinct().join(profiles.select(group, "profile"), [group, "profile"], "left_semi").groupBy(group).agg(F.count("*").alias("represented"))
    whole = recommendations_.filter(F.size("profiles") >= 2).groupBy(group).agg(F.count("*").alias("integrated"))
    s = asked.join(touched, group, "left").join(whole, group, "left").na.fill(0, ["represented", "integrated"])
    status = F.when(F.col("contributing") == F.col("requested"), "sufficient").when(F.col("contributing") > 0, "partial").otherwise("insufficient")
    return s.withColumn("coverage_status", status)
