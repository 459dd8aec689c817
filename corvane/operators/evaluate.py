"""Benchmark scores, aggregates, run-to-run differences, definition checks and decision rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import text as T

#: Words that do not count in a match.
MATCH_STOP = ("a", "an", "the", "and", "or", "in", "of", "to", "for", "is", "are", "was", "were", "be", "been", "by", "on", "at", "from", "into", "that", "this", "with", "as", "its", "their", "our")


def match_tokens(text: Column) -> Column:
    return T.tokens(text, "[a-z0-9]+", MATCH_STOP, 2, distinct=True)


def term_matches(rows: DataFrame, keys: Sequence[str], answer: str = "answer", term: str = "term", synonyms: str = "synonyms", blocked: str = "blocked") -> DataFrame:
    """One row of (keys, term) with match_type, similarity, confidence and matched.

    Ladder: the term itself, a synonym (longest first), the most similar window by token sets; windows under
    0.85 are refused, and so is a phrase that holds one of the blocked ones."""
    low = F.lower(F.col(answer))
    exact = F.contains(low, F.lower(F.col(term)))
    by_length = F.array_sort(F.col(synonyms), lambda a, b: F.length(b) - F.length(a))
    synonym = F.get(F.filter(by_length, lambda s: F.contains(low, F.lower(s))), 0)
    windows = F.filter(F.split(F.col(answer), r"[.!?;]|\s{3,}"), lambda w: F.trim(w) != "")
    want = match_tokens(F.col(term))
    best = F.array_max(F.transform(windows, lambda w: F.struct(T.jaccard(want, match_tokens(w)).alias("v"), w.alias("w"))))
    r = rows.withColumns({"__x": exact, "__s": synonym, "__b": best})
    sim = F.when(F.col("__x"), 1.0).when(F.col("__s").isNotNull(), 0.95).otherwise(F.coalesce("__b.v", F.lit(0.0)))
    kind = F.when(F.col("__x"), "exact").when(F.col("__s").isNotNull(), "synonym").when(sim >= 0.85, "token_overlap").otherwise("none")
    phrase = F.lower(F.when(F.col("__s").isNotNull(), F.col("__s")).otherwise(F.col("__b.w")))
    anti = F.exists(F.col(blocked), lambda b: F.contains(phrase, F.lower(b)))
    band = F.when(kind.isin("exact", "synonym"), "HIGH").when(sim >= 0.92, "HIGH").when(sim >= 0.85, "MEDIUM").otherwise("LOW")
    matched = (kind == "exact") | ((kind != "none") & ~F.coalesce(anti, F.lit(False)))
    return r.select(*keys, term, kind.alias("match_type"), F.round(sim, 3).alias("similarity"), band.alias("confidence"), matched.alias("matched"))


def qa_scores(terms: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """Coverage, penalty, citation and overall score of every question, and whether it passes.

    terms: key, matched; facts: key, violations, citations."""
    c = terms.groupBy(key).agg(F.count_if("matched").alias("hits"), F.count("*").alias("total"))
    s = facts.join(c, key, "left").withColumn("coverage", F.coalesce(F.col("hits") / F.col("total"), F.lit(1.0)))
    penalty = F.when(F.col("violations") > 0, 1.0).otherwise(0.0)
    cited = F.when(F.col("citations") > 0, 1.0).otherwise(0.0)
    overall = F.round(F.col("coverage") * (1.0 - penalty) * 0.9 + cited * 0.1, 4)
    passed = (F.col("coverage") >= 0.5) & (F.col("violations") == 0)
    return s.select(key, F.round("coverage", 6).alias("coverage"), penalty.alias("penalty"), cited.alias("citation"), overall.alias("overall"), passed.alias("passed"))


def benchmark_summary(scores: DataFrame, domain: str) -> DataFrame:
    """Means and pass rate by domain and over all (a null domain), without errors and known limitations."""
    good = ~F.col("benchmark_error") & ~F.col("known_limitation")
    return scores.filter(good).groupingSets([[domain], []], domain).agg(
        F.count("*").alias("n"), F.round(F.avg("coverage"), 4).alias("coverage"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"), F.round(F.avg("overall"), 4).alias("overall")
    )


def item_diff(baseline: DataFrame, current: DataFrame, key: str, passed: str = "passed") -> DataFrame:
    """(key, status) of every item of two runs."""
    b = baseline.select(key, F.col(passed).alias("__b"), F.lit(True).alias("__hb"))
    c = current.select(key, F.col(passed).alias("__c"), F.lit(True).alias("__hc"))
    status = (
        F.when(F.col("__hb").isNull(), "new")
        .when(F.col("__hc").isNull(), "removed")
        .when(~F.col("__b") & F.col("__c"), "improved")
        .when(F.col("__b") & ~F.col("__c"), "regressed")
        .when(F.col("__b"), "unchanged_pass")
        .otherwise("unchanged_fail")
    )
    return b.join(c, key, "full_outer").select(key, status.alias("status"))


def metric_diff(baseline: DataFrame, current: DataFrame, lower_is_better: Sequence[str] = (), threshold: float = 0.03) -> DataFrame:
    """(metric, baseline, current, delta, status) of two summaries (metric, value)."""
    j = baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric", "full_outer")
    j = j.select("metric", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("baseline", "current")])
    delta = F.round(F.col("current") - F.col("baseline"), 6)
    gain = F.when(F.col("metric").isin(*lower_is_better), -delta).otherwise(delta) if lower_is_better else delta
    status = F.when(gain < -threshold, "fail").when(gain > threshold, "improved").otherwise("pass")
    return j.select("metric", "baseline", "current", delta.alias("delta"), status.alias("status"))


def definition_problems(questions: DataFrame, key: str = "id") -> DataFrame:
    """(key, code) of defects: repeated keys, empty fields, requirements that a prohibition contradicts, short prohibitions, nothing required."""
    q = questions
    twice = q.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("duplicate_id").alias("code"))
    rules = F.array_compact(
        F.array(
            F.when(F.trim("question") == "", "missing_required_field"),
            F.when(F.size("must_include") == 0, "no_must_include"),
            F.when(F.exists("must_not", lambda p: F.length(F.trim(p)) <= 2), "short_prohibited_term"),
            F.when(F.exists("must_not", lambda p: (F.trim(p) != "") & F.exists("must_include", lambda r: F.contains(F.lower(r), F.lower(F.trim(p))) & (F.lower(r) != F.lower(F.trim(p))))), "must_include_conflict"),
        )
    )
    return q.select(key, F.explode(rules).alias("code")).unionByName(twice)


def support_level(n: Column) -> Column:
    return F.when(n >= 4, "STRONG").when(n >= 2, "MODERATE").when(n >= 1, "WEAK").otherwise("NONE")


def level(score: Column) -> Column:
    return F.when(score >= 0.7, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def sufficiency(support: DataFrame, total: Column) -> DataFrame:
    """Confidence of an investigation from the evidence counts of its questions (n): one row."""
    n = F.count("*")
    none, single = F.count_if(F.col("n") == 0), F.count_if(F.col("n") == 1)
    coverage = F.greatest(F.lit(0.0), 1.0 - none / n)
    evidence = F.greatest(F.lit(0.0), 1.0 - (none * 0.3 + single * 0.1) / n)
    evidence = F.when(total >= 20, F.least(F.lit(1.0), evidence + 0.1)).otherwise(evidence)
    return support.agg(n.alias("questions"), F.round(coverage, 4).alias("coverage_score"), level(coverage).alias("coverage"), F.round(evidence, 4).alias("evidence_score"), level(evidence).alias("evidence"))


def scenario_fit(words: Column, n_risks: Column, power: Sequence[str], cooling: Sequence[str], capital: Sequence[str], interconnection: Sequence[str], transmission: Sequence[str]) -> tuple[Column, Column, Column, Column]:
    """(base, upside, downside, robustness) of a recommendation under three scenarios, by its words and risks."""
    has = lambda ks: F.arrays_overlap(words, F.array(*map(F.lit, ks)))
    grid, risky = has(power) | has(transmission), n_risks >= 2
    base = F.when(grid & risky, 1.0).when(~risky, 0.60).otherwise(0.75)
    upside = F.when(has(capital) | has(cooling) | has(interconnection), 1.0).otherwise(0.75)
    down = F.when(grid & risky, 0.75).otherwise(0.60)
    down = F.when(has(interconnection) & risky, F.least(F.lit(1.0), down + 0.15)).otherwise(down)
    down = F.greatest(F.lit(0.3), F.when(risky, down).otherwise(down - 0.30))
    label = lambda s: F.when(s >= 0.75, "strong").when(s >= 0.45, "medium").otherwise("weak")
    worth = lambda s: F.when(s >= 0.75, 1.0).when(s >= 0.45, 0.6).otherwise(0.3)
    return label(base), label(upside), label(down), F.round((worth(base) + worth(upside) + worth(down)) / 3, 3)


def fail_reasons(coverage: Column, hits: Column, total: Column, violations: Column) -> Column:
    """Why an answer fails: too few of the required terms, and every prohibited one."""
    low = F.when((total > 0) & (coverage < 0.5), F.concat(F.lit("low fact coverage: "), hits.cast("string"), F.lit("/"), total.cast("string")))
    return F.concat(F.array_compact(F.array(low)), F.transform(violations, lambda t: F.concat(F.lit("prohibited term found: "), t)))


def regression_verdict(metrics: DataFrame, items: DataFrame) -> DataFrame:
    """One row: how many metrics and items got worse or better, and whether the gate fails (a metric did)."""
    m = metrics.agg(F.count_if(F.col("status") == "fail").alias("failed_metrics"), F.count_if(F.col("status") == "improved").alias("improved_metrics"))
    i = items.agg(F.count_if(F.col("status") == "regressed").alias("regressed_items"), F.count_if(F.col("status") == "improved").alias("improved_items"))
    return m.join(i, F.lit(True)).withColumn("verdict", F.when(F.col("failed_metrics") > 0, "fail").otherwise("pass"))


def support_issues(support: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, type, severity): questions whose coverage is none or weak, and those with no or a single piece of evidence."""
    c = F.col(n)
    issue = lambda kind, severity: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))
    level_ = support_level(c)
    found = F.array(
        F.when(level_ == "NONE", issue("coverage", "HIGH")).when(level_ == "WEAK", issue("coverage", "MEDIUM")),
        F.when(c == 0, issue("evidence_sufficiency", "HIGH")).when(c == 1, issue("evidence_sufficiency", "MEDIUM")),
    )
    return support.select(key, F.explode(F.array_compact(found)).alias("i")).select(key, "i.*")


def profile_influence(profiles: DataFrame, evidence: DataFrame, findings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(profile, evidence, findings, recommendations, balance): what each requested profile contributed; balance is its share
    of the recommendations' touches, equal without any.  profiles: profile; evidence: profile; the others: profiles arrays."""
    n = lambda rows, name: rows.groupBy("profile").agg(F.count("*").alias(name))
    touched = lambda rows: rows.select(F.explode("profiles").alias("profile"))
    p = profiles.select("profile").distinct()
    for rows, name in ((evidence, "evidence"), (touched(findings), "findings"), (touched(recommendations), "recommendations")):
        p = p.join(n(rows, name), "profile", "left")
    p = p.fillna(0, ["evidence", "findings", "recommendations"])
    total = p.agg(F.sum("recommendations").alias("__t"), F.count("*").alias("__n"))  # profiles are a vocabulary: one row of totals
    share = F.when(F.col("__t") > 0, F.col("recommendations") / F.col("__t")).otherwise(1.0 / F.col("__n"))
    return p.join(F.broadcast(total), F.lit(True)).withColumn("balance", F.round(share, 3)).drop("__t", "__n")


def synthesis_counts(influence: DataFrame) -> DataFrame:
    """One row: profiles requested, contributing, represented in findings and in recommendations."""
    return influence.agg(
        F.count("*").alias("profiles_requested"),
        F.count_if(F.col("evidence") > 0).alias("profiles_contributing"),
        F.count_if(F.col("findings") > 0).alias("profiles_represented_in_findings"),
        F.count_if(F.col("recommendations") > 0).alias("profiles_represented_in_recommendations"),
    )


def missing_profiles(profiles: DataFrame) -> DataFrame:
    """(profile, status, reason) of profiles (retrieved, attributed) without attributed evidence."""
    reason = F.when(F.col("retrieved") == 0, "no evidence retrieved").otherwise("evidence retrieved but keyword overlap insufficient for attribution")
    return profiles.filter("attributed = 0").select("profile", F.lit("missing").alias("status"), reason.alias("reason"))


def coverage_score(levels: DataFrame, group: str, level: str = "level") -> DataFrame:
    """(group, coverage_score, topics): mean weight of the topics' coverage levels."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.COVERAGE_WEIGHTS.items() for x in kv]), F.col(level)), F.lit(0.0))
    return levels.groupBy(group).agg(F.round(F.avg(weight), 4).alias("coverage_score"), F.count("*").alias("topics"))


def gap_labels(topics: Column, most: int = 3) -> Column:
    """The first topics of a list, joined; more are an ellipsis."""
    return F.concat(F.array_join(F.slice(topics, 1, most), ", "), F.when(F.size(topics) > most, "\u2026").otherwise(""))


def option_averages(options: DataFrame, lists: Sequence[str]) -> DataFrame:
    """One row: the number of options and the mean length of each of their lists."""
    return options.agg(F.count("*").alias("option_count"), *[F.round(F.avg(F.greatest(F.size(c), F.lit(0))), 2).alias(f"average_{c}_per_option") for c in lists])


def performance_totals(records: DataFrame) -> DataFrame:
    """One row from stages (wall_ms, llm_ms, calls, prompt_tokens, completion_tokens)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return records.agg(
        F.round(total("wall_ms"), 1).alias("pipeline_wall_ms"),
        F.round(total("llm_ms"), 1).alias("llm_total_ms"),
        F.round(total("wall_ms") - total("llm_ms"), 1).alias("llm_overhead_ms"),
        total("calls").alias("llm_call_count"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"),
    )


def trace_summary(traces: DataFrame, group: str, order: str) -> DataFrame:
    """Per group of calls (usage: map of counts, success, error, model, ts): last model, first time, all succeeded, summed usage, errors."""
    base = traces.groupBy(group).agg(
        F.max_by("model", order).alias("model_name"), F.min_by("ts", order).alias("request_timestamp"), F.bool_and("success").alias("response_success"), F.count("error").alias("errors")
    )
    used = traces.select(group, F.explode("usage").alias("kind", "n")).groupBy(group, "kind").agg(F.sum("n").alias("n"))
    used = used.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("usage"))  # kinds of tokens are few
    return base.join(used, group, "left")


def improvement(before: DataFrame, after: DataFrame, key: str, score: str) -> DataFrame:
    """One row: mean score before and after, their difference, and how many records got better."""
    j = before.select(key, F.col(score).alias("__b")).join(after.select(key, F.col(score).alias("__a")), key)
    return j.agg(F.count("*").alias("n"), F.round(F.avg("__b"), 4).alias("before_"), F.round(F.avg("__a"), 4).alias("after_"), F.round(F.avg("__a") - F.avg("__b"), 4).alias("delta"), F.count_if(F.col("__a") > F.col("__b")).alias("improved"))


def fit_label(score: Column) -> Column:
    return F.when(score >= 0.75, "strong").when(score >= 0.45, "medium").otherwise("weak")


def time_summary(rows: DataFrame, seconds: str) -> DataFrame:
    """One row of a run's times."""
    return rows.agg(F.count("*").alias("n"), *[F.round(f(seconds), 2).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max), ("total", F.sum))])
