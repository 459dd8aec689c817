"""Scores of chunks and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.functions import text as T


def chunk_relevance(text: Column, terms: Sequence[str]) -> Column:
    """Share of the question's terms that a chunk holds."""
    return F.round(R.term_hits(text, terms) / len(terms), 4) if terms else F.lit(0.0)


def candidate_sentences(text: Column, terms: Sequence[str]) -> Column:
    """Sentences that hold a term of the question."""
    return F.size(F.filter(T.sentences(text), lambda s: R.any_term(s, terms)))


def topic_match(text: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Share of the question's topics that a chunk touches."""
    return F.size(R.labels(text, groups)) / len(groups) if groups else F.lit(0.0)


def retrieval_score(keyword: Column, topic: Column, quality: Column) -> Column:
    return F.round(0.40 * keyword + 0.35 * topic + 0.25 * quality / 5.0, 4)


def relevance_score(haystack: Column, category: Column, terms: Sequence[str], topics: Sequence[str]) -> Column:
    on_topic = category.isin(*topics)

    def by(n: Column) -> Column:
        return (
            F.when((n >= 4) | (on_topic & (n >= 2)), 5)
            .when((n >= 2) | on_topic, 4)
            .when((n == 1) | (category != "other"), 3)
            .when(R.any_term(haystack, L.DOMAIN_TERMS), 2)
            .otherwise(1)
        )

    return R.bound(R.term_hits(haystack, terms), by)


def specificity_score(text: Column, snippet: Column) -> Column:
    counts = lambda low: F.struct(R.digit_matches(low, L.SPECIFIC_NUMBER).alias("n"), R.term_hits(low, L.SPECIFIC_TERMS).alias("hits"))

    def by(c: Column) -> Column:
        return (
            F.when((c["n"] >= 2) | (c["hits"] >= 5), 5)
            .when((c["n"] >= 1) | (c["hits"] >= 3), 4)
            .when((c["hits"] >= 1) | (F.length(snippet) >= 140), 3)
            .when(F.length(snippet) >= 60, 2)
            .otherwise(1)
        )

    return R.bound(R.bound(F.lower(text), counts), by)


def quantitative_score(text: Column) -> Column:
    counts = lambda low: F.struct(R.digit_matches(low, L.UNIT_NUMBER).alias("units"), R.digit_matches(low, L.BARE_NUMBER).alias("bare"))
    by = lambda c: F.when(c["units"] >= 3, 5).when(c["units"] >= 2, 4).when((c["units"] >= 1) | (c["bare"] >= 3), 3).when(c["bare"] >= 1, 2).otherwise(1)
    return R.bound(R.bound(F.lower(text), counts), by)


def overall_score(relevance: Column, quality: Column, specificity: Column, quantitative: Column) -> Column:
    return F.round(0.40 * relevance + 0.22 * quality + 0.25 * specificity + 0.13 * quantitative, 2)


def store_overall(relevance: Column, quality: Column, specificity: Column) -> Column:
    return F.round((relevance + quality + specificity) / 3.0, 2)


def vocabulary_boost(statement: Column, terms: Sequence[str]) -> Column:
    """Up to 0.45 for risk vocabulary, if the query's terms ask about risk."""
    if not any(t.startswith(x) for t in terms for x in L.RISK_TRIGGERS):
        return F.lit(0.0)
    return F.least(F.lit(0.45), R.term_hits(statement, L.RISK_VOCABULARY) / 5.0 * 0.45)


def lexical_relevance(statement: Column, terms: Sequence[str]) -> Column:
    n = R.term_hits(statement, terms)
    return F.when(n > 0, n / len(terms) + vocabulary_boost(statement, terms)).otherwise(0.0) if terms else F.lit(0.0)


def metadata_factor(overall: Column, priority: Column, value: Column) -> Column:
    return (0.8 + (overall - 1.0) / 4.0 * 0.4) * (0.9 + (priority - 1) / 4.0 * 0.2) * (0.9 + value * 0.2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays in double precision; 0 for a missing one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9)), F.lit(0.0))


def signal_strength(s: Column) -> Column:
    return F.least(F.lit(100), s["numeric"] + s["entity"] + 3 * s["unit"] + 2 * s["policy"] + s["date"] + 2 * s["comparative"])


def contradiction_confidence(a: Column, b: Column) -> Column:
    return F.when((a >= 4) & (b >= 4), "high").when(F.abs(a - b) >= 3, "low").otherwise("medium")


def coverage_level(n: Column, sources: Column) -> Column:
    return F.when(n == 0, "none").when(n == 1, "weak").when((n >= 5) & (sources >= 2), "strong").otherwise("moderate")


#: Dimensions of a recommendation, what a low one is called, and its weight.
DIMENSIONS = (
    ("evidence", "missing_evidence_links", 0.25),
    ("reasoning", "weak_reasoning", 0.25),
    ("tradeoff", "no_tradeoff_awareness", 0.15),
    ("risk", "no_risk_identification", 0.20),
    ("actionability", "low_actionability", 0.15),
)


def recommendation_score(dimension: dict[str, Column]) -> tuple[Column, Column]:
    """(weighted score, name of the lowest dimension if it is under 0.5)."""
    total = F.round(sum((w * dimension[n] for n, _, w in DIMENSIONS), F.lit(0.0)), 3)
    least = F.array_min(F.array(*[F.struct(dimension[n].alias("v"), F.lit(i).alias("o"), F.lit(said).alias("n")) for i, (n, said, _) in enumerate(DIMENSIONS)]))
    return total, F.when(least["v"] < 0.5, least["n"])


def evidence_support(n_linked: Column, n_known: Column) -> Column:
    base = F.when(n_linked == 0, 0.0).when(n_linked == 1, 0.50).when(n_linked == 2, 0.70).when(n_linked == 3, 0.85).otherwise(1.0)
    return F.when(n_linked == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), base + n_known / F.greatest(n_linked, F.lit(1)) * 0.1), 3))


def risk_support(n_risks: Column, n_specific: Column) -> Column:
    base = F.when(n_risks == 1, 0.50).when(n_risks == 2, 0.75).otherwise(1.0)
    return F.when(n_risks == 0, 0.0).otherwise(F.least(F.lit(1.0), F.round(base + F.least(F.lit(0.15), n_specific / F.greatest(n_risks, F.lit(1)) * 0.15), 3)))


def document_priority(quality: Column) -> Column:
    """Quality of a source as a share of the best."""
    return quality / 5.0


def profile_terms_score(claim: Column, topics: Column, terms: Sequence[str]) -> Column:
    """How many of a profile's terms a claim and its topics hold."""
    return R.term_hits(F.concat_ws(" ", claim, F.array_join(topics, " ")), terms)


def inference_dimensions(inferences: Column, actions: Sequence[str], tradeoffs: Sequence[str]) -> dict[str, Column]:
    """Scores of a memo's inferences (an array) by dimension, from the share of them with the words for it."""
    n = F.size(inferences)
    share = lambda hit: F.size(F.filter(inferences, hit)) / n
    bonus = F.least(F.lit(0.30), n / 4.0 * 0.30)
    score = lambda s: F.when(n == 0, 0.1).otherwise(F.round(F.least(F.lit(1.0), 0.40 + s * 0.60 + bonus), 3))
    return {
        "evidence": score(share(lambda x: x.rlike(L.PROXY_EVIDENCE))),
        "reasoning": score(share(lambda x: x.rlike(L.PROXY_LOGIC))),
        "tradeoff": score(share(lambda x: R.any_term(x, tradeoffs))),
        "risk": score(share(lambda x: x.rlike(L.PROXY_RISK))),
        "actionability": score(share(lambda x: (F.length(x) >= 60) & R.any_term(x, actions))),
    }


def _filled(template: str, **parts: Column) -> Column:
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def coverage_rationale(topic: Column, n: Column, sources: Column, quality: Column, level: Column, gaps: Column) -> Column:
    """Why a topic has its coverage level: the evidence, its sources' quality if notable, and the gaps (an array of topics) that remain."""
    word = F.when(sources == 1, "source").otherwise("sources")
    lead = F.when(level == "weak", _filled(L.COVERAGE_WEAK, topic=topic)).otherwise(_filled(L.COVERAGE_MORE, level=F.initcap(level), n=n, s=sources, word=word))
    note = None
    for least, text in L.QUALITY_NOTES:
        note = R.when(note, quality >= least, text)
    note = note.when(quality <= L.QUALITY_LOW[0], L.QUALITY_LOW[1])
    listed = F.concat(F.array_join(F.slice(gaps, 1, 3), ", "), F.when(F.size(gaps) > 3, "…").otherwise(""))
    rest = F.when(F.size(gaps) > 0, _filled(L.GAPS_REMAIN, gaps=listed))
    return F.when(level == "none", _filled(L.COVERAGE_NONE, topic=topic)).otherwise(F.array_join(F.array_compact(F.array(lead, note, rest)), " "))
