"""Query plans: a question becomes a few queries, by its mode, the product and metric it names, and its topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import classify as C


def content_words(question: Column) -> Column:
    return T.tokens(question, "[a-z][a-z0-9-]{1,}", L.QUERY_STOP)


def detected_topics(question: Column) -> Column:
    """Topics of the expansion table that a question names, wholly or by one of their words, in the table's order."""
    low = F.lower(question)
    tight = F.replace(low, F.lit(" "), F.lit(""))
    named = lambda t: F.contains(tight, F.lit(t.replace(" ", ""))) | R.any_term(low, t.split())
    return F.array_compact(F.array(*[F.when(named(t), t) for t in L.TOPIC_EXPANSIONS]))


def _anchored(templates: tuple[str, ...], entity: Column) -> Column:
    return F.array(*[F.concat(entity, F.lit(t.removeprefix("{e}"))) for t in templates])


def _lookup(question: Column, words: Column) -> Column:
    """Queries of a fact lookup, anchored to the product that the question names."""
    entity, metric = C.entity_lock(question), C.metric_lock(question)
    chain = None
    for name, templates in L.METRIC_ANCHORS.items():
        chain = R.when(chain, metric == name, _anchored(templates[:2], entity))
    around = F.when(F.size(words) > 0, F.array(F.concat(entity, F.lit(" "), F.array_join(F.slice(words, 1, 4), " ")))).otherwise(_none())
    plain = F.when(F.size(words) >= 2, F.array(F.array_join(F.slice(words, 1, 6), " "))).otherwise(_none())
    return F.when(entity.isNotNull() & metric.isNotNull(), chain).when(entity.isNotNull(), F.concat(around, _anchored(L.GENERIC_ANCHORS[:1], entity))).otherwise(plain)


def _none() -> Column:
    return F.array().cast("array<string>")


def _broad(question: Column, words: Column) -> Column:
    table = F.create_map(*[x for t, q in L.TOPIC_EXPANSIONS.items() for x in (F.lit(t), F.array(*map(F.lit, q)))])
    phrase = F.when(F.size(words) >= 2, F.array(F.array_join(F.slice(words, 1, 6), " "))).otherwise(_none())
    return F.concat(phrase, F.flatten(F.transform(detected_topics(question), lambda t: F.element_at(table, t))))


def _pairs(words: Column) -> Column:
    """Up to four pairs of a content word with one of the next three."""
    n = F.size(words)
    of = lambda i: F.transform(F.sequence(i + 1, F.least(i + 3, n - 1)), lambda j: F.concat_ws(" ", F.get(words, i), F.get(words, j)))
    return F.when(n >= 2, F.slice(F.flatten(F.transform(F.sequence(F.lit(0), n - 2), of)), 1, 4)).otherwise(_none())


def queries(question: Column) -> Column:
    """The queries of a question, the question itself first; equal ones, whatever their case, once."""

    def of(words: Column) -> Column:
        mode = C.question_mode(question)
        bound_of = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, v in L.MODE_QUERIES.items() for x in (m, v[i])]), mode)
        made = T.distinct_ignoring_case(F.filter(F.transform(F.concat(F.array(question), F.when(mode == "FACT_LOOKUP", _lookup(question, words)).otherwise(_broad(question, words))), F.trim), lambda q: q != ""))

        def filled(q: Column) -> Column:
            more = F.slice(T.distinct_ignoring_case(F.concat(q, _pairs(words))), F.lit(1), bound_of(0))
            return F.slice(F.when(F.size(q) < bound_of(0), more).otherwise(q), F.lit(1), bound_of(1))

        return R.bound(made, filled)

    return R.bound(content_words(question), of)


def plans(questions: DataFrame, key: str, question: str = "question") -> DataFrame:
    """(key, mode, entity_lock, metric_lock, topics, queries) of every question; locks are those of fact lookups."""
    q = F.col(question)
    p = questions.select(key, F.explode(F.array(F.struct(C.question_mode(q).alias("mode"), detected_topics(q).alias("topics"), queries(q).alias("queries"), C.entity_lock(q).alias("e"), C.metric_lock(q).alias("m")))).alias("p"))
    lookup = F.col("p.mode") == "FACT_LOOKUP"
    return p.select(key, "p.mode", F.when(lookup, F.col("p.e")).alias("entity_lock"), F.when(lookup, F.col("p.m")).alias("metric_lock"), "p.topics", "p.queries")


def query_rows(plan: DataFrame, key: str) -> DataFrame:
    """(key, query_ord, query): a row for each query of a plan."""
    return plan.select(key, F.posexplode("queries").alias("query_ord", "query"))
