"""Many terms at once: which terms of a vocabulary table the texts hold.

A term is held if the lower-cased text contains it lower-cased, as in ``rules.any_term``; but the work does not grow with the
vocabulary.  A vocabulary within AUTOMATON_TERMS and AUTOMATON_BYTES, counted first, becomes an automaton that each task
builds from a broadcast list and runs over its texts once.  A larger one stays a table: every term is indexed by the run of
1, 2, 3, 6, 12 or 24 characters of it (the longest that it has) that fewest terms hold, a text's runs of these lengths meet
the index by join, and what they propose is searched for in the text.  Both ways give the same labels.

Cases: null texts hold nothing; null and empty terms are held by no text; equal terms of several labels give them all; labels
are distinct and sorted; repeated rows are judged row by row; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.scratch import bounded_broadcast, stash

AUTOMATON_TERMS, AUTOMATON_BYTES = 200_000, 16 << 20
BROADCAST_ROWS = 100_000
#: Lengths of the runs that terms are indexed by: long terms that share their beginnings differ in long runs only.
RUNS = (24, 12, 6, 3, 2, 1)


def _by_automaton(rows: DataFrame, text: str, terms: list[tuple[str, list[str]]], out: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    kept = rows.withColumn("__low", F.lower(F.col(text)))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, labels in shared.value:
            found.add_word(term, labels)
        found.make_automaton()
        for batch in batches:
            held = []
            for low in batch.column(len(names)).to_pylist():
                seen: set[str] = set()
                for _, labels in found.iter(low) if low and len(found) else ():
                    seen.update(labels)
                held.append(sorted(seen))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(held, pa.list_(pa.string()))], names=[*names, out])

    schema = rows.withColumn(out, F.array().cast("array<string>")).schema
    return kept.mapInArrow(run, schema)


def _runs(low: Column, n: int) -> Column:
    """Hashes of all runs of n characters; equal hashes of others only propose terms in vain."""
    return F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda x: F.xxhash64(x)))


def _run_length(low: Column) -> Column:
    return F.coalesce(*[F.when(F.length(low) >= n, n) for n in RUNS])


def _grams(low: Column) -> Column:
    """What can be the key of a term: all its runs of the greatest length that it has."""
    return F.coalesce(*[F.when(F.length(low) >= n, _runs(low, n)) for n in RUNS])


def _by_index(rows: DataFrame, text: str, vocabulary: DataFrame, out: str) -> DataFrame:
    terms = vocabulary.select("low").distinct()
    keys = terms.select("low", F.explode(_grams(F.col("low"))).alias("gram"))
    rare = keys.groupBy("gram").agg(F.count("*").alias("n"))
    index = keys.join(rare, "gram").groupBy("low").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    index = stash(index, "terms")
    kept = stash(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    low = F.lower(F.col(text))
    lengths = [r.n for r in index.select(_run_length(F.col("low")).alias("n")).distinct().collect()]  # six at most
    pieces = F.array_distinct(F.concat(F.array().cast("array<long>"), *[_runs(low, n) for n in lengths]))
    met = kept.select("__row", F.explode(pieces).alias("gram")).join(bounded_broadcast(index, BROADCAST_ROWS), "gram").select("__row", F.col("low").alias("term"))
    proposed = met.groupBy("__row").agg(F.collect_set("term").alias("terms"))
    held = kept.join(proposed, "__row").select("__row", F.explode(F.filter("terms", lambda t: F.contains(low, t))).alias("low"))
    labels = held.join(bounded_broadcast(vocabulary, BROADCAST_ROWS), "low").groupBy("__row").agg(F.sort_array(F.collect_set("label")).alias(out))
    return kept.join(labels, "__row", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).select(*rows.columns, out)


def labelled(rows: DataFrame, text: str, vocabulary: DataFrame, term: str = "term", label: str = "label", out: str = "labels") -> DataFrame:
    """rows with out, the sorted labels of the terms that the text holds.  vocabulary: term and label, a row each."""
    v = vocabulary.select(F.lower(F.col(term)).alias("low"), F.col(label).cast("string").alias("label")).filter("low <> '' and label is not null").distinct()
    v = stash(v, "vocabulary")
    n, size = v.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("low") + F.octet_length("label")), F.lit(0))).first()
    if n <= AUTOMATON_TERMS and size <= AUTOMATON_BYTES:
        terms = v.groupBy("low").agg(F.collect_list("label").alias("labels")).collect()  # bounded by the count
        return _by_automaton(rows, text, [(r.low, list(r.labels)) for r in terms], out)
    return _by_index(rows, text, v, out)
