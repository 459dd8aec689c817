"""Chunks of documents.

A document of at most ``most`` characters is one chunk.  Longer ones are cut by one pattern that matches chunk after chunk: up
to the first end in [pos + target, pos + most), else up to the last one before it, else most characters.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T

def _cuts(target: int, most: int) -> str:
    """A pattern whose matches are the chunks of a text: the rest if it is short enough, up to the first end from target on, up to
    the last one before it, or most characters."""
    end = r"(?<=[.!?])(?=[ \t\n\x0b\f\r])"
    parts = [rf".{{1,{most}}}\z", rf".{{{target},{most - 1}}}?{end}" if target < most else "", rf".{{1,{min(target, most) - 1}}}{end}" if min(target, most) > 1 else "", f".{{{most}}}"]
    return "(?s)" + "|".join(filter(None, parts))


def chunk_list(text: Column, target: int, most: int) -> Column:
    """array<struct<start, end, text>> of a text that is not empty."""
    made = lambda start, end, t: F.struct(start.alias("start"), end.alias("end"), t.alias("text"))
    none = F.expr("cast(array() as array<int>)")

    def placed(cut: Column) -> Column:
        n = F.transform(cut, F.length)
        ends = F.aggregate(n, none, lambda ends, x: F.array_append(ends, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + x))
        return R.bound(ends, lambda e: F.zip_with(cut, F.zip_with(e, n, lambda at, x: F.struct((at - x).alias("start"), at.alias("end"))), lambda t, c: made(c["start"], c["end"], t)))

    long_ = R.bound(F.regexp_extract_all(text, F.lit(_cuts(target, most)), F.lit(0)), placed)
    return F.when(F.length(text) <= most, F.array(made(F.lit(0), F.length(text), text))).otherwise(long_)


def chunks(docs: DataFrame, target: int = 7000, most: int = 8000, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep, chunk_number from 1, start_offset, end_offset, chunk_text); empty and null texts have no chunks.  One narrow pass."""
    full = docs.select(key, *keep, F.col(text).alias("__t")).filter(F.length("__t") > 0)
    c = full.select(key, *keep, F.posexplode(chunk_list(F.col("__t"), target, most)).alias("__n", "__c"))
    return c.select(key, *keep, (F.col("__n") + 1).alias("chunk_number"), F.col("__c.start").alias("start_offset"), F.col("__c.end").alias("end_offset"), F.col("__c.text").alias("chunk_text"))


def chunk_id(name: Column, number: Column) -> Column:
    return F.concat(F.left(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit(24)), F.format_string("_C%03d", number))


def windows(text: Column, size: int, step: int) -> Column:
    """Windows of a text at every step, trimmed; made of short pieces, so that no window is sought from the text's start."""
    unit = math.gcd(size, step)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    cut = lambda parts: F.transform(starts, lambda i: F.trim(F.array_join(F.slice(parts, F.floor(i / unit).cast("int") + 1, F.lit(size // unit)), "")))
    return R.bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{unit}}}"), F.lit(0)), cut)


def _first_by_prefix(pieces: Column, most: int) -> Column:
    """The first 500 characters of up to most pieces, the first of those equal in 100 characters."""
    heads = lambda s: F.transform(s, lambda x: F.left(x, F.lit(100)))
    pick = lambda s, h: F.transform(F.slice(F.array_distinct(h), 1, most), lambda x: F.left(F.get(s, (F.array_position(h, x) - 1).cast("int")), F.lit(500)))
    return R.bound(pieces, lambda s: R.bound(heads(s), lambda h: pick(s, h)))


def _of_topics(pieces: Column, groups: Sequence[tuple[str, Sequence[str]]], most: int, wanted: Column) -> Column:
    """For every topic its snippets among the pieces, as an array of arrays; none for topics that are not wanted (an array)."""
    low = F.transform(pieces, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    none = F.array().cast("array<string>")

    def holding(p: Column, terms: Sequence[str]) -> Column:
        hit = lambda x: functools.reduce(lambda a, b: a | b, [F.contains(x["low"], F.lit(t.lower())) for t in terms], F.lit(False))
        return F.transform(F.filter(p, hit), lambda x: x["x"])

    lists = lambda p: F.array(*[F.when(F.get(wanted, i), _first_by_prefix(holding(p, terms), most)).otherwise(none) for i, (_, terms) in enumerate(groups)])
    return F.when(F.exists(wanted, lambda w: w), R.bound(low, lists)).otherwise(F.array(*[none for _ in groups]))


def _held(text: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """For every topic whether a text may hold a term of it, anywhere.  Lower case goes by the place of a letter for sigma only."""
    hit = lambda low, t: F.lit(True) if set(t.lower()) & set("σς") else F.contains(low, F.lit(t.lower()))
    return R.bound(F.lower(text), lambda low: F.array(*[functools.reduce(lambda a, b: a | b, [hit(low, t) for t in terms], F.lit(False)) for _, terms in groups]))


def topic_lists(text: Column, groups: Sequence[tuple[str, Sequence[str]]], most: int = 4) -> Column:
    """For every topic (snippets, window) of a compacted text: sentences that hold a term, else windows that do.

    Pieces are tried for the topics only of which the whole text holds a term."""

    def chosen(held: Column, direct: Column) -> Column:
        missing = F.zip_with(held, direct, lambda h, d: h & (F.size(d) == 0))
        around = R.bound(missing, lambda m: _of_topics(windows(text, 500, 400), groups, most, m))
        return F.zip_with(direct, around, lambda d, w: F.struct(F.when(F.size(d) > 0, d).otherwise(w).alias("snippets"), (F.size(d) == 0).alias("window")))

    return R.bound(_held(text, groups), lambda h: R.bound(_of_topics(T.sentences(text, 40, compacted=True), groups, most, h), lambda d: chosen(h, d)))


def topic_sentences(docs: DataFrame, groups: Sequence[tuple[str, Sequence[str]]], most: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, topic, n, snippet, window): up to most sentences per topic that hold a term, distinct in 100 characters.

    A document without such a sentence for a topic gives windows of 500 characters at every 400 instead.  One narrow pass."""
    d = docs.select(key, T.compact(F.col(text)).alias("__t"))
    d = d.select(key, F.posexplode(topic_lists(F.col("__t"), groups, most)).alias("__i", "__l"))
    names = F.array(*[F.lit(name) for name, _ in groups])
    d = d.select(key, F.get(names, F.col("__i")).alias("topic"), F.col("__l.window").alias("window"), F.posexplode("__l.snippets").alias("n", "snippet"))
    return d.select(key, "topic", (F.col("n") + 1).alias("n"), "snippet", "window")


def first_topic_chunk(text: Column, terms: Sequence[str]) -> Column:
    """The first sentence of a compacted text that holds a term, else the first window of 500 characters that does, else its
    first 500 characters if a term spans two windows; null without a term."""
    holding = lambda pieces: F.get(F.filter(pieces, lambda x: R.any_term(x, terms)), 0)
    found = F.coalesce(F.left(holding(T.sentences(text, 40, compacted=True)), F.lit(500)), holding(windows(text, 500, 500)), F.left(text, F.lit(500)))
    return F.when(R.any_term(text, terms), found)


def snippet_list(text: Column, least: int, most: int) -> Column:
    """Sentences of a compacted text, at most ``most``; if there are fewer than least, its windows of 500 characters fill up,
    then the first and the last two thirds of it."""
    sentences = F.slice(F.transform(T.sentences(text, 40, compacted=True), lambda x: F.left(x, F.lit(500))), 1, most)
    plus = lambda s, more: F.concat(s, F.slice(F.array_except(more, s), F.lit(1), F.greatest(least - F.size(s), F.lit(0))))
    pieces = F.filter(windows(text, 500, 500), lambda x: F.length(x) >= 40)
    width = F.least(F.length(text), F.greatest(F.lit(40), F.floor(F.length(text) * 2 / 3).cast("int")))
    ends = F.array(F.trim(F.left(text, width)), F.trim(F.right(text, width)))

    def filled(s: Column) -> Column:
        wide = F.when(F.length(text) >= 40, ends).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(s) >= least, s).otherwise(F.slice(R.bound(plus(s, pieces), lambda x: plus(x, wide)), 1, most))

    return R.bound(sentences, filled)


def snippets(docs: DataFrame, least: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n from 0, snippet) of snippet_list."""
    return docs.select(key, T.compact(F.col(text)).alias("__t")).select(key, F.posexplode(snippet_list(F.col("__t"), least, most)).alias("n", "snippet"))
