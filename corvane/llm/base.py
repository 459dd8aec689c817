"""Shared plumbing: text conventions, size-checked broadcasts, folds over arrays; scratch tables come from the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.rules import bound
from corvane.sources.scratch import scratch_path, spread, stash

__all__ = ["BLANKS", "BLANK_RE", "WORD_RE", "before_each", "bound", "bounded_broadcast", "fold", "scratch_path", "stash", "table", "text_or_empty", "words_of"]

#: ASCII blanks separate words everywhere in this package.
BLANKS = " \t\n\x0b\f\r"
BLANK_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name == "documents" else read


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the split into learning and held-out rows; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(text: Column) -> Column:
    """Array of the words of a text; [''] for a text without words (see word_count)."""
    return F.split(F.btrim(text, F.lit(BLANKS)), BLANK_RE)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only where a count proves that df has at most max_rows; else the planner shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def before_each(values: Column, start: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array the fold of those before it, in blocks of about the square root of their number."""

    def of(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda j: F.aggregate(F.slice(v, j * width + 1, width), start, plus))
        heads = lambda s: F.transform(s, lambda _, j: F.aggregate(F.slice(s, F.lit(1), j), start, plus))
        inner = lambda h: F.transform(v, lambda _, i: F.aggregate(F.slice(v, i - i % width + 1, i % width), F.get(h, F.floor(i / width).cast("int")), plus))
        return bound(sums, lambda s: bound(heads(s), inner))

    return F.when(F.size(values) > 0, bound(values, of)).otherwise(F.slice(values, 1, 0))
