"""Keyword and pattern rules as Column expressions.

Matching follows one convention: keywords are case-folded substrings, patterns are case-insensitive searches,
and in a list of rules the first that matches wins.  Everything here stays inside the scan's codegen stage.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as L


def any_term(text: Column, terms: Iterable[str]) -> Column:
    """Whether a text holds any of the terms; false for a null text."""
    hit = lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False))
    return F.coalesce(bound(F.lower(text), hit), F.lit(False))


def term_hits(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms a text holds."""
    return F.coalesce(bound(F.lower(text), lambda low: sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))), F.lit(0))


def _may_match(text: Column, pattern: str, low: Column | None) -> Column | None:
    """What a match needs, found by plain searches; None where it is not known."""
    if low is None or (needs := L.NEEDS.get(pattern)) is None:
        return None
    return text.rlike(needs[0]) if needs is L.DIGIT else functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in needs])


def pattern_hits(text: Column, patterns: Iterable[str], low: Column | None = None) -> Column:
    """How many of the patterns a text matches.  With low, the text in lower case, those are passed over that it cannot match by L.NEEDS."""

    hit = lambda p: text.rlike(p) if (may := _may_match(text, p, low)) is None else may & text.rlike(p)
    return F.coalesce(sum((hit(p).cast("int") for p in patterns), F.lit(0)), F.lit(0))


def matches(text: Column, pattern: str, low: Column | None = None) -> Column:
    """How often a pattern matches; low as in pattern_hits."""
    n, may = F.regexp_count(text, F.lit(L.FASTER.get(pattern, pattern))), _may_match(text, pattern, low)
    return n if may is None else F.when(~may, 0).otherwise(n)


def digit_matches(text: Column, pattern: str) -> Column:
    """matches of a pattern that cannot match without a digit: most texts are passed over after a plain search."""
    return F.when(~text.rlike("[0-9]"), 0).otherwise(matches(text, pattern))


def loose(pattern: str) -> str:
    """A form of a pattern for Arrow's engine that matches every text which the pattern matches, and maybe more: without line
    anchors, and with blanks as Spark has them.  Word boundaries know ASCII only there, so none is missed beside an ASCII character.

    Not for look-arounds, possessive quantifiers and blanks inside classes."""
    flags = re.match(r"\(\?([ims]+)\)", pattern)
    body = re.sub(r"\\.|\[\^|[\^$]", lambda m: {r"\s": r"[\s\x0b]", "^": "", "$": ""}.get(m[0], m[0]), pattern[flags.end() :] if flags else pattern)
    return f"(?{'i' if flags and 'i' in flags[1] else ''}s:{body})"


def looked(text: Column, groups: Sequence[Sequence[str]], extra: Callable[[pa.Array], Iterable[pa.Array]] = lambda t: ()) -> Column:
    """A bit for every group of patterns: whether a text may match one of them, by loose; then the bits of extra.

    One pass of Arrow kernels, which do not backtrack; null for a null text.  extra is sent to the workers by value."""
    forms = ["|".join(map(loose, g)) for g in groups]

    @F.arrow_udf("int")
    def look(t: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        found = [pc.match_substring_regex(t, f) for f in forms] + list(extra(t))
        return functools.reduce(pc.add, (pc.multiply(b.cast(pa.int32()), pa.scalar(1 << i, pa.int32())) for i, b in enumerate(found)))

    return look(text)


def when(chain: Column | None, condition: Column, value: object) -> Column:
    """One more branch of a chain that may not have begun."""
    return F.when(condition, value) if chain is None else chain.when(condition, value)


def first_pattern(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first (label, pattern) that matches."""
    out = None
    for label, pattern in rules:
        out = when(out, text.rlike(pattern), label)
    return out.otherwise(default)


def first_terms(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str, every: bool = False) -> Column:
    """Label of the first (label, terms) of which the text holds any, or every, term."""

    def label(low: Column) -> Column:
        out = None
        for name, terms in rules:
            holds = [F.contains(low, F.lit(t.lower())) for t in terms]
            hit = functools.reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), holds, F.lit(every))
            out = when(out, F.coalesce(hit, F.lit(False)), name)
        return out.otherwise(default)

    return bound(F.lower(text), label)


def densest(text: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label with most terms in the text; the first of equals; default if there is none."""
    scored = [F.struct(term_hits(text, terms).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, terms) in enumerate(groups)]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["label"]).otherwise(default)


def labels(text: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """All labels of which the text holds a term, in the groups' order."""
    return F.array_compact(F.array(*[F.when(any_term(text, terms), label) for label, terms in groups]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it: plans stay small as well."""
    return F.get(F.transform(F.array(value), use), 0)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with a column that is generated, so that no later stage finds it again: a filter on a plain one would."""
    return rows.withColumn(name, F.explode(F.array(value)))
