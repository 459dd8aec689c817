"""Scalar text functions as Column expressions.

Sentence ends are marked rather than looked behind for, which gives the same pieces; half-way roundings go up.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R


def compact(text: Column) -> Column:
    """Blanks collapsed to single spaces, ends trimmed.  Patterns are left to texts with a run of them."""
    spaced = functools.reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit(" ")), "\t\n\x0b\f\r", text)
    return F.trim(R.bound(spaced, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t)))


def sentences(text: Column, least: int = 0, compacted: bool = False) -> Column:
    """Pieces between sentence ends, of at least so many characters; of a compacted text without a pattern."""
    marked = functools.reduce(lambda t, end: F.replace(t, F.lit(f"{end} "), F.lit(f"{end}\u0001")), ".!?", text) if compacted else F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    cut = F.split(marked, "\u0001")
    return F.filter(cut, lambda s: F.length(s) >= least) if least else cut


def tokens(text: Column, pattern: str, stop: Sequence[str] = (), least: int = 1, distinct: bool = False) -> Column:
    """Lower-cased matches of a pattern without stop words and short ones."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    kept = F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop)) if stop else F.filter(found, lambda w: F.length(w) >= least)
    return F.array_distinct(kept) if distinct else kept


def keywords(text: Column) -> Column:
    return tokens(text, "[a-z][a-z0-9-]{2,}", L.QUESTION_STOP, distinct=True)


def query_terms(text: Column) -> Column:
    return tokens(text, "[a-z][a-z0-9'-]*", L.QUERY_STOP, 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def fingerprint(text: Column) -> Column:
    """Of a statement: first 16 hex digits of the SHA-256 of its lower-cased words."""
    return F.substring(F.sha2(F.lower(compact(text)), 256), 1, 16)


def source_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def file_hash(content: Column) -> Column:
    """Of a file's bytes."""
    return F.sha2(content, 256)


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1))


def html_text(html: Column) -> Column:
    """Readable text of a page: scripts, styles, navigation and tags go, entities are decoded."""
    t = html
    for tag in ("script", "style", "nav", "header", "footer", "aside", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return compact(t)


def first_pages(text: Column, pages: int) -> Column:
    """Up to the mark of page pages + 1, or so many times 3000 characters."""
    at = F.instr(text, f"[Page {pages + 1}]")
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.substring(text, 1, pages * 3000))


def pdf_date(value: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(value, r"^D?:?(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def organisation(notice: Column) -> Column:
    """Name in a copyright notice; null if three characters or fewer remain."""
    t = F.trim(F.regexp_replace(notice, r"(?i)^(?:©|copyright\s*©?)\s*(?:\d{4}[-–]\d{4}|\d{4})\s*", ""))
    t = F.regexp_replace(t, r"(?i)\.\s*(?:all rights reserved|used under).*$", "")
    t = F.trim(F.regexp_replace(t, r"[.,;]+$", ""))
    return F.when(F.length(t) > 3, t)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def claim_text(snippet: Column, category: Column) -> Column:
    t = R.bound(compact(snippet), lambda t: F.when(F.length(t) > 180, F.concat(F.rtrim(F.substring(t, 1, 177)), F.lit("..."))).otherwise(t))
    return F.concat(capitalised(category), F.lit(" note: "), t)


def confidence(snippet: Column, score: Column) -> Column:
    n = F.length(snippet)
    return F.when((score >= 3) & (n >= 80), "high").when((score >= 1) & (n >= 60), "medium").otherwise("low")


#: What a relevance says: before and after the terms held, without them if there is a score, and else.
RELEVANCE = ("Directly relevant to the question through these terms: ", ".", "Relevant as infrastructure context for the question.", "Indirect context; review against stronger source evidence before relying on it.")


def relevance(snippet: Column, terms: Sequence[str], score: Column) -> Column:
    held = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), t) for t in sorted(terms)]))

    def said(found: Column) -> Column:
        return (
            F.when(F.size(found) > 0, F.concat(F.lit(RELEVANCE[0]), F.array_join(F.slice(found, 1, 5), ", "), F.lit(RELEVANCE[1])))
            .when(score > 0, RELEVANCE[2])
            .otherwise(RELEVANCE[3])
        )

    return R.bound(R.bound(F.lower(snippet), held), said)


def garbled(text: Column) -> Column:
    """Fewer than 50 characters, or under 70 % of them printable (line ends and tabs are not)."""
    shown = F.length(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""))
    return (F.length(F.trim(text)) < 50) | (shown / F.greatest(F.length(text), F.lit(1)) < 0.70)


def condensed(text: Column, n_sentences: int, n_chars: int) -> Column:
    return F.left(F.array_join(F.slice(sentences(compact(text)), 1, n_sentences), " "), F.lit(n_chars))


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of every item, in order."""
    return F.aggregate(
        items,
        F.array().cast("array<string>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.array_append(kept, x)),
    )


def recommendation_id(value: Column) -> Column:
    n = F.regexp_extract(value, r"(\d+)", 1)
    return F.when(n != "", F.format_string("REC-%03d", n.cast("int"))).otherwise(value)


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(L.CITATION), F.lit(1))


def window(text: Column, at: Column, before: int, after: int) -> Column:
    """Characters around a 0-based place."""
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text, start + 1, at - start + after)


def sentence_at(text: Column, at: Column) -> Column:
    """Sentence around a 0-based place: from after the last end mark before it to the first one after it."""
    head = F.regexp_extract(F.substring(text, F.lit(1), at), r"([^.!?\n]*)$", 1)
    tail = F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"^(.[^.!?\n]*[.!?\n]?)", 1)
    return F.trim(F.concat(head, tail))


def json_value(text: Column) -> Column:
    """First candidate in a free text that is JSON: fenced block, whole text, outermost braces, outermost brackets."""
    candidates = [
        F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1),
        F.trim(text),
        F.regexp_extract(text, r"(?s)(\{.*\})", 1),
        F.regexp_extract(text, r"(?s)(\[.*\])", 1),
    ]
    return F.coalesce(*[F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), F.trim(c)) for c in candidates])


def string_list(value: Column) -> Column:
    """A list that may have come as a JSON string."""
    return F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))


def url_slug(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def score_text(text: Column) -> Column:
    return F.translate(F.lower(text), "_-", "  ")


def numbered(prefix: str, n: Column) -> Column:
    """E001, C012, G1234: an id from a prefix and a number."""
    return F.format_string(f"{prefix}%03d", n)
