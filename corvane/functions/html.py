"""Main text of web pages by the density of their blocks.

A page is cut into blocks at its block elements.  A block weighs as many points as it has words, less two for each word
inside a link and less LEAST; headings weigh nothing, so that they neither begin nor break a run unless text follows.  The
main text is the run of neighbouring blocks with the greatest sum: menus, link lists and short boxes before and after it
pull the sum down.  A page without such a run gives its blocks that are no link lists.  All of it is Column expressions, in
one pass over a page's blocks.

Cases: null gives null; a page without text gives ''; of equal runs the one that ends first, then the one that begins
first; unclosed comments and scripts are kept as text, an unclosed link counts up to its block's end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import rules as R
from corvane.functions import text as T

#: Words that a block needs to speak for itself.
LEAST = 10
#: Elements without readable text, and those of navigation.
SILENT = ("head", "script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form")
BLOCK = "address|article|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|header|hr|html|li|main|ol|p|pre|section|table|tbody|td|th|thead|tr|ul"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# marks within the text of a page: a block's end, a link's two ends, a heading
END, LINK, UNLINK, HEAD = "\x01", "\x02", "\x03", "\x04"
#: (pattern, replacement), one after the other.
STEPS = (
    ("[\x01-\x04]", " "),
    (r"(?s)<!--.*?-->", " "),
    *((rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", END) for tag in SILENT),
    (r"(?i)<h[1-6]\b[^>]*>", END + HEAD),
    (rf"(?i)</?(?:h[1-6]|{BLOCK})\b[^>]*>", END),
    (r"(?i)<a\b[^>]*>", LINK),
    (r"(?i)</a\s*>", UNLINK),
    (r"<[^>]+>", ""),
)
WORD = r"\S+"


def marked(html: Column) -> Column:
    """The page's text with marks in place of its tags."""
    t = html
    for pattern, by in STEPS:
        t = F.regexp_replace(t, pattern, by)
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def blocks(html: Column) -> Column:
    """array<struct<text, words, linked, points>> of a page's blocks that hold text, in order."""
    linked = lambda b: F.regexp_count(F.array_join(F.regexp_extract_all(b, F.lit("\x02([^\x03]*)"), F.lit(1)), " "), F.lit(WORD))

    def block(b: Column) -> Column:
        text = T.compact(F.regexp_replace(b, "[\x02-\x04]", ""))
        words = F.regexp_count(text, F.lit(WORD))
        points = F.when(F.contains(b, F.lit(HEAD)), F.lit(0)).otherwise(words - LEAST) - 2 * linked(b)
        return F.struct(text.alias("text"), words.alias("words"), linked(b).alias("linked"), points.alias("points"))

    return F.filter(F.transform(F.split(marked(html), END), block), lambda b: b["text"] != "")


def best_run(points: Column) -> Column:
    """struct<best, first, last>: the run of greatest sum in an array of numbers, with places from 0; best is 0 if no sum is above."""
    zero = F.struct(*[F.lit(v).alias(k) for k, v in (("sum", 0), ("from", 0), ("at", 0), ("best", 0), ("first", -1), ("last", -1))])

    def step(s: Column, p: Column) -> Column:
        fresh = s["sum"] < 0
        total, start = F.when(fresh, p).otherwise(s["sum"] + p), F.when(fresh, s["at"]).otherwise(s["from"])
        better = total > s["best"]
        pick = lambda new, k: F.when(better, new).otherwise(s[k]).alias(k)
        return F.struct(total.alias("sum"), start.alias("from"), (s["at"] + 1).alias("at"), pick(total, "best"), pick(start, "first"), pick(s["at"], "last"))

    return F.aggregate(points, zero, step)


def main_text(html: Column) -> Column:
    """The main text, its blocks parted by line ends."""

    def chosen(b: Column) -> Column:
        texts = lambda x: F.array_join(F.transform(x, lambda y: y["text"]), "\n")
        plain = F.filter(b, lambda y: 2 * y["linked"] < y["words"])
        run = lambda r: F.when(r["best"] > 0, texts(F.slice(b, r["first"] + 1, F.greatest(r["last"] - r["first"] + 1, F.lit(0))))).otherwise(texts(plain))
        return R.bound(best_run(F.transform(b, lambda y: y["points"])), run)

    return R.bound(blocks(html), chosen)


def language(html: Column) -> Column:
    """Primary language that a page declares; 'und' if it declares none."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z]+)""", 1))
    return F.when(found != "", found).otherwise("und")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
