"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Words are lower-cased (A-Z) and give SHINGLE-word shingles.  A window as long as a benchmark item that is similar to
it to ``similarity`` shares most of its shingles with it: of n shingles at least 2 n s / (1 + s).  Windows of every
item length are laid at every place where that many of their shingles are the benchmark's; at other places none can
reach the similarity, so no window is lost, however the item's parts are edited, moved or interrupted.

1. One narrow pass over the texts marks places whose shingle is in a bitmap of the benchmark's (sized by its
   shingles) and cuts out the regions dense enough to hold a window, as tiles of bounded width.  Documents stay behind.
2. Tiles' places are joined with the shingles themselves, by item length; the runs that are dense for a length give
   the windows' starts.
3. Each window gets a 64-bit SimHash of its shingles, weighted by how often they occur.  With ``radius`` + 1 blocks,
   two fingerprints within the radius agree in a block at least, so an equi-join on (length, block, value) finds all
   items within the radius of a window; equal windows are looked up once.
4. A pair is kept if its weighted Jaccard similarity, counted exactly, is at least ``similarity``.

Cases: null or empty texts and items match nothing; an item or text of fewer than SHINGLE words is one shingle of all
its words, so it matches only windows of just these words; a text shorter than an item is one window; repeated rows
and items are compared once by content and reported for every id; of windows equally similar the first is reported;
long texts are read whole; empty tables give no rows; other columns may have any names, as only the named ones are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import BLANKS, bound, bounded_broadcast, stash, words_of

SHINGLE = 5
#: The bitmap has 16 bits a shingle within these bounds; beyond them it only lets more places through.
LEAST_BITMAP, MOST_BITMAP = 1 << 16, 1 << 25
TILE = 1024
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    return F.when(F.btrim(low, F.lit(BLANKS)) == "", F.array().cast("array<string>")).otherwise(words_of(low))


def _shingles(words: str, k: int) -> Column:
    """Hashes of the k-word windows of an array column of at least k words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def items_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, n_words, k (shingle length) and grams of every item with words."""
    w = benchmark.select(F.col(item).alias("item"), _words(F.coalesce(F.col(text), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    grams = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE):
        grams = F.when(F.size("w") == k, _shingles("w", k)).otherwise(grams)
    grams = F.when(F.size("w") >= SHINGLE, _shingles("w", SHINGLE)).otherwise(grams)
    return w.select("item", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), grams.alias("grams"))


def _place(h: Column, bits: int) -> Column:
    return F.pmod(F.call_function("shiftright", h, F.lit(20)), F.lit(bits))


def bitmap(grams: DataFrame) -> tuple[Column, int]:
    """The shingles of column gram as a literal array of longs, and its number of bits."""
    bits = LEAST_BITMAP
    while bits < min(MOST_BITMAP, 16 * grams.count()):
        bits *= 2
    at = _place(F.col("gram"), bits)
    rows = grams.select(F.floor(at / 64).cast("int").alias("w"), (at % 64).cast("int").alias("b")).groupBy("w")
    words = [0] * (bits // 64)
    for r in rows.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("v")).collect():  # at most MOST_BITMAP / 64 rows
        words[r.w] = r.v
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>"), bits


def simhash(grams: str) -> Column:
    """64-bit SimHash of an array of shingle hashes; repeated ones count repeatedly."""
    ones = lambda b: F.size(F.filter(grams, lambda g: F.getbit(g, b) == 1))
    bits = [F.when(2 * ones(F.lit(b)) > F.size(grams), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _blocks(print_: str, radius: int) -> Column:
    """(block, value) of the radius + 1 blocks that cut 64 bits about evenly."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    cut = lambda a, b: F.call_function("shiftrightunsigned", F.col(print_), F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), cut(edges[i], edges[i + 1]).alias("value")) for i in range(n)])


def _numbered(grams: Column) -> Column:
    """The shingles, each with the number of its occurrence: a set in the place of a multiset."""
    return bound(F.array_sort(grams), lambda a: F.transform(a, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(a, x)).alias("i"))))


def _needed(items: Column, size: Column, similarity: float) -> Column:
    """Least number of shingles that a window of size shingles shares with an item if it is similar to it."""
    return F.ceil(similarity * (items + size) / (1 + similarity) - 1e-9).cast("int")


def _tiles(g: str, hits: Column, least: int, gap: int, width: int, longest: int) -> Column:
    """Tiles (at, n, grams) of the regions with at least ``least`` hits, in which hits are at most ``gap`` places apart."""

    def of_regions(p: Column, heads: Column) -> Column:
        after = lambda j: F.coalesce(F.get(heads, j + 1), F.size(p))
        regions = F.transform(heads, lambda h, j: F.struct(F.get(p, h).alias("first"), F.get(p, after(j) - 1).alias("last"), (after(j) - h).alias("hits")))
        low = lambda r: F.greatest(F.lit(0), r["first"] - gap)
        high = lambda r: F.least(F.size(g) - 1, r["last"] + gap)
        cut = lambda r, t: F.slice(g, t + 1, F.least(F.lit(width + longest), high(r) - t + 1))
        tiles = lambda r: F.transform(F.sequence(low(r), high(r), F.lit(width)), lambda t: F.struct(t.alias("at"), F.size(g).alias("n"), cut(r, t).alias("grams")))
        return F.flatten(F.transform(F.filter(regions, lambda r: r["hits"] >= least), tiles))

    def of_hits(p: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i) - F.get(p, i - 1) > gap + 1))
        return bound(heads, lambda h: of_regions(p, h))

    # arrays of one element bind what is used more than once
    return F.flatten(F.transform(F.filter(F.array(hits), lambda p: F.size(p) >= least), of_hits))


def tiles_of(docs: DataFrame, items: DataFrame, similarity: float, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """The tiles (id, key, k, at, n, grams) in which windows may lie; the number of starts in a tile by k."""
    w = docs.select(F.col(id_column).alias("id"), F.xxhash64(id_column, text).alias("key"), _words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    out, widths = None, {}
    for r in items.groupBy("k").agg(F.min(F.size("grams")).alias("least"), F.max(F.size("grams")).alias("most")).collect():  # at most SHINGLE rows
        held, bits = bitmap(items.filter(F.col("k") == r.k).select(F.explode("grams").alias("gram")).distinct())
        gap = int(r.most * (1 - similarity) / (1 + similarity)) + 1
        widths[r.k] = max(TILE, 4 * r.most)
        g = w.filter(F.size("w") >= r.k).select("id", "key", _shingles("w", r.k).alias("g"))
        bit = lambda h: F.getbit(F.get(held, F.floor(_place(h, bits) / 64).cast("int")), F.pmod(F.call_function("shiftright", h, F.lit(20)), F.lit(64)).cast("int")) == 1  # noqa: B023, E731
        hits = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: bit(F.get("g", i)))  # noqa: B023
        least = max(1, math.ceil(similarity * r.least - 1e-9))
        g = g.select("id", "key", F.lit(r.k).alias("k"), F.inline(_tiles("g", hits, least, gap, widths[r.k], r.most)))
        out = g if out is None else out.unionByName(g)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "id long, key long, k int, at int, n int, grams array<bigint>").withColumn("id", F.lit(None).cast(docs.schema[id_column].dataType))
    return out, widths


def windows_of(tiles: DataFrame, items: DataFrame, widths: dict[int, int], similarity: float) -> DataFrame:
    """(key, at, k, m, s, size): windows, laid for items of m shingles from place s of a tile, that hold enough of these items' shingles."""
    known = items.select("k", F.size("grams").alias("m"), F.explode("grams").alias("gram")).groupBy("k", "gram").agg(F.collect_set("m").alias("m"))
    known = bounded_broadcast(stash(known, "benchmark-shingles"), BROADCAST_ROWS)
    places = tiles.select("key", "at", "k", "n", F.size("grams").alias("long"), F.posexplode("grams").alias("p", "gram"))
    places = places.join(known, ["k", "gram"]).select("key", "at", "k", "n", "long", "p", F.explode("m").alias("m"))
    # a group is a tile's places, at most its width
    held = places.groupBy("key", "at", "k", "n", "long", "m").agg(F.array_sort(F.collect_set("p")).alias("p"))
    size = F.least("m", "n")
    held = held.withColumns({"size": size, "need": _needed(F.col("m"), size, similarity)})
    width = F.lit(1)
    for k, n in widths.items():
        width = F.when(F.col("k") == k, n).otherwise(width)
    # every window has one first hit, the i-th: it starts behind the one before, and holds need hits from there on
    spare = F.col("size") - F.col("need")
    low = lambda i: F.greatest(F.lit(0), F.coalesce(F.get("p", i - 1) + 1, F.lit(0)), F.get("p", i) - spare, F.get("p", i + F.col("need") - 1) - F.col("size") + 1)
    high = lambda i: F.least(F.get("p", i), width - 1, F.col("long") - F.col("size"))
    runs = F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda i: F.struct(low(i).alias("lo"), high(i).alias("hi")))
    starts = F.flatten(F.transform(F.filter(runs, lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"])))
    return held.filter(F.size("p") >= F.col("need")).select("key", "at", "k", "m", "size", F.explode(starts).alias("s"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8, radius: int = 20
) -> DataFrame:
    """Rows (id, key, item, at_word, n_words, similarity): for every document the best window of each item that it holds."""
    items = stash(items_of(benchmark, item, item_text), "benchmark-items")
    tiles, widths = tiles_of(docs, items, similarity, id_column, text)
    tiles = stash(tiles, "tiles")
    windows = windows_of(tiles.drop("id"), items, widths, similarity).distinct()
    windows = windows.join(tiles, ["key", "at", "k"]).withColumn("grams", F.slice("grams", F.col("s") + 1, F.col("size")))
    windows = windows.select("id", "key", "at", "k", "m", "s", "size", F.xxhash64("grams").alias("shape"), simhash("grams").alias("print"))
    windows = stash(windows, "windows")
    # windows of the same length and content are looked up once
    shapes = windows.groupBy("k", "m", "shape").agg(F.first("print").alias("print"), F.min(F.struct("key", "at", "s", "size")).alias("one"))
    shapes = stash(shapes, "window-prints")
    prints = stash(items.select("item", "k", F.size("grams").alias("m"), _numbered(F.col("grams")).alias("has"), simhash("grams").alias("item_print")), "item-prints")
    left = shapes.select("k", "m", "shape", "print", F.inline(_blocks("print", radius)))
    right = bounded_broadcast(prints.select("item", "k", "m", "item_print", F.inline(_blocks("item_print", radius))), BROADCAST_ROWS)
    pairs = left.join(right, ["k", "m", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pairs = stash(pairs.select("k", "m", "shape", "item").distinct(), "candidates")
    shown = shapes.select("k", "m", "shape", "one.*").join(tiles.select("key", "at", "k", "grams").dropDuplicates(["key", "at", "k"]), ["key", "at", "k"])
    shown = shown.select("k", "m", "shape", _numbered(F.slice("grams", F.col("s") + 1, F.col("size"))).alias("a"))
    pairs = pairs.join(shown, ["k", "m", "shape"]).alias("p").join(prints.select("item", "k", "m", "has").alias("q"), (F.col("p.item").eqNullSafe(F.col("q.item"))) & (F.col("p.k") == F.col("q.k")) & (F.col("p.m") == F.col("q.m")))
    both = F.size(F.array_intersect("a", "has"))
    pairs = pairs.select("p.k", "p.m", "shape", "p.item", both.alias("least"), (F.size("a") + F.size("has") - both).alias("most")).filter(F.col("least") >= F.lit(similarity) * F.col("most"))
    pairs = stash(pairs.select("k", "m", "shape", "item", (F.col("least") / F.col("most")).alias("similarity")).distinct(), "verified")
    found = windows.join(bounded_broadcast(pairs, BROADCAST_ROWS), ["k", "m", "shape"])
    place = F.col("at") + F.col("s")
    best = F.max_by(F.struct(place.alias("at"), (F.col("size") + F.col("k") - 1).alias("n_words"), "similarity"), F.struct("similarity", -place)).alias("b")
    return found.groupBy("id", "key", "item").agg(best).select("id", "key", "item", F.col("b.at").alias("at_word"), "b.n_words", F.round("b.similarity", 6).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    bad = stash(contaminated(docs, benchmark, id_column, text, **options).select(F.col("key").alias("__bad")).distinct(), "contaminated")
    bad = bounded_broadcast(bad, BROADCAST_ROWS)
    return docs.join(bad, F.xxhash64(docs[id_column], docs[text]) == bad["__bad"], "left_anti")
