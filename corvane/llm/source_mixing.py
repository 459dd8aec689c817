"""Mixing sources to target weights, in DataFrame functions only.

The words of a source, document after document in a pseudorandom but fixed order, are packed into blocks of
``block`` words; only the last block of a source may be shorter.  Weights give each source a target, cut at ``max_repeats`` times its size; what is cut is
shared out again by weight.  The output is a row of slots of one block each, dealt to shards of ``shard_slots``.
Every shard draws multinomial counts of the sources; draws beyond a source's quota of slots are returned and
fill the quotas that came out short (about the square root of the slots; they form one more shard).  The k-th
slot of a source takes the block at the k-th place of the source's permutation (swap-or-not shuffle of the
indexes of full blocks, another one for every pass over the source, which the short block closes), and blocks are joined by
index.  So a source's taken words differ from its target by half a block at most.  The mix itself, a row
of (shard, slot, sid, block, words, parts) for every slot, is written as Parquet; a shard is its rows by slot, in
which the sources are shuffled.  Words of a block are joined by one blank.

Offsets come from two levels of running sums (buckets of a source, documents of a bucket), so no task holds a source: a
document is cut at its source's block edges where its bucket was gathered, and the pieces meet where the blocks are joined.
Blocks that no slot takes are left out before that: whether a slot does follows from the inverse of the permutation.
The result depends on the rows only: reruns agree.

Cases: a null text has size 0 and is never taken; a null source is a source and sorts last; a source without
words has target 0; rows equal in id and text are interchangeable, so repeated rows share what is taken; sources of
equal cap by weight go by code point; long texts are cut whole into blocks; an empty table gives an empty result; other
columns may have any names, as only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.base import BLANKS, bound, bounded_broadcast, stash, words_of

WEIGHTS = (5, 2, 1)
ROUNDS = 24
#: Seed of the draws; those of the permutations of sources and of shards are so much above it.
SEED, OF_SOURCE, OF_SHARD = 20, 7, 11
BROADCAST_ROWS = 10_000
#: A source has a bucket for so many words; a very large one has wider buckets, so that their running sum fits a task.
BUCKET_WORDS, MOST_BUCKETS = 1 << 17, 1 << 16


def sizes(docs: DataFrame, keep: tuple[str, ...], source: str = "source", text: str = "text") -> DataFrame:
    t = F.coalesce(docs[text], F.lit(""))
    words = F.when(F.btrim(t, F.lit(BLANKS)) == "", 0).otherwise(F.size(words_of(t)))
    return docs.select(*keep, docs[source].alias("__source"), t.alias("__text"), F.xxhash64(t).alias("__t"), words.cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """One row a source: index sid in code point order (null last), source_size, weight and target.

    Capped sources are the first ones by cap/weight; the rest share what is left by weight."""
    s = sized.groupBy("__source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("__source"))
    s = s.withColumn("sid", F.row_number().over(in_order) - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("sid") % len(weights)).cast("long")).withColumn("cap", max_repeats * F.col("source_size"))
    everyone = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = everyone.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    s = s.withColumns({
        "left": F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "load": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("load")
    s = s.withColumn("at", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "sid", "left", "load"))).over(all_rows))
    capped = (F.col("cap") / F.col("weight") < F.col("at.col1")) | ((F.col("cap") / F.col("weight") == F.col("at.col1")) & (F.col("sid") < F.col("at.sid")))
    share = F.col("weight") * F.col("at.left") / F.col("at.load")
    return s.select("__source", "sid", "source_size", "weight", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _bucketed(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows (with sid and source_size) with __h, their place in the pseudorandom order, and their bucket."""
    buckets = F.least(F.ceil(F.col("source_size") / BUCKET_WORDS), F.lit(MOST_BUCKETS))
    return rows.withColumn("__h", F.xxhash64(*[F.col(c) for c in keep], "size", "__t")).withColumn("__bucket", F.pmod("__h", F.greatest(buckets, F.lit(1))))


def bucket_starts(narrow: DataFrame) -> DataFrame:
    """For every bucket (sid, __bucket) with words: first, the offset of its first word in the source.

    narrow: bucketed rows without their texts."""
    sums = narrow.filter("size > 0").groupBy("sid", "__bucket").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("sid").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("sid", "__bucket", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("first"))


def packed(bucketed: DataFrame, buckets: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """off, the offset in its source's stream of words, of every document with words; the text goes along."""
    # the same as size > 0, which would split the words once more in the filter
    d = bucketed.filter(F.btrim("__text", F.lit(BLANKS)) != "")
    inside = Window.partitionBy("sid", "__bucket").orderBy("__h", *keep, "size", "__t").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(bounded_broadcast(buckets, BROADCAST_ROWS), ["sid", "__bucket"])
    return d.withColumn("off", F.col("first") + F.col("__inside")).drop("__h", "__t", "__inside", "first")


def round_keys(n: Column, *key: Column, seed: int = 0) -> Column:
    """(key, salt) of every round of the permutation of 0..n-1 that the key columns select."""
    made = lambda r: F.struct(F.pmod(F.xxhash64(F.lit(seed), *key, r), n).alias("key"), F.xxhash64(F.lit(seed + 1), *key, r).alias("salt"))
    return F.transform(F.array(*[F.lit(r) for r in range(ROUNDS)]), made)


def permuted(x: Column, n: Column, rounds: Column) -> Column:
    """Place of x in a permutation of 0..n-1: the swap-or-not shuffle, by the rounds' keys."""

    def swap(v: Column, r: Column) -> Column:
        partner = F.pmod(r["key"] - v, n)
        return F.when(F.xxhash64(F.greatest(v, partner).bitwiseXOR(r["salt"])) % 2 == 0, partner).otherwise(v)

    return F.aggregate(rounds, x, swap)


def place_of(x: Column, n: Column, rounds: Column) -> Column:
    """The place that permuted puts at x: every round is its own inverse, so they are gone through backwards."""
    return permuted(x, n, F.reverse(rounds))


def picks(quotas: DataFrame, shard_slots: int = 65_536, seed: int = SEED) -> DataFrame:
    """One row for every output slot: shard, slot, sid and block.  quotas: sid, blocks, full (of them, at full length), slots."""
    spark = quotas.sparkSession
    w = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    q = quotas.filter("slots > 0").withColumn("lo", F.coalesce(F.sum("slots").over(w), F.lit(0))).withColumn("hi", F.col("lo") + F.col("slots"))
    total = q.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return quotas.select(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("block")).limit(0)
    width = max(1, -(-total // 1024))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = q.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total))
    drawn = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / shard_slots).alias("shard"), u.alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    drawn = drawn.join(cells, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    drawn = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(by_source), F.lit(0)))
    drawn = drawn.join(q.select("sid", "slots"), "sid").withColumn("last", F.least(F.col("first") + F.col("n"), "slots"))
    runs = drawn.filter("first < last").select("shard", "sid", "first", "last")
    got = drawn.groupBy("sid").agg(F.sum("n").alias("n"))
    short = q.join(got, "sid", "left").select(F.lit(total // shard_slots + 1).alias("shard"), "sid", F.coalesce("n", F.lit(0)).alias("first"), F.col("slots").alias("last"))
    # even pieces, so that no task gets a long run
    piece = 4096
    runs = runs.unionByName(short.filter("first < last"))
    in_shard = Window.partitionBy("shard")
    here = F.col("last") - F.col("first")
    runs = runs.withColumns({"filled": F.sum(here).over(in_shard), "place": F.sum(here).over(in_shard.orderBy("sid")) - F.col("last")})  # place + k: a row of the shard
    runs = runs.select("shard", "sid", "filled", "place", "last", F.explode(F.sequence("first", F.col("last") - 1, F.lit(piece).cast("long"))).alias("first"))
    runs = runs.repartition(parts, "sid", "first").join(q.select("sid", "blocks", "full"), "sid")
    # the rounds' keys are made once a run of slots, and for every pass over the source
    runs = runs.withColumn("in_shard", round_keys(F.col("filled"), F.col("shard"), seed=seed + OF_SHARD))
    passes = F.sequence(F.floor(F.col("first") / F.col("blocks")), F.floor((F.least(F.col("first") + piece, "last") - 1) / F.col("blocks")))
    runs = runs.withColumn("in_source", F.transform(passes, lambda e: round_keys(F.greatest("full", F.lit(1)), F.col("sid"), e, seed=seed + OF_SOURCE)))

    def slot(k: Column) -> Column:
        epoch = (F.floor(k / F.col("blocks")) - F.floor(F.col("first") / F.col("blocks"))).cast("int")
        x = k % F.col("blocks")
        block = F.when(x < F.col("full"), permuted(x, F.greatest("full", F.lit(1)), F.get("in_source", epoch))).otherwise(x)
        return F.struct(permuted(F.col("place") + k, F.col("filled"), F.col("in_shard")).alias("slot"), block.alias("block"))

    places = F.sequence("first", F.least(F.col("first") + piece, "last") - 1)
    return runs.select("shard", "sid", F.inline(F.transform(places, slot))).select("shard", "slot", "sid", "block")


def blocks_of(offsets: DataFrame, block: int, seed: int = SEED) -> DataFrame:
    """sid, block, words and parts (off, n: words taken from the document at that offset) of the blocks that a slot takes.

    offsets: documents with off and the blocks, full and slots of their source."""
    low = lambda b: F.greatest(F.col("off"), b * block)
    high = lambda b: F.least(F.col("off") + F.col("size"), (b + 1) * block)
    full = F.greatest("full", F.lit(1))
    first_pass = round_keys(full, F.col("sid"), F.lit(0).cast("long"), seed=seed + OF_SOURCE)

    def taken(b: Column, rounds: Column) -> Column:
        # in its first pass a source's k-th slot takes the block at place k; the short block comes last
        place = F.when(b < F.col("full"), place_of(b, full, rounds)).otherwise(b)
        return F.when(F.col("slots") >= F.col("blocks"), True).otherwise(place < F.col("slots"))

    def cut(w: Column, rounds: Column) -> Column:
        at = F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))
        piece = lambda b: F.array_join(F.slice(w, (low(b) - F.col("off") + 1).cast("int"), (high(b) - low(b)).cast("int")), " ")
        return F.transform(F.filter(at, lambda b: taken(b, rounds)), lambda b: F.struct(b.alias("block"), (high(b) - low(b)).alias("n"), piece(b).alias("words")))

    # bound, so that the words are split, and the rounds' keys made, once a document
    pieces = bound(F.struct(words_of(F.col("__text")).alias("w"), first_pass.alias("r")), lambda x: cut(x["w"], x["r"]))
    rows = offsets.select("sid", "off", F.inline(pieces))
    # dealt once, as the join with the slots needs them
    held = rows.repartition("sid", "block").groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("off", "n", "words"))).alias("p"))
    parts = F.transform("p", lambda x: F.struct(x["off"].alias("off"), x["n"].alias("n")))
    return held.select("sid", "block", F.array_join(F.transform("p", lambda x: x["words"]), " ").alias("words"), parts.alias("parts"))


def with_quotas(goals: DataFrame, block: int, max_repeats: int) -> DataFrame:
    """goals with blocks, full (of them, at full length) and slots: whole passes, then as many full blocks as come nearest to the target."""
    size, target = F.col("source_size"), F.col("target")
    passes = F.when(size > 0, F.floor(target / size)).otherwise(0)
    q = goals.withColumns({"blocks": F.ceil(size / block), "full": F.floor(size / block), "passes": passes})
    rest, filled = target - F.col("passes") * size, F.col("full") * block
    more = F.least(F.round(rest / block).cast("long"), F.col("full"))
    closes = (F.col("blocks") > F.col("full")) & (2 * (rest - filled) > size - filled)
    slots = F.least(F.col("passes") * F.col("blocks") + F.when(closes, F.col("blocks")).otherwise(more), max_repeats * F.col("blocks"))
    return q.withColumn("slots", F.when(size > 0, slots).otherwise(0)).drop("passes")


def mixed(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    block: int = 128,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = 3,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents it was made from.

    The mix has a row for every slot: shard, slot, sid, block, words, and parts, the (off, n) of the documents in it.
    It is written to path as Parquet (without one to the shared folder, where it lasts as long as the session).
    Documents: keep columns, size, source_size, target, sid, and off, which is null without words."""
    sized = sizes(docs, keep, source, text)
    narrow = stash(sized.drop("__text"), "sizes")
    goals = stash(with_quotas(targets(narrow, weights, max_repeats), block, max_repeats), "targets")
    g = bounded_broadcast(goals, BROADCAST_ROWS).alias("g")

    def with_sid(rows: DataFrame) -> DataFrame:
        own = rows.drop("__source").columns
        return rows.alias("d").join(g, F.col("d.__source").eqNullSafe(F.col("g.__source"))).select(*[f"d.{c}" for c in own], *[f"g.{c}" for c in ("sid", "source_size", "target", "blocks", "full", "slots")])

    sized, narrow = (_bucketed(with_sid(x), keep) for x in (sized, narrow))
    buckets = stash(bucket_starts(narrow), "buckets")
    # written once: the blocks are cut from it, and the documents' shares are counted by it
    offsets = packed(sized, buckets, keep)
    columns = [*keep, "size", "source_size", "target", "sid", "off"]
    places = stash(packed(narrow.filter("size > 0").withColumn("__text", F.lit("x")), buckets, keep).select(*columns), "offsets")
    out = picks(goals.select("sid", "blocks", "full", "slots")).join(blocks_of(offsets, block), ["sid", "block"]).select("shard", "slot", "sid", "block", "words", "parts")
    if path is None:
        out = stash(out, "mix")
    else:
        out.write.parquet(path)
        out = docs.sparkSession.read.schema(out.schema).parquet(path)
    nothing = narrow.filter("size = 0").withColumn("off", F.lit(None).cast("long"))
    return out, places.unionByName(nothing.select(*places.columns))


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    block: int = 128,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = 3,
    path: str | None = None,
) -> DataFrame:
    """keep columns, size, source_size, target and taken of every row; taken is counted in the blocks of the written mix."""
    out, rows = mixed(docs, source, text, keep, block, weights, max_repeats, path)
    taken = out.select("sid", F.inline("parts")).groupBy("sid", "off").agg(F.sum("n").alias("n"))
    rows = rows.join(taken, ["sid", "off"], "left")
    return rows.select(*keep, "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))
