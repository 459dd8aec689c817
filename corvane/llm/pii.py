"""Personal data by bootstrapped contextual extraction.

Seeds are the spans of four strict forms (email, ip, card, phone).  What looks like an identifier but fails the strict
forms (a number without its plus sign, an address that is spelt out, a card number that does not check) is a candidate.
One pass over the texts takes seeds and candidates with their contexts: the n-grams of one to three tokens before and
after them, each a lexical pattern.  Patterns and instances make a graph of two sides, which is scored in rounds:

    conf(p, k) = sum over instances i of n(p, i) * r(i, k) / N(p)      N(p): all occurrences of the n-gram in the corpus
    r(i, k)    = sum over accepted p of n(p, i) * conf(p, k) / T(i)    T(i): all occurrences of the instance

r is 1 for a seed of kind k, and the best of the six arms (side and length) for a candidate, so it is the mean confidence
of its contexts.  A pattern is accepted with MIN_SUPPORT different trusted instances and a confidence of MIN_CONFIDENCE, an
instance is trusted from MIN_CONFIDENCE on; what a round trusts supports patterns in the next.  In the end every candidate
of a trusted instance is a span of that kind, as is a candidate that spells a seed in another way.

N(p) counts whatever stands beside a pattern, ordinary words too, so it needs a second pass over all texts; a bitmap of
the n-grams that could be accepted (of bounded size; it only saves work) keeps the others out of the count.  Texts are
never shuffled.

Cases: a null text counts as an empty one; repeated rows are judged row by row; of candidates that overlap, those of the
earlier form in email, ip, number stay, and none overlaps a base span; an instance trusted for several kinds takes the one
of the highest r, the first of equals; texts are read whole; an empty table gives an empty result; other columns may have
any names, as only the named ones are read.  N-grams are known by 64-bit hashes, instances by 128-bit ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import bounded_broadcast, stash
from corvane.llm.kernel import U, Words, mix, pieces, tidy, utf8

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS, LONGEST_GRAM = 3, 0.5, 3, 3
#: Instances and spans are joined by broadcast up to so many rows.
BROADCAST_ROWS = 100_000
#: The bitmap has 64 bits for each n-gram, from 4 MB up to 64.
LEAST_BITS, MOST_BITS = 25, 29

# the strict forms; possessive, as their runs are maximal
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# the loose forms
_SPELT = re.compile(r"@|[\[(]at[\])]", re.IGNORECASE)
_LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){0,4}",
    re.IGNORECASE | re.ASCII,
)
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{6,19}|\(?[0-9]{1,5}\)?(?:[ ./-]{1,2}\(?[0-9]{1,5}\)?){1,7})(?![0-9A-Za-z])")
_SOME = re.compile(r"[0-9@]|[\[(][Aa][Tt][\])]")

#: Bytes of tokens: letters and digits, all digits alike, and whatever is not ASCII; the others part tokens.
_TOKEN_BYTES = np.full(256, 0x20, np.uint8)
_TOKEN_BYTES[128:] = np.arange(128, 256)
_TOKEN_BYTES[65:91], _TOKEN_BYTES[97:123], _TOKEN_BYTES[48:58] = np.arange(65, 91), np.arange(97, 123), 0x30

OCCURRENCE = pa.struct([("inst", pa.binary()), ("kind", pa.int8()), ("may", pa.int8()), ("s", pa.int32()), ("e", pa.int32()), ("grams", pa.list_(pa.int64()))])
_OCCURRENCE_SQL = "array<struct<inst: binary, kind: tinyint, may: tinyint, s: int, e: int, grams: array<bigint>>>"


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @: a local part is the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > free and (c := text[first - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            first -= 1
        if first < at and (domain := _DOMAIN.match(text, at + 1)):
            yield first, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict forms, in that order."""
    out = [(EMAIL, s, e) for s, e in _emails(text)]
    out += [(IP, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((PHONE, m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(bits of the kinds that it may be, start, end) of the loose forms that overlap neither a base span nor each other."""
    loose: list[tuple[int, int, int]] = []
    if _SPELT.search(text):
        loose += [(1 << EMAIL, m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    loose += [(1 << IP, m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0]))
        may = (1 << PHONE) * (7 <= n <= 15) + (1 << CARD) * (12 <= n <= 19)
        if may:
            loose.append((may, m.start(), m.end()))
    # stages of one sweep each: the taken spans are kept apart and sorted
    taken = sorted((s, e) for _, s, e in base)
    out: list[tuple[int, int, int]] = []
    for form in (1 << EMAIL, 1 << IP, 0):
        own = [c for c in loose if (c[0] == form if form else c[0] not in (1 << EMAIL, 1 << IP))]
        i, most, free = 0, 0, []
        for c in own:  # in order of their starts, as found
            while i < len(taken) and taken[i][0] < c[2]:
                most = max(most, taken[i][1])
                i += 1
            if most <= c[1]:
                free.append(c)
        out += free
        taken = sorted(taken + [(s, e) for _, s, e in free])
    return out


def instance(kind_bits: int, said: str) -> bytes:
    """128 bits that spellings of one identifier share."""
    if kind_bits & 1 << EMAIL:
        plain = re.sub(r"\x20?[\[(]at[\])]\x20?", "@", said.lower())
        plain = re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", plain)
    elif kind_bits & 1 << IP:
        plain = said.lower()
    else:
        plain = _digits(said)
    return hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=16).digest()


def grams(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that begin at each token, by length; those across a document's end are not to be used."""
    out, rolled = [], h
    for n in range(LONGEST_GRAM):
        if n:
            rolled = rolled[: max(len(rolled) - 1, 0)] * U(0x100000001B3) + h[n:]
        out.append(mix(rolled + U(n + 1)))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(_TOKEN_BYTES[data], offsets)


def _contexts(texts: list[str], spans: list[list[tuple[int, int, int, int]]]) -> list[list[dict]]:
    """Occurrences with their n-grams for each text: spans are (kind or -1, bits, start, end)."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    out: list[list[dict]] = []
    with np.errstate(over="ignore"):
        for a, b in pieces(offsets):
            w = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            by_length = [g.view(np.int64) for g in grams(w.hash)]
            for d in range(a, b):
                text, here = texts[d], spans[d]
                places = np.array(sorted({x for s in here for x in s[2:]}))
                if text.isascii():
                    at = dict(zip(places.tolist(), places.tolist(), strict=True))
                else:
                    at, before, n = {}, 0, 0
                    for p in places.tolist():
                        n += len(text[before:p].encode("utf-8"))
                        at[p], before = n, p
                shift, lo, hi = int(offsets[d] - offsets[a]), int(w.first[d - a]), int(w.first[d - a + 1])
                ends, starts = w.end[lo:hi] - shift, w.start[lo:hi] - shift
                row = []
                for kind, may, s, e in here:
                    left = lo + int(np.searchsorted(ends, at[s], "right"))
                    right = lo + int(np.searchsorted(starts, at[e], "left"))
                    g = [int(by_length[n][left - n - 1]) if left - n - 1 >= lo else None for n in range(LONGEST_GRAM)]
                    g += [int(by_length[n][right]) if right + n < hi else None for n in range(LONGEST_GRAM)]
                    row.append({"inst": instance(may, text[s:e]), "kind": kind, "may": 0 if kind >= 0 else may, "s": s, "e": e, "grams": g})
                out.append(row)
    return out


def _finder(n_other: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n_other)
            rows = texts.to_pylist()
            counts = np.zeros((len(rows), 4), np.int64)
            found: list[list[dict]] = [[] for _ in rows]
            some, spans = [], []
            for i, t in enumerate(rows):
                if not _SOME.search(t):
                    continue
                base = base_spans(t)
                here = [(k, 1 << k, s, e) for k, s, e in base] + [(-1, may, s, e) for may, s, e in candidates(t, base)]
                if here:
                    counts[i] = np.bincount([k for k, _, _ in base], minlength=4)
                    some.append(i)
                    spans.append(here)
            for i, occurrences in zip(some, _contexts([rows[i] for i in some], spans), strict=True):
                found[i] = occurrences
            columns = [*(batch.column(i) for i in range(n_other)), *(pa.array(counts[:, k]) for k in range(4)), pa.array(found, pa.list_(OCCURRENCE))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n_other], *(f"n_{k}" for k in KINDS), "occurrences"])

    return run


def occurrences(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, the counts of base spans, and all seeds and candidates with their contexts, by one narrow pass."""
    filled = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in filled.schema.fields[:-1])
    return filled.mapInArrow(tidy(_finder(len(keep))), schema + "".join(f"n_{k} long, " for k in KINDS) + f"occurrences {_OCCURRENCE_SQL}")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts), len(k)).astype(np.int64)


def gram_counts(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """gram, n: occurrences in all texts of (at least) the wanted n-grams."""
    spark = docs.sparkSession
    n_wanted = wanted.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(64 * n_wanted + 1)))))
    bit = F.call_function("shiftrightunsigned", F.col("gram"), F.lit(64 - bits))
    words = wanted.groupBy(F.call_function("shiftright", bit, F.lit(6)).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("mask")
    )
    set_words = words.toArrow()  # at most 2^(bits - 6) rows
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[set_words["word"].to_numpy()] = set_words["mask"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value.view(np.uint64)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            k, n = _summed(keys, counts) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["gram", "n"])

        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = utf8(batch.column(0))
                for a, b in pieces(offsets):
                    w = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if not len(w.hash):
                        continue
                    room = w.first[1:][w.doc] - np.arange(len(w.hash))
                    for n, g in enumerate(grams(w.hash)):
                        g = g[room[: len(g)] > n]
                        at = g >> U(64 - bits)
                        g = g[(mask[at >> U(6)] >> (at & U(63))) & U(1) == 1]
                        k, c = np.unique(g, return_counts=True)
                        keys.append(k)
                        counts.append(c)
                        held += len(k)
                    if held > 1_000_000:
                        yield out()
                        keys, counts, held = [], [], 0
        yield out()

    texts = docs.select(F.coalesce(docs[text], F.lit("")).alias("t"))
    return texts.mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _may_be(kind: Column) -> Column:
    return F.col("may").bitwiseAND(F.call_function("shiftleft", F.lit(1), kind.cast("int"))) != 0


def trusted(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """inst, kind, r of the instances that are trusted: seeds, and what accepted patterns discover."""
    occ = found.select(F.explode("occurrences").alias("o")).select("o.*")
    seeds = stash(occ.filter("kind >= 0").select("inst", F.col("kind").cast("int").alias("kind")).distinct(), "pii-seeds").withColumn("r", F.lit(1.0))
    edges = occ.select("inst", "may", F.posexplode("grams").alias("arm", "gram")).filter("gram is not null")
    edges = stash(edges.groupBy("arm", "gram", "inst").agg(F.bit_or("may").alias("may"), F.count("*").alias("n")), "pii-edges")
    wanted = stash(edges.groupBy("arm", "gram").agg(F.count("*").alias("m")).filter(F.col("m") >= MIN_SUPPORT).select("arm", "gram"), "pii-patterns")
    counts = gram_counts(docs, wanted.select("gram").distinct(), text).withColumnsRenamed({"gram": "g", "n": "in_all"})
    patterns = stash(wanted.join(counts, F.col("gram") == F.col("g")).select("arm", "gram", "in_all"), "pii-counts")
    edges = stash(edges.join(patterns, ["arm", "gram"]), "pii-graph")
    totals = occ.filter("may != 0").groupBy(F.col("inst").alias("i")).agg(F.count("*").alias("total"))
    loose = stash(edges.filter("may != 0").join(totals, F.col("inst") == F.col("i")).select("arm", "gram", "inst", "may", "n", "total"), "pii-candidates")
    now = seeds
    for _ in range(ROUNDS):
        scored = edges.join(now, "inst").groupBy("arm", "gram", "kind").agg(
            F.count("*").alias("support"), (F.sum(F.col("n") * F.col("r")) / F.max("in_all")).alias("conf")
        )
        good = stash(scored.filter((F.col("support") >= MIN_SUPPORT) & (F.col("conf") >= MIN_CONFIDENCE)), "pii-accepted")
        reached = loose.join(good, ["arm", "gram"]).filter(_may_be(F.col("kind")))
        reached = reached.groupBy("inst", "kind", "arm").agg((F.sum(F.col("n") * F.col("conf")) / F.max("total")).alias("r"))
        new = reached.groupBy("inst").agg(F.max(F.struct("r", (-F.col("kind")).alias("k"))).alias("x")).filter(F.col("x.r") >= MIN_CONFIDENCE)
        new = new.select("inst", (-F.col("x.k")).alias("kind"), F.col("x.r").alias("r"))
        now = stash(seeds.unionByName(new.join(seeds.select("inst"), "inst", "left_anti")), "pii-trusted")
    return now


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_email, n_ip, n_card, n_phone of the base spans, and spans: all as array<struct<kind, s, e, base>>, sorted
    by kind and start."""
    found = stash(occurrences(docs, text, keep).withColumn("__rid", F.monotonically_increasing_id()), "pii")
    loose = found.select("__rid", F.explode(F.filter("occurrences", lambda o: o["kind"] < 0)).alias("o")).select("__rid", "o.inst", "o.may", "o.s", "o.e")
    known = bounded_broadcast(trusted(docs, found, text), BROADCAST_ROWS)
    hits = loose.join(known, "inst").filter(_may_be(F.col("kind")))
    hits = hits.groupBy("__rid", "s", "e").agg(F.max(F.struct("r", (-F.col("kind")).alias("k"))).alias("x"))
    more = hits.groupBy("__rid").agg(F.collect_list(F.struct((-F.col("x.k")).alias("kind"), "s", "e", F.lit(False).alias("base"))).alias("__more"))
    more = bounded_broadcast(stash(more.withColumnRenamed("__rid", "__found"), "pii-more"), BROADCAST_ROWS)
    base = F.transform(
        F.filter("occurrences", lambda o: o["kind"] >= 0), lambda o: F.struct(o["kind"].cast("int").alias("kind"), o["s"].alias("s"), o["e"].alias("e"), F.lit(True).alias("base"))
    )
    joined = found.join(more, F.col("__rid") == F.col("__found"), "left")
    spans = F.sort_array(F.when(F.col("__more").isNull(), base).otherwise(F.concat(base, "__more")))
    return joined.select(*keep, *[f"n_{k}" for k in KINDS], spans.alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digest(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts and a digest of the base spans, and all spans as kind:start:end."""
    d = personal_data(docs, text, keep)
    base = _joined(F.filter("spans", lambda x: x["base"]))
    return d.select(*keep, *[f"n_{k}" for k in KINDS], F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
