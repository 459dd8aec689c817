"""Contradictions between claims, by classes of equal claims instead of all pairs of claims.

Whether two claims conflict, and why a pair is passed over, depends on few properties of each: its signature.  It is
computed once a claim; claims of equal signature are a class, named by its least key, and classes are compared, so a
report gives pairs of classes with the number of claim pairs that each stands for, and ``members`` the classes of claims.

Classes meet where a conflict is possible: on a unit with a value on both sides, on opposite sides of an exclusive pair of
terms, or on a subject token of two durations; and, but for durations, on names that are compatible: equal, contained in one
another, or unknown on one side.  Names meet by equi-join on their substrings.  Pairs that differ in entity are never
formed: ``mismatches`` counts them from the sizes of the classes.

Reports of counts alone need no pairs: ``numeric_counts`` finds them in the order of values, so that its work grows with the
classes and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import classify as C
from corvane.sources.scratch import stash

Side = Callable[[str], Column]


def _pair_in(a: Column, b: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    both = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return both.isin(*["|".join(sorted(p)) for p in pairs])


def _escaped(unit: str) -> str:
    return unit if unit.isalnum() else "".join(c if c.isalnum() or c == "°" else "\\" + c for c in unit)


def unit_value(low: Column, unit: str) -> Column:
    """First number before, else after, the unit in a lower-cased claim."""
    u = _escaped(unit)
    before = F.regexp_extract(low, rf"\b(\d+(?:\.\d+)?)\s*{u}\b", 1)
    after = F.regexp_extract(low, rf"\b{u}\s*(\d+(?:\.\d+)?)\b", 1)
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).cast("double")


def value_meaning(low: Column, value: Column, unit: str) -> Column:
    """primary, threshold or historical_comparison, by what stands around the value."""
    shown = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    found = F.regexp_extract(low, rf"\b(\d+(?:\.\d+)?)\s*{_escaped(unit)}\b", 0)
    at = F.instr(low, found) - 1
    before = T.window(low, at, 120, 0)
    near = F.concat(F.right(before, F.lit(80)), F.substring(low, at + 1, F.lit(80)))
    return (
        F.when((found == "") | ~F.startswith(found, shown), "primary")
        .when(F.right(before, F.lit(50)).rlike(L.THRESHOLD_BEFORE), "threshold")
        .when(near.rlike(L.HISTORICAL) | before.rlike(L.COMPARISON_CLAUSE), "historical_comparison")
        .otherwise("primary")
    )


def metric_type(low: Column, unit: str, scope: Column) -> Column:
    """What a value of the unit measures, from 80 characters on either side of it and the scope."""
    if unit == "w":
        return F.when(scope.isin("node", "chip"), "gpu_power_w").otherwise("w_value")
    if unit not in ("kw", "mw", "gw"):
        return F.lit(f"{unit}_value")
    found = F.coalesce(
        F.nullif(F.regexp_extract(low, rf"\b\d+(?:\.\d+)?\s*{unit}\b", 0), F.lit("")), F.nullif(F.regexp_extract(low, rf"\b{unit}\s*\d+(?:\.\d+)?\b", 0), F.lit(""))
    )
    at = F.instr(low, found) - 1
    near = F.substring(low, F.greatest(at - 80, F.lit(0)) + 1, F.least(at, F.lit(80)) + F.length(found) + 80)
    kind = F.when(near.rlike(L.RATE), "rate").when(near.rlike(L.TARGET), "target").when(near.rlike(L.CURRENT), "current").otherwise("level")
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in L.SCOPE_POWER.items() for x in kv]), scope)
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit(f"_{unit}"))).otherwise(F.concat(F.lit(f"{unit}_"), kind))


def unit_range(low: Column, unit: str) -> Column:
    """(lo, hi) of a range of the unit; null without one."""
    p = rf"\b(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\+?\s*{_escaped(unit)}\b"
    lo = F.nullif(F.regexp_extract(low, p, 1), F.lit("")).cast("double")
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), F.nullif(F.regexp_extract(low, p, 2), F.lit("")).cast("double").alias("hi")))


def names_compatible(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)


def compatible_names(classes: DataFrame) -> DataFrame:
    """Pairs (e, other) of the classes' entity names that may be the same subject, in both orders; equal ones once."""
    names = classes.select("e").distinct()
    starts = F.sequence(F.lit(0), F.length("e") - 1)
    cuts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("e") - i), lambda n: F.substring("e", i + 1, n))))
    parts = names.select("e", F.explode(F.when(F.col("e") == "", F.array(F.lit(""))).otherwise(F.array_union(cuts, F.array(F.lit(""))))).alias("other"))
    held = parts.join(names.select(F.col("e").alias("other")), "other").select("e", "other")
    return held.unionByName(held.select(F.col("other").alias("e"), F.col("e").alias("other"))).distinct()


def scopes_compatible(a: Column, b: Column) -> Column:
    x, y = F.when(a == "reactor", "unit").otherwise(a), F.when(b == "reactor", "unit").otherwise(b)
    return (x == "unknown") | (y == "unknown") | (x == y) | ~_pair_in(x, y, L.INCOMPATIBLE_SCOPES)


def _power(metric: Column) -> Column:
    return metric.rlike(L.SCOPED_POWER)


def metrics_compatible(a: Column, b: Column) -> Column:
    staged = lambda x: x.isin(*L.LIFECYCLE)
    year = lambda x: x.startswith("year_") | staged(x)
    bad_year = a.isin("year_generic", "year_event") | b.isin("year_generic", "year_event") | (staged(a) & staged(b) & (a != b))
    bad_other = (a != b) & ((_power(a) & _power(b)) | (a.endswith("_rate") != b.endswith("_rate")))
    return F.when(year(a) | year(b), ~bad_year).otherwise(~bad_other)


def product_bits(claim: Column) -> Column:
    """Two bits for each of the distinct products: whether a claim names one of the first, of the second."""
    out = F.lit(0)
    for i, (_, xs, ys) in enumerate(L.DISTINCT_PRODUCTS):
        out = out + F.when(R.any_term(claim, xs), 1 << 2 * i).otherwise(0) + F.when(R.any_term(claim, ys), 2 << 2 * i).otherwise(0)
    return out


def product_reason(a: Column, b: Column) -> Column:
    """product_mismatch or generation_progression if the claims with these bits name distinct products, else null."""
    out = None
    has = lambda x, bit: x.bitwiseAND(F.lit(bit)) != 0
    for i, (reason, _, _) in enumerate(L.DISTINCT_PRODUCTS):
        x, y = 1 << 2 * i, 2 << 2 * i
        out = R.when(out, (has(a, x) & has(b, y)) | (has(a, y) & has(b, x)), reason)
    return out


def contexts_clash(a: Column, b: Column) -> Column:
    return (a == "example_deployment") | (b == "example_deployment") | _pair_in(a, b, L.INCOMPATIBLE_CONTEXTS)


def topic_bits(claim: Column, topics: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """A bit for each of a profile's topics of which a claim holds a keyword."""
    return sum((F.when(R.any_term(claim, terms), 1 << i).otherwise(0) for i, (_, terms) in enumerate(topics)), F.lit(0))


def first_topic(bits: Column, topics: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first topic in the bits, else other."""
    out = None
    for i, (name, _) in enumerate(topics):
        out = R.when(out, bits.bitwiseAND(F.lit(1 << i)) != 0, name)
    return F.lit("other") if out is None else out.otherwise("other")


def enriched(claims: DataFrame, claim: str = "claim") -> DataFrame:
    """Claims with entity, entity_type and scope; a claim that has any of them set is left as it is."""
    given = F.lit(False)
    for c in ("entity", "entity_type", "scope"):
        if c in claims.columns:
            given = given | (F.coalesce(F.col(c), F.lit("")) != "")
    found = R.bound(C.entity(F.col(claim)), lambda e: F.struct(e["entity"].alias("entity"), e["entity_type"].alias("entity_type"), C.scope(F.col(claim), e["entity_type"]).alias("scope")))
    old = F.struct(*[(F.coalesce(F.col(c), F.lit("")) if c in claims.columns else F.lit("")).alias(c) for c in ("entity", "entity_type", "scope")])
    # exploded, so that what is found is computed once
    e = claims.select("*", F.explode(F.array(F.when(given, old).otherwise(found))).alias("__e"))
    return e.withColumns({c: F.col(f"__e.{c}") for c in ("entity", "entity_type", "scope")}).drop("__e")


def _subject(claim: Column) -> dict[str, Column]:
    """The properties that numeric and categorical comparisons share."""
    scope = F.when(F.coalesce("scope", F.lit("")) == "", C.scope(claim, F.lit(""))).otherwise(F.col("scope"))
    return {"e": F.lower(F.trim(F.coalesce("entity", F.lit("")))), "s": scope, "ctx": C.comparison_context(claim), "prod": product_bits(claim)}


def numeric_signatures(claims: DataFrame, key: str = "id", claim: str = "claim", units: tuple[str, ...] = L.UNITS, also: tuple[str, ...] = ()) -> DataFrame:
    """k and the signature of every claim with a value: e, s, ctx, prod, kind, the columns also, and m, an array of its
    values (o, unit, value, metric, lo, hi, meaning) by unit.  claims: key, claim, entity, scope and the columns also."""
    c = F.col(claim)

    def value(low: Column, scope: Column, o: int, u: str) -> Column:
        def of(x: Column) -> Column:
            v, r = x["v"], x["r"]
            one = F.struct(F.lit(o).alias("o"), F.lit(u).alias("unit"), v.alias("value"), metric_type(low, u, scope).alias("metric"), r["lo"].alias("lo"), r["hi"].alias("hi"), value_meaning(low, v, u).alias("meaning"))
            return F.when(v.isNotNull(), one)

        return F.when(F.contains(low, F.lit(u)), R.bound(F.struct(unit_value(low, u).alias("v"), unit_range(low, u).alias("r")), of))

    subject = F.struct(F.lower(c).alias("low"), *[v.alias(n) for n, v in _subject(c).items()], C.temporal_kind(c).alias("kind"))
    own = lambda x: x.withField("m", F.array_compact(F.array(*[value(x["low"], x["s"], o, u) for o, u in enumerate(units)])))
    made = claims.select(F.col(key).alias("k"), *also, F.explode(F.transform(F.array(subject), own)).alias("x"))
    return made.select("k", *[f"x.{n}" for n in ("e", "s", "ctx", "prod", "kind")], *also, "x.m").filter(F.size("m") > 0)


def categorical_signatures(claims: DataFrame, key: str = "id", claim: str = "claim", also: tuple[str, ...] = ()) -> DataFrame:
    """k and the signature of every claim with a term of an exclusive pair: e, s, ctx, prod, also, and m (o, side, term, metric)."""
    c = F.col(claim)

    def side_of(low: Column, o: int, side: int, terms: tuple[str, ...]) -> Column:
        def of(term: Column) -> Column:
            metric = (
                F.when(term.rlike("^20[0-9][0-9]$"), C.year_context(low, term))
                .when(term.rlike("cool|dlc|liquid"), "cooling_method")
                .when(term.contains("phase"), "cooling_phase")
                .when(term.contains("gpu"), "gpu_count")
                .when(term.contains("nvl"), "rack_type")
                .otherwise("categorical_specification")
            )
            return F.when(term.isNotNull(), F.struct(F.lit(o).alias("o"), F.lit(side).alias("side"), term.alias("term"), metric.alias("metric")))

        return R.bound(F.coalesce(*[F.when(F.contains(low, F.lit(t)), t) for t in terms]), of)

    sides = lambda low: F.array_compact(F.array(*[side_of(low, o, side, terms) for o, two in enumerate(L.EXCLUSIVE) for side, terms in enumerate(two)]))
    subject = F.struct(F.lower(c).alias("low"), *[v.alias(n) for n, v in _subject(c).items()])
    made = claims.select(F.col(key).alias("k"), *also, F.explode(F.transform(F.array(subject), lambda x: x.withField("m", sides(x["low"])))).alias("x"))
    return made.select("k", *[f"x.{n}" for n in ("e", "s", "ctx", "prod")], *also, "x.m").filter(F.size("m") > 0)


def duration_signatures(claims: DataFrame, key: str = "id", claim: str = "claim") -> DataFrame:
    """k and the signature of every claim with a duration: lo and hi in months, metric, and w, its subject tokens."""
    c, low = F.col(claim), F.lower(F.col(claim))
    months = F.when(F.lower(F.regexp_extract(c, L.DURATION, 3)).startswith("year"), 12).otherwise(1)
    lo = F.nullif(F.regexp_extract(c, L.DURATION, 1), F.lit("")).cast("double") * months
    hi = F.coalesce(F.nullif(F.regexp_extract(c, L.DURATION, 2), F.lit("")).cast("double") * months, lo)
    words = T.tokens(low, r"\b[a-z][a-z0-9_-]*\b", L.DURATION_STOP, 3, distinct=True)
    metric = R.first_pattern(c, L.DURATION_METRICS, "duration_generic")
    return claims.select(F.col(key).alias("k"), lo.alias("lo"), hi.alias("hi"), metric.alias("metric"), F.array_sort(words).alias("w")).filter(F.col("lo").isNotNull())


def classes(signatures: DataFrame) -> DataFrame:
    """The distinct signatures: class, its least key, and n, its claims.  Written, so that claims are read once."""
    return stash(signatures.groupBy(*[c for c in signatures.columns if c != "k"]).agg(F.min("k").alias("class"), F.count("*").alias("n")), "classes")


def members(signatures: DataFrame) -> DataFrame:
    """(k, class) of every claim with a signature."""
    by = [c for c in signatures.columns if c != "k"]
    signatures = stash(signatures, "signatures")
    s, c = signatures.alias("s"), classes(signatures).alias("c")
    same = F.lit(True)
    for x in by:
        same &= F.col(f"s.{x}").eqNullSafe(F.col(f"c.{x}"))
    return s.join(c, same).select("s.k", "c.class")


def _compared(found: DataFrame, on: str, own: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Classes joined on compatible names and ``on``, as aliases a and b; each pair once, a class with itself if it has
    two claims.  The number of claim pairs that a row stands for."""
    flat = found.select("class", "n", "e", *own, F.inline("m"))
    # few classes make many pairs: they are spread whatever their bytes
    left = flat.join(compatible_names(found), "e").repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "class")
    a, b = left.alias("a"), flat.alias("b")
    A, B = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    meet = (A("other") == B("e")) & (A(on) == B(on)) & ((A("class") < B("class")) | ((A("class") == B("class")) & (A("n") > 1)))
    pairs = F.when(A("class") == B("class"), A("n") * (A("n") - 1) / 2).otherwise(A("n") * B("n")).cast("long")
    return a.join(b, meet), pairs


def _until_conflict(pairs: DataFrame, order: Column) -> DataFrame:
    """Rows with an outcome; of a pair of classes those up to its first conflict."""
    first = F.min(F.when(F.col("outcome") == "conflict", F.col("__o"))).over(Window.partitionBy("class_a", "class_b"))
    pairs = pairs.withColumn("__o", order).filter(F.col("outcome").isNotNull()).withColumn("__first", first)
    return pairs.filter(F.col("__first").isNull() | (F.col("__o") <= F.col("__first"))).drop("__o", "__first")


def _gate(A: Side, B: Side) -> Column:
    """What rules two values out whatever they are; none if they measure different things, open if nothing does."""
    kinds = F.array_sort(F.array(A("kind"), B("kind")))
    return (
        F.when(product_reason(A("prod"), B("prod")).isNotNull(), product_reason(A("prod"), B("prod")))
        .when(~scopes_compatible(A("s"), B("s")), "scope_mismatch")
        .when(~metrics_compatible(A("metric"), B("metric")), F.when(_power(A("metric")) & _power(B("metric")), "metric_scope_mismatch").otherwise("none"))
        .when((kinds[0] == "current") & kinds[1].isin("target", "rate"), "temporal_progression")
        .when(contexts_clash(A("ctx"), B("ctx")), "context_mismatch")
        .otherwise("open")
    )


def _meanings(A: Side, B: Side) -> Column:
    """What rules out two values, of which none is in the other's range, by their meanings."""
    either = lambda m: (A("meaning") == m) | (B("meaning") == m)
    return F.when(either("threshold"), "threshold_vs_measurement").when(either("historical_comparison"), "historical_progression")


def _ratio(x: Column, y: Column) -> Column:
    return F.abs(x - y) / F.nullif(F.greatest(x, y), F.lit(0.0))


#: Values conflict beyond this ratio; a range takes values in from this share of its low to this share of its high end.
FAR, LOW, HIGH = 0.20, 0.85, 1.15


def _numeric_rows(found: DataFrame, also: tuple[str, ...] = (), topics: tuple = ()) -> DataFrame:
    """Rows of numeric_pairs for all units, with o."""
    joined, pairs = _compared(found, "unit", ("s", "ctx", "prod", "kind", *also))
    A, B = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    in_range = lambda x, y: x("lo").isNotNull() & y("lo").isNull() & (y("value") >= x("lo") * LOW) & (y("value") <= x("hi") * HIGH)
    ratio, gate, meaning = _ratio(A("value"), B("value")), _gate(A, B), _meanings(A, B)
    outcome = F.when(gate == "none", None).when(gate != "open", gate).when(in_range(A, B) | in_range(B, A), "range_average_compatible").when(meaning.isNotNull(), meaning)
    outcome = outcome.when(F.coalesce(ratio, F.lit(0.0)) > FAR, "conflict")
    clash = outcome == "conflict"
    topic = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.UNIT_TOPIC.items() for x in kv]), A("unit")), F.lit("numeric specification"))
    if topics:
        topic = first_topic(A("topics").bitwiseOR(B("topics")), topics)
    cols = [A("class").alias("class_a"), B("class").alias("class_b"), A("unit").alias("unit"), A("o").alias("o"), outcome.alias("outcome"), F.round(ratio, 6).alias("ratio"), pairs.alias("pairs")]
    cols += [F.when(clash, F.when(ratio >= 0.50, "high").otherwise("medium")).alias("severity"), F.when(clash, topic).alias("topic")]
    return joined.select(*cols, *[f(c).alias(f"{s}_{c}") for c in also for s, f in (("a", A), ("b", B))])


def numeric_pairs(found: DataFrame, also: tuple[str, ...] = (), topics: tuple = ()) -> DataFrame:
    """One row for each pair of classes and unit with a value on both sides that conflicts or is passed over: outcome
    (conflict, or the reason), ratio, severity and topic of a conflict, pairs (claim pairs), and a_/b_ of the columns also.

    found: classes of numeric_signatures.  Units are compared in order until the first that conflicts; of pairs that
    differ in entity none is formed (see mismatches), and values that agree, or measure different things, give no row."""
    return _until_conflict(_numeric_rows(found, also, topics), F.col("o")).drop("o")


def near_interval(value: Column) -> tuple[Column, Column]:
    """The least and the greatest number that does not conflict with a value: exact, as the ratio is computed in doubles."""
    around = F.array(*[F.lit(1.0 + k * 2.0**-53) for k in range(-16, 17)])
    near = lambda y: F.coalesce(_ratio(value, y), F.lit(0.0)) <= FAR
    ends = lambda x: F.filter(F.transform(around, lambda f: x * f), near)
    return F.array_min(ends(value * (1 - FAR))), F.array_max(ends(value / (1 - FAR)))


def _running(points: DataFrame, asked: DataFrame) -> DataFrame:
    """For every (grp, sid, x, after) asked: cum, the n of the points of (grp, sid) with value < x, or <= x if after is 2.

    Values are cut into eighths of an octave: sums run within a bucket, and over the buckets' sums, so no task sorts a group."""
    bucket = F.when(F.col("x") > 0, F.floor(F.log2("x") * 8)).otherwise(-(10**6)).alias("bucket")
    events = points.select("grp", "sid", F.col("value").alias("x"), F.lit(1).alias("after"), "n").unionByName(asked.select("grp", "sid", "x", "after", F.lit(0).cast("long").alias("n")))
    events = events.groupBy("grp", "sid", bucket, "x", "after").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("grp", "sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = events.groupBy("grp", "sid", "bucket").agg(F.sum("n").alias("n")).select("grp", "sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("grp", "sid", "bucket").orderBy("x", "after").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("cum", F.sum("n").over(within)).filter("after <> 1")
    return events.join(bases, ["grp", "sid", "bucket"]).select("grp", "sid", "x", "after", (F.col("cum") + F.col("base")).alias("cum"))


def _after_conflicts(units: DataFrame, matched: DataFrame, names: DataFrame) -> DataFrame:
    """(outcome, topic, d): what classes of several units say of each other after their first conflict, twice and negative.

    The outcome of two shapes is looked up, so that a pair of classes costs a comparison of numbers."""
    c = F.col
    a = units.join(names, "e").select("other", c("class").alias("ca"), c("n").alias("na"), c("sid").alias("q1"), "o", c("value").alias("va"), c("lo").alias("la"), c("hi").alias("ha"))
    b = units.select(c("e").alias("other"), c("class").alias("cb"), c("n").alias("nb"), c("sid").alias("q2"), c("value").alias("vb"), c("lo").alias("lb"), c("hi").alias("hb"))
    j = a.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ca").join(matched, "q1").join(b, ["other", "q2"])
    j = j.filter((c("ca") < c("cb")) | ((c("ca") == c("cb")) & (c("na") > 1)))
    within = lambda lo, hi, v: lo.isNotNull() & (v >= lo * LOW) & (v <= hi * HIGH)
    inside = (c("label") == "range") & (within(c("la"), c("ha"), c("vb")) | within(c("lb"), c("hb"), c("va")))
    near = F.coalesce(_ratio(c("va"), c("vb")), F.lit(0.0)) <= FAR
    outcome = F.when(~c("label").isin("near", "range"), c("label")).when(inside, "range_average_compatible").when((c("rest") != "conflict") | ~near, c("rest"))
    pairs = F.when(c("ca") == c("cb"), c("na") * (c("na") - 1)).otherwise(2 * c("na") * c("nb"))
    rows = j.select("ca", "cb", "o", outcome.alias("outcome"), F.when(c("rest") == "conflict", c("topic")).alias("topic"), pairs.alias("d")).filter("outcome is not null")
    first = F.min(F.when(c("outcome") == "conflict", c("o"))).over(Window.partitionBy("ca", "cb"))
    late = rows.withColumn("__first", first).filter(c("o") > c("__first"))
    return late.select("outcome", F.when(c("outcome") == "conflict", c("topic")).alias("topic"), (-c("d")).alias("d"))


def numeric_counts(found: DataFrame, topics: tuple = ()) -> DataFrame:
    """(outcome, topic, n): the claim pairs that numeric_pairs stands for, by outcome; topic (of a conflict) needs classes with topics.

    No pair of classes is formed.  Everything but the value and the name makes a claim's shape; there are few shapes, and a pair
    of them has an outcome or leaves it to the values.  Then each point (distinct value) of one side counts the other side's
    claims in the intervals that do not conflict, by running sums in the order of values.  Known names meet their own and
    contained ones; unknown names, compatible with all, meet all known ones as one group.  Claims with several units are
    compared until the first that conflicts: what comes after it is taken off again, which does form the pairs of classes
    that share two units.

    Rows: points times shapes of a unit."""
    also = ("topics",) if topics else ()
    shape = ("unit", "s", "ctx", "prod", "kind", "metric", "meaning", "ranged", *also)
    flat = found.select("n", "e", "s", "ctx", "prod", "kind", *also, F.inline("m")).withColumn("ranged", F.col("lo").isNotNull())
    points = flat.groupBy("e", *shape, "value", "lo", "hi").agg(F.sum("n").alias("n")).withColumn("sid", F.xxhash64(*shape))
    points = stash(points.repartition("sid"), "points")
    known = points.filter("e <> ''").groupBy("sid", "value", "lo", "hi").agg(F.sum("n").alias("n")).withColumn("grp", F.lit("*"))
    own = points.select("sid", "value", "lo", "hi", "n", F.concat(F.lit("="), "e").alias("grp"))
    grouped = stash(own.unionByName(known), "groups")
    totals = grouped.groupBy("grp", "sid").agg(F.sum("n").alias("total"))

    shapes = points.select("sid", *shape).distinct()
    a, b = shapes.alias("a"), shapes.alias("b")
    A, B = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    gate, meaning = _gate(A, B), _meanings(A, B)
    label = F.when(gate != "open", gate).when(A("ranged") != B("ranged"), "range").when(meaning.isNotNull(), meaning).otherwise("near")
    topic = first_topic(A("topics").bitwiseOR(B("topics")), topics) if topics else F.lit(None).cast("string")
    matched = a.join(b, A("unit") == B("unit")).select(A("sid").alias("q1"), B("sid").alias("q2"), label.alias("label"), F.coalesce(meaning, F.lit("conflict")).alias("rest"), B("ranged").alias("turned"), topic.alias("topic")).filter("label <> 'none'")

    same = compatible_names(found).filter("e <> '' and other <> '' and e <= other").select(F.concat(F.lit("="), "e").alias("left"), F.concat(F.lit("="), "other").alias("right"))
    unknown = found.sparkSession.createDataFrame([("=", "="), ("=", "*")], "left string, right string")
    meet = same.unionByName(unknown)
    p = meet.join(totals.select(F.col("grp").alias("left"), F.col("sid").alias("q1"), F.col("total").alias("n1")), "left").join(matched, "q1")
    p = p.join(totals.select(F.col("grp").alias("right"), F.col("sid").alias("q2"), F.col("total").alias("n2")), ["right", "q2"])
    itself = (F.col("left") == F.col("right")) & (F.col("q1") == F.col("q2"))
    p = p.filter((F.col("left") != F.col("right")) | (F.col("q1") <= F.col("q2"))).withColumn("twice", F.when(itself, 1).otherwise(2))
    p = stash(p, "shapes")
    # all counts are doubled, as a group meets itself in ordered pairs
    closed = p.filter("label not in ('near', 'range')").select(F.col("label").alias("outcome"), F.lit(None).cast("string").alias("topic"), F.when(itself, F.col("n1") * (F.col("n1") - 1)).otherwise(2 * F.col("n1") * F.col("n2")).alias("d"))
    open_ = p.filter("label in ('near', 'range')")
    clash = F.col("rest") == "conflict"
    of_topic = F.when(clash, F.col("topic")).alias("topic")
    all_open = open_.select(F.col("rest").alias("outcome"), of_topic, (F.col("twice") * F.col("n1") * F.col("n2")).alias("d"))

    # the side with the range asks the side without one; else the left side asks the right one
    turned = (F.col("label") == "range") & F.col("turned")
    side = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    asks = open_.select(side("left", "right", "grp"), side("q1", "q2", "sid"), side("right", "left", "to_grp"), side("q2", "q1", "to_sid"), "label", "rest", of_topic, "twice")
    asks = asks.join(grouped, ["grp", "sid"])
    low, high = near_interval(F.col("value"))
    ranged = F.col("label") == "range"
    asks = asks.withColumns({"nl": low, "nh": high, "rl": F.when(ranged, F.col("lo") * LOW), "rh": F.when(ranged, F.col("hi") * HIGH)})
    asked = lambda on, x1, x2, outcome, sign: F.when(on & (x1 <= x2), F.struct(x1.alias("x1"), x2.alias("x2"), outcome.alias("outcome"), F.lit(sign).alias("sign")))
    c = F.col
    intervals = F.array_compact(F.array(
        asked(clash, c("nl"), c("nh"), c("rest"), -1),
        asked(ranged, c("rl"), c("rh"), F.lit("range_average_compatible"), 1),
        asked(ranged, c("rl"), c("rh"), c("rest"), -1),
        asked(ranged & clash, F.greatest("nl", "rl"), F.least("nh", "rh"), c("rest"), 1),
    ))
    asks = asks.select(c("to_grp").alias("grp"), c("to_sid").alias("sid"), "topic", (c("n") * c("twice")).alias("w"), F.inline(intervals))
    ends = F.array(F.struct(c("x2").alias("x"), F.lit(2).alias("after"), (c("w") * c("sign")).alias("w")), F.struct(c("x1").alias("x"), F.lit(0).alias("after"), (-c("w") * c("sign")).alias("w")))
    asks = asks.select("grp", "sid", "outcome", F.when(c("outcome") == "conflict", c("topic")).alias("topic"), F.inline(ends))
    asks = stash(asks.groupBy("grp", "sid", "x", "after", "outcome", "topic").agg(F.sum("w").alias("w")), "asked")
    got = _running(grouped, asks.select("grp", "sid", "x", "after").distinct())
    counted = asks.join(got, ["grp", "sid", "x", "after"]).select("outcome", "topic", (c("w") * c("cum")).alias("d"))

    every_unit = found.filter(F.size("m") > 1).select("class", "n", "e", "s", "ctx", "prod", "kind", *also, F.inline("m")).withColumn("ranged", F.col("lo").isNotNull())
    every_unit = stash(every_unit.withColumn("sid", F.xxhash64(*shape)).select("class", "n", "e", "sid", "o", "value", "lo", "hi"), "several")
    late = _after_conflicts(every_unit, matched, compatible_names(every_unit))
    every = closed.unionByName(all_open).unionByName(counted).unionByName(late)
    return every.groupBy("outcome", "topic").agg((F.sum("d") / 2).cast("long").alias("n")).filter("n <> 0")


def categorical_pairs(found: DataFrame, also: tuple[str, ...] = (), topics: tuple = ()) -> DataFrame:
    """One row for each pair of classes on opposite sides of an exclusive pair of terms that conflicts or is passed over:
    pair, terms, outcome, severity, topic, pairs and a_/b_ of the columns also.

    found: classes of categorical_signatures.  Claims that stand on both sides are compared both ways, the lower class's
    first side first; as numeric_pairs otherwise."""
    joined, pairs = _compared(found, "o", ("s", "ctx", "prod", *also))
    A, B = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    both = F.concat_ws(" ", A("term"), B("term"))
    stages = A("metric").isin(*L.LIFECYCLE) & B("metric").isin(*L.LIFECYCLE)
    outcome = (
        F.when(product_reason(A("prod"), B("prod")).isNotNull(), product_reason(A("prod"), B("prod")))
        .when(~metrics_compatible(A("metric"), B("metric")), F.when(stages & (A("metric") != B("metric")), "milestone_progression"))
        .when(~scopes_compatible(A("s"), B("s")), "scope_mismatch")
        .when(contexts_clash(A("ctx"), B("ctx")), "context_mismatch")
        .otherwise("conflict")
    )
    clash = outcome == "conflict"
    cooling = both.rlike("cool|liquid|dlc|water|air")
    topic = F.when(cooling, "cooling type").when(both.contains("phase"), "cooling phase").when(both.rlike("20(2[5-9]|30)"), "timeline")
    topic = topic.when(both.contains("gpu"), "gpu count").when(both.contains("nvl"), "rack type").otherwise("specification")
    if topics:
        topic = first_topic(A("topics").bitwiseOR(B("topics")), topics)
    cols = [A("class").alias("class_a"), B("class").alias("class_b"), A("o").alias("pair"), A("side").alias("__side"), A("term").alias("term_a"), B("term").alias("term_b"), outcome.alias("outcome"), pairs.alias("pairs")]
    cols += [F.when(clash, F.when(cooling, "high").otherwise("medium")).alias("severity"), F.when(clash, topic).alias("topic")]
    out = joined.filter(A("side") != B("side")).select(*cols, *[f(c).alias(f"{s}_{c}") for c in also for s, f in (("a", A), ("b", B))])
    return _until_conflict(out, 2 * F.col("pair") + F.col("__side")).drop("__side")


#: A token of more classes than this is met by ranges of durations, each a key of its own.
HOT_TOKEN = 64


def _octave(months: Column) -> Column:
    """Quarter of an octave that a duration is in: nondecreasing, a few dozen up to a century."""
    return F.greatest(F.floor(F.log2(F.greatest(months, F.lit(1.0))) * 4), F.lit(0)).cast("int")


def duration_pairs(found: DataFrame) -> DataFrame:
    """Pairs of classes with disjoint durations (months) of one kind whose claims share a subject token: ratio, severity,
    topic and pairs.  found: classes of duration_signatures.

    A pair is formed once, at the rarest token that it shares.  Of a hot token the later durations are keyed by the octave of
    their start, and the earlier ones come to every octave from their end on, so that no task compares all with all."""
    counts = found.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ranked = found.select("class", F.explode("w").alias("token")).join(counts, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("w"))
    t = stash(found.drop("w").join(ranked, "class"), "durations")
    last = t.agg(F.max(_octave(F.col("lo")))).first()[0] or 0
    t = t.withColumn("t", F.explode("w"))
    hot = F.col("t.df") > HOT_TOKEN
    every = F.when(_octave(F.col("hi")) <= last, F.sequence(_octave(F.col("hi")), F.lit(last))).otherwise(F.array().cast("array<int>"))
    a = t.withColumn("at", F.explode(F.when(hot, every).otherwise(F.array(F.lit(-1))))).alias("a")
    b = t.withColumn("at", F.when(hot, _octave(F.col("lo"))).otherwise(-1)).alias("b")
    A, B = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    on = (A("t.token") == B("t.token")) & (A("metric") == B("metric")) & (A("at") == B("at")) & (A("hi") < B("lo"))
    on = on & (F.get(F.array_intersect(A("w"), B("w")), 0) == A("t"))
    mid_a, mid_b = (A("lo") + A("hi")) / 2, (B("lo") + B("hi")) / 2
    ratio = F.abs(mid_a - mid_b) / F.greatest(mid_a, mid_b)
    topic = F.when(A("metric") == "duration_construction", "construction duration").otherwise("timeline")
    low, high = F.least(A("class"), B("class")), F.greatest(A("class"), B("class"))
    return a.join(b, on).select(low.alias("class_a"), high.alias("class_b"), F.round(ratio, 6).alias("ratio"), F.when(ratio >= 0.5, "high").otherwise("medium").alias("severity"), topic.alias("topic"), (A("n") * B("n")).alias("pairs"))


def mismatches(found: DataFrame, on: str) -> DataFrame:
    """(pairs): comparisons that incompatible names rule out: all that share ``on`` (unit, or o on opposite sides) but those of compatible names.

    Counted from sizes alone, by name and ``on``."""
    sided = on == "o"
    flat = found.select("class", "n", "e", F.inline("m"))
    side = F.col("side") if sided else F.lit(0)
    by = flat.groupBy("e", on).agg(*[F.sum(F.when(side == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in (0, 1)])
    names = compatible_names(found)
    a, b = by.join(names, "e").alias("a"), by.alias("b")
    met = a.join(b, (F.col("a.other") == F.col("b.e")) & (F.col(f"a.{on}") == F.col(f"b.{on}"))).groupBy(F.col(f"a.{on}").alias(on))
    total = by.groupBy(on).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    # ordered pairs of claims; those of a claim with itself cancel out
    if sided:
        met, all_pairs = met.agg(F.sum(F.col("a.n0") * F.col("b.n1")).alias("met")), F.col("t0") * F.col("t1")
    else:
        met, all_pairs = met.agg((F.sum(F.col("a.n0") * F.col("b.n0"))).alias("met")), F.col("t0") * F.col("t0")
    share = 1 if sided else 2
    rest = total.join(met, on).agg(F.coalesce(F.sum((all_pairs - F.col("met")) / share), F.lit(0)).cast("long").alias("pairs"))
    return rest


def suppression_metrics(pairs: DataFrame, mismatched: DataFrame | None = None) -> DataFrame:
    """Claim pairs by outcome, of rows with pairs or of numeric_counts; mismatched (pairs) counts as entity_mismatch."""
    rows = pairs.select("outcome", F.col("n" if "n" in pairs.columns else "pairs").alias("pairs"))
    if mismatched is not None:
        rows = rows.unionByName(mismatched.select(F.lit("entity_mismatch").alias("outcome"), "pairs").filter("pairs > 0"))
    return rows.groupBy("outcome").agg(F.sum("pairs").alias("n"))


#: Presence flags of the summary and the reasons that raise them.
FLAGS = {
    "scope_filtering_present": ("scope_mismatch", "metric_scope_mismatch"),
    "entity_filtering_present": ("entity_mismatch",),
    "temporal_filtering_present": ("temporal_progression",),
    "product_filtering_present": ("product_mismatch", "generation_progression"),
    "range_filtering_present": ("range_average_compatible",),
    "context_filtering_present": ("context_mismatch",),
    "threshold_filtering_present": ("threshold_vs_measurement",),
    "historical_filtering_present": ("historical_progression",),
}


def suppression_summary(metrics: DataFrame) -> DataFrame:
    """One row from suppression_metrics: candidate, suppressed and final counts, and which filters were at work."""
    of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long")
    final = F.col("outcome") == "conflict"
    counts = [F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("candidate_count"), of(~final).alias("suppressed_count"), of(final).alias("final_count")]
    return metrics.agg(*counts, *[(of(F.col("outcome").isin(*reasons)) > 0).alias(flag) for flag, reasons in FLAGS.items()])


def expanded(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """The claim pairs (a, b, a < b) of pairs of classes, with the pairs' columns: as many rows as the report counts."""
    a, b, p = member.alias("a"), member.alias("b"), pairs.alias("p")
    rows = p.join(a, F.col("p.class_a") == F.col("a.class")).join(b, F.col("p.class_b") == F.col("b.class"))
    rows = rows.filter((F.col("p.class_a") != F.col("p.class_b")) | (F.col("a.k") < F.col("b.k")))
    low, high = F.least("a.k", "b.k"), F.greatest("a.k", "b.k")
    return rows.select(low.alias("a"), high.alias("b"), *[f"p.{c}" for c in pairs.columns if c not in ("class_a", "class_b", "pairs")])
