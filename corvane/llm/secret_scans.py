"""Secret scans over a trigram inverted index, in DataFrame functions only.

Every rule's regex yields a Boolean query over trigrams of lower-cased text, in disjunctive form.  The index is
local to each document: its postings, limited to the trigrams that some query names, are bits of a few longs.
Intersecting them decides which rules the document is a candidate of, and only those rules' regexes run on it, in the
same pass: neither texts nor postings are shuffled.  A rule whose regex has no mandatory trigram scans every text.

Spans are code points, end exclusive, leftmost and non-overlapping per rule.

Cases: a null text is an empty one; texts without a match have no spans, the hash of the empty string, and
counts of 0; repeated rows give equal rows; null ids are kept; an empty table gives an empty result; texts are read
whole, and what is done with their matches is folded in blocks, so that no text's work grows with the square of its
matches; other columns may have any names: masked rows keep them, a digest reads the id and the text.
"""

from __future__ import annotations

import re._constants as sre_constants
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import before_each, bound


@dataclass(frozen=True)
class Rule:
    """kind, regex, and for a rule whose short matches are dropped the group that has a least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base rules.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("url", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
BASE = 3
MASK = "[SECRET]"
CHUNK = 1024
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def _least(clauses: set[frozenset[str]]) -> Query:
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: Query, b: Query) -> Query:
    return _least({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def trigram_query(pattern: str) -> Query:
    """Clauses of trigrams of which a text must hold one clause wholly to match; ALWAYS if none is mandatory."""

    def walk(nodes: list) -> tuple[set[str] | None, Query]:
        """Exact strings if there are few, and the query besides."""
        run, query = {""}, ALWAYS
        for op, arg in nodes:
            exact, inner = node(op, arg)
            query = _both(query, inner)
            joined = {a + b for a, b in product(run, exact)} if exact is not None and run is not None else None
            if joined is not None and len(joined) <= 64:
                run = joined
            else:
                query = _both(query, _of_strings(run))
                exact_now = exact if exact is not None else {""}
                run = exact_now
                broken.append(True)
        return run, query

    def node(op: object, arg: object) -> tuple[set[str] | None, Query]:
        if op is sre_constants.LITERAL:
            return {chr(arg).lower()}, ALWAYS
        if op is sre_constants.IN and len(arg) <= 8 and all(o is sre_constants.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}, ALWAYS
        if op is sre_constants.SUBPATTERN:
            return whole(arg[-1])
        if op is sre_constants.BRANCH:
            parts = [whole(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                return set().union(*(e for e, _ in parts)), ALWAYS
            return None, _least({c for e, q in parts for c in (_both(q, _of_strings(e)) if e is not None else q)})
        if op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT):
            low, high, inner = arg
            exact, query = whole(inner)
            if (low, high) == (0, 1) and exact is not None:
                return exact | {""}, ALWAYS
            return None, (query if exact is None else _of_strings(exact)) if low else ALWAYS
        return None, ALWAYS

    def whole(nodes: object) -> tuple[set[str] | None, Query]:
        before = len(broken)
        run, query = walk(list(nodes))
        return (run, query) if len(broken) == before else (None, _both(query, _of_strings(run)))

    broken: list[bool] = []
    run, query = walk(list(sre_parser.parse(pattern)))
    return _both(query, _of_strings(run))


def trigrams(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries name, in order."""
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for g in clause})


def postings(text: Column, grams: list[str]) -> Column:
    """A document's postings: bit i % 62 of word i // 62 tells whether its text has the i-th trigram."""
    return bound(F.lower(text), lambda low: F.array(*[_any_bits([(F.contains(low, F.lit(g)), i) for i, g in enumerate(grams[w : w + 62])]) for w in range(0, len(grams), 62)]))


def _any_bits(held: list[tuple[Column, int]]) -> Column:
    out = F.lit(0).cast("long")
    for has, i in held:
        out = out + F.when(has, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out


def candidates(held: Column, grams: list[str], rules: tuple[Rule, ...]) -> Column:
    """Bits of the indexed rules whose query a document's postings satisfy."""
    said = []
    for n, r in enumerate(rules):
        query = trigram_query(r.pattern)
        if query == ALWAYS:
            continue
        hit = F.lit(False)
        for clause in sorted(query, key=sorted):
            at = [grams.index(g) for g in clause]
            every = F.lit(True)
            for w in sorted({i // 62 for i in at}):
                mask = sum(1 << (i % 62) for i in at if i // 62 == w)
                every &= F.get(held, F.lit(w)).bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long")
            hit |= every
        said.append((hit, n))
    return _any_bits(said)


def _rule_spans(text: Column, n: int, r: Rule) -> Column:
    """(start, rank, end) of a rule's matches that are long enough."""
    find = lambda group: F.regexp_extract_all(text, F.lit(r.pattern), F.lit(group))

    def of(m: Column) -> Column:
        value = find(r.group) if r.group else m
        parts = F.zip_with(F.slice(F.split(text, r.pattern, -1), F.lit(1), F.size(m)), m, lambda p, x: F.struct(F.length(p).alias("p"), F.length(x).alias("m")))
        at = lambda z: before_each(F.transform(z, lambda x: x["p"] + x["m"]), F.lit(0), lambda a, x: a + x)
        spans = lambda z: F.zip_with(z, at(z), lambda x, o: F.struct((o + x["p"]).alias("start"), F.lit(n).alias("rank"), (o + x["p"] + x["m"]).alias("end")))
        return F.array_compact(F.zip_with(bound(parts, spans), value, lambda s, v: F.when(F.length(v) >= r.least, s)))

    return bound(find(0), lambda m: F.when(F.size(m) > 0, of(m)).otherwise(_NONE()))


def _NONE() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int>>")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and the text, with __spans: array of (start, rank, end) of every row, in order."""
    grams = trigrams(rules)
    d = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__text"))
    d = d.select(*keep, "__text", candidates(postings(F.col("__text"), grams), grams, rules).alias("__rules"))
    found = []
    for n, r in enumerate(rules):
        spans = _rule_spans(F.col("__text"), n, r)
        if trigram_query(r.pattern) != ALWAYS:
            spans = F.when(F.col("__rules").bitwiseAND(F.lit(1 << n).cast("long")) != 0, spans).otherwise(_NONE())
        found.append(spans)
    # generated, so that no filter or projection on top computes the spans again
    return d.select(*keep, "__text", F.explode(F.array(F.sort_array(F.concat(*found)))).alias("__spans"))


def _said(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, counts of the base rules, the hash of their spans, and all spans."""
    d = scan(docs, rules, text, (id_column,))
    base = F.filter("__spans", lambda s: s["rank"] < BASE)

    def count(n: int) -> Column:
        return F.size(F.filter("__spans", lambda s: s["rank"] == n)).cast("long").alias(f"n_{rules[n].kind}")

    counts = [count(n) for n in range(BASE)]
    return d.select(id_column, *counts, F.sha2(_said(base, rules), 256).alias("base_sha256"), _said(F.col("__spans"), rules).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans masked; pieces between them are put together from chunks of CHUNK characters."""
    end = lambda s: F.aggregate(s, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
    reached = before_each(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))

    def with_chunks(chunks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            part = lambda j: F.substring(F.get(chunks, j), F.greatest(a - j * CHUNK, F.lit(0)) + 1, F.least(b, (j + 1) * CHUNK) - F.greatest(a, j * CHUNK))
            at = F.sequence(F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int"))
            return F.when(a < b, F.array_join(F.transform(at, part), "")).otherwise("")

        pieces = F.array_compact(F.zip_with(spans, reached, lambda s, o: F.when(s["start"] >= o, F.concat(cut(o, s["start"]), F.lit(MASK)))))
        return F.concat(F.array_join(pieces, ""), cut(end(spans), F.length(text)))

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), with_chunks)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows with every span (overlapping ones as one) replaced by MASK; a null text stays null."""
    # other columns go along under names of ours, which cannot clash
    others = [c for c in docs.columns if c != text]
    held = {c: f"__c{i}" for i, c in enumerate(others)}
    packed = docs.select(docs[text], *[docs[c].alias(n) for c, n in held.items()], docs[text].isNull().alias("__null"))
    d = scan(packed, rules, text, (*held.values(), "__null"))
    new = F.when(F.col("__null"), None).when(F.size("__spans") == 0, F.col("__text")).otherwise(_masked(F.col("__text"), F.col("__spans")))
    d = d.select(*held.values(), F.explode(F.array(new)).alias("__new"))
    return d.select(*[F.col("__new" if c == text else held[c]).alias(c) for c in docs.columns])


def _oracle() -> str:
    parts = []
    for n, r in enumerate(RULES):
        p = r.pattern
        if "(?i:" in p:
            words = p[p.index("(?i:") + 4 : p.index(")")]
            p = p.replace(f"(?i:{words})", "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")")
        q = p.replace("'", "''")
        value = f"regexp_extract_all(t, '{q}', {r.group})"
        parts.append(
            f"""select rid, {n} rk, '{r.kind}' kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) s,
            length(m[i]) n, length(v[i]) vn, {r.least} least from (select rid, m, v, p, unnest(range(1, len(m) + 1)) i from
            (select rid, regexp_extract_all(t, '{q}') m, {value} v, string_split_regex(t, '{q}') p from d) where len(m) > 0)"""
        )
    return f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
    s as (select * from ({" union all ".join(parts)}) where vn >= least),
    a as (select rid, {", ".join(f"count(*) filter (where rk = {n}) c{n}" for n in range(BASE))},
      coalesce(string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, rk) filter (where rk < {BASE}), '') base,
      string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, rk) spans from s group by rid)
    select doc_id, {", ".join(f"coalesce(c{n}, 0)::bigint n_{RULES[n].kind}" for n in range(BASE))}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
    from d left join a on d.rid = a.rid"""


ORACLE_SQL = _oracle()
