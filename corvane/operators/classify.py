"""Ordered classifiers of chunks, claims, questions and sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.functions import text as T

SIGNALS = (("numeric", L.NUMERIC_CLAIM), ("entity", L.NAMED_ENTITY), ("date", L.DATE), ("unit", L.UNIT), ("comparative", L.COMPARATIVE), ("policy", L.POLICY))


#: A piece between sentence ends that is not blank; one of more than eight words.  A match takes the whole piece.
_PIECE = r"[^.!?\n \t\r\f\x0B][^.!?\n]*"
_LONGER = r"(?:[^.!?\n \t\r\f\x0B]+[ \t\r\f\x0B]+){8}[^.!?\n \t\r\f\x0B][^.!?\n]*"
#: Lists of patterns that a chunk is tried for, beside the signals; headers stand in its first 400 characters.
_LISTS = {"toc": L.TOC, "legal": L.LEGAL, "navigation": L.NAVIGATION, "references": L.REFERENCES, "hard": L.HARD_BOILERPLATE}
_LOOKS = (*[n for n, _ in SIGNALS], *_LISTS, "header", "listy")


def looks(text: Column) -> Column:
    """What a text may match, as bits in the order of _LOOKS; the last one, whether it has five pieces or more and most of them
    short, is exact."""
    headers, piece, longer = "|".join(map(R.loose, L.PRIORITY_HEADERS)), _PIECE, _LONGER

    def more(t: pa.Array) -> tuple[pa.Array, pa.Array]:
        import pyarrow as pa
        import pyarrow.compute as pc

        n = pc.count_substring_regex(t, piece)
        short = pc.subtract(n, pc.count_substring_regex(t, longer)).cast(pa.float64())
        listy = pc.and_(pc.greater_equal(n, 5), pc.greater(pc.divide(short, pc.max_element_wise(n, 1).cast(pa.float64())), 0.6))
        return pc.match_substring_regex(pc.utf8_slice_codeunits(t, 0, 400), headers), listy

    return R.looked(text, [*[(p,) for _, p in SIGNALS], *_LISTS.values()], more)


def _may(bits: Column, name: str) -> Column:
    return F.coalesce(bits.bitwiseAND(1 << _LOOKS.index(name)) != 0, F.lit(True))


def _hits(text: Column, name: str, patterns: Sequence[str], bits: Column) -> Column:
    """How many of the patterns a text matches; they are tried if the text may match one."""
    return F.when(~_may(bits, name), 0).otherwise(R.bound(F.lower(text), lambda low: R.pattern_hits(text, patterns, low)))


def signals(text: Column, bits: Column) -> Column:
    """Counts of the six evidence signals; bits: the looks of the text, so below."""
    return F.struct(*[F.when(~_may(bits, n), 0).otherwise(R.matches(text, p)).alias(n) for n, p in SIGNALS])


def signal_total(s: Column) -> Column:
    return sum((s[n] for n, _ in SIGNALS[1:]), s[SIGNALS[0][0]])


def signal_score(s: Column) -> Column:
    return F.least(signal_total(s) / 10.0, F.lit(1.0))


def boilerplate(text: Column, bits: Column) -> Column:
    hits = lambda n: _hits(text, n, _LISTS[n], bits)
    short = F.length(F.btrim(text, F.lit(" \t\n\r\f\x0b"))) < 150
    return short | (hits("toc") >= 2) | (hits("legal") >= 2) | (hits("navigation") >= 3) | (bits.bitwiseAND(1 << _LOOKS.index("listy")) != 0)


def hard_boilerplate(text: Column, bits: Column) -> Column:
    return _hits(text, "hard", L.HARD_BOILERPLATE, bits) >= 1


def overriding(s: Column) -> Column:
    return (s["numeric"] >= 10) | (s["unit"] >= 8) | (s["policy"] >= 10) | (s["entity"] >= 75)


def chunk_class(text: Column, s: Column, hard: Column, bits: Column) -> Column:
    """(type, priority) of a chunk: strong signals first, then boilerplate, references, headers, signal strength."""
    made = lambda kind, priority: F.struct(F.lit(kind).alias("chunk_type"), F.lit(priority).alias("priority"))
    strength = signal_score(s)
    return (
        F.when(~hard & overriding(s), made("evidence_dense", "high"))
        .when(hard | boilerplate(text, bits), made("boilerplate", "skip"))
        .when(_hits(text, "references", L.REFERENCES, bits) >= 2, made("reference", "skip"))
        .when(_hits(F.substring(text, 1, 400), "header", L.PRIORITY_HEADERS, bits) >= 1, made("evidence_dense", "high"))
        .when((strength >= 0.6) | ((s["numeric"] >= 3) & (s["unit"] >= 2)), made("evidence_dense", "high"))
        .when((strength >= 0.3) | (s["numeric"] >= 1) | (s["policy"] >= 1), made("evidence_dense", "medium"))
        .otherwise(made("context", "low"))
    )


def classified(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Chunks with signals, chunk_type and priority.  What is used more than once is generated, so that no later stage finds it again."""
    t, bits = F.col(text), F.col("__looks")
    c = R.once(R.once(chunks.withColumn("__looks", looks(t)), "signals", signals(t, bits)), "__hard", hard_boilerplate(t, bits))
    c = R.once(c, "__c", chunk_class(t, F.col("signals"), F.col("__hard"), bits))
    return c.withColumns({"chunk_type": F.col("__c.chunk_type"), "priority": F.col("__c.priority")}).drop("__c", "__looks", "__hard")


def evidence_type(text: Column) -> Column:
    return R.first_pattern(text, L.EVIDENCE_TYPES, "fact")


def store_type(statement: Column, category: Column) -> Column:
    """Type of a stored statement; decides its retrieval defaults."""
    return (
        F.when(R.any_term(statement, L.ADMINISTRATIVE), "ADMINISTRATIVE")
        .when(R.any_term(statement, L.PROVENANCE), "PROVENANCE")
        .when(R.any_term(category, L.TECHNICAL_CATEGORIES) | statement.rlike(L.TECHNICAL_UNIT), "TECHNICAL")
        .otherwise("STRATEGIC")
    )


def retrieval_defaults(kind: Column) -> Column:
    out = None
    for name, (enabled, priority, value) in L.RETRIEVAL_DEFAULTS.items():
        out = R.when(out, kind == name, F.struct(F.lit(enabled).alias("enabled"), F.lit(priority).alias("priority"), F.lit(value).alias("value")))
    return out


#: Tiers of a profile's hints in their order, with type and score.
TIERS = (("synthetic", "synthetic", 1), ("primary", "authoritative_primary", 5), ("secondary", "industry_vendor", 4), ("tertiary", "independent_technical", 3))


def source_quality(name: Column, hints: Mapping[str, Sequence[str]] | None = None, rules: Sequence[tuple[Sequence[str], str, int]] = ()) -> Column:
    """(type, score) of a document by its name: by a profile's hints (tier -> terms, any), its rules (terms, all), then the general ones."""
    made = lambda kind, score: F.struct(F.lit(kind).alias("source_type"), F.lit(score).alias("quality"))
    out = None
    for tier, kind, score in TIERS:
        if terms := (hints or {}).get(tier):
            out = R.when(out, R.any_term(name, terms), made(kind, score))
    for terms, kind, score in rules:
        out = R.when(out, R.term_hits(name, terms) == len(terms), made(kind, score))
    for terms, kind, score in L.SOURCE_QUALITY:
        out = R.when(out, R.term_hits(name, terms) == len(terms), made(kind, score))
    return out.when(F.lower(name).endswith(".txt"), made("synthetic", 1)).otherwise(made("unknown", 2))


def domain(name: Column) -> Column:
    return F.when(R.any_term(name, L.SMR_SIGNALS), "smr").otherwise("ai_dc")


def perspective(claim: Column, of_domain: Column) -> Column:
    return F.when(of_domain == "smr", R.densest(claim, L.PERSPECTIVES_SMR, "general")).otherwise(R.densest(claim, L.PERSPECTIVES_AI_DC, "general"))


def topics(text: Column) -> Column:
    return R.labels(text, L.TOPICS)


def category(snippet: Column) -> Column:
    return R.first_terms(snippet, L.CATEGORY_LADDER, "other")


def normal_category(topic: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in L.CATEGORY_ALIASES.items() for x in kv])
    return F.when(topic.isin(*L.CATEGORIES), topic).otherwise(F.coalesce(F.element_at(aliases, topic), F.lit("other")))


def source_local(claim: Column) -> Column:
    """Whether a claim compares nothing across documents."""
    return ~claim.rlike(L.CROSS_COMPARISON)


def question_mode(question: Column) -> Column:
    words = T.tokens(question, "[a-z][a-z0-9-]{1,}")
    exploring = F.arrays_overlap(words, F.array(*map(F.lit, L.EXPLORATORY))) | question.rlike(L.EXPLORATORY_PHRASE)
    out = F.when(exploring, "EXPLORATORY_RESEARCH")
    for mode, pattern in L.QUESTION_MODES:
        out = out.when(question.rlike(pattern), mode)
    content = F.size(T.tokens(question, "[a-z][a-z0-9-]{1,}", L.QUERY_STOP))
    return out.when(content <= 8, "FACT_LOOKUP").otherwise("EXPLORATORY_RESEARCH")


def entity_lock(question: Column) -> Column:
    """Most specific product named, as written (case counts)."""
    out = None
    for name, spellings in L.ENTITY_LOCKS:
        hit = F.lit(False)
        for s in spellings:
            hit = hit | F.contains(question, F.lit(s))
        out = R.when(out, hit, name)
    return out


def metric_lock(question: Column) -> Column:
    out = None
    for name, pattern in L.METRIC_LOCKS:
        out = R.when(out, question.rlike(pattern), name)
    return out


def entity(claim: Column) -> Column:
    """(entity, entity_type) by the first rule; empty strings if none."""
    made = lambda name, kind: F.struct(name.alias("entity"), F.lit(kind).alias("entity_type"))
    out = None
    for pattern, name, change, kind in L.ENTITIES:
        value = F.regexp_extract(claim, pattern, 1) if "{1}" in name else F.lit("")
        if change == "u":
            value = F.upper(value)
        elif change == "t":
            value = F.initcap(value)
        shown = F.concat(F.lit(name.split("{1}")[0]), value) if "{1}" in name else F.lit(name)
        out = R.when(out, claim.rlike(pattern), made(shown, kind))
    return out.otherwise(made(F.lit(""), ""))


def scope(claim: Column, entity_type: Column | None = None) -> Column:
    found = R.first_pattern(claim, L.SCOPES, "unknown")
    if entity_type is None:
        return found
    natural = F.create_map(*[F.lit(x) for kv in L.ENTITY_TYPE_SCOPE.items() for x in kv])
    return F.when(found != "unknown", found).otherwise(F.coalesce(F.element_at(natural, entity_type), F.lit("unknown")))


def temporal_kind(text: Column) -> Column:
    return F.when(text.rlike(L.RATE), "rate").when(text.rlike(L.TARGET) | text.rlike(L.PROJECTION), "target").when(text.rlike(L.CURRENT), "current").otherwise("unknown")


def comparison_context(claim: Column) -> Column:
    kind = temporal_kind(claim)
    out = None
    for name, pattern in L.CONTEXTS:
        out = R.when(out, claim.rlike(pattern), name)
    return out.when(kind == "target", "future_projection").when(kind == "current", "current_deployment").otherwise("unknown")


def year_context(text: Column, year: Column) -> Column:
    """What a year in a text stands for, from the 80 characters on either side."""
    at = F.instr(text, year) - 1
    near = T.window(text, at, 80, 84)
    return F.when(at < 0, "year_generic").otherwise(R.first_pattern(near, L.MILESTONES, "year_generic"))


def recovery_reason(sentence: Column) -> Column:
    return R.first_pattern(sentence, L.RECOVERY_REASONS, "other")


def prohibited_use(answer: Column, term: Column) -> Column:
    """Why a prohibited term is allowed where it first occurs, else no_exemption_found; term_absent if it does not."""
    low = F.lower(answer)
    at = F.instr(low, F.lower(term)) - 1
    sentence = F.lower(T.sentence_at(answer, at))
    start, end = F.greatest(at - 350, F.lit(0)), F.least(at + 350, F.length(answer))
    head = F.regexp_extract(F.substring(answer, F.lit(1), start), r"([^.!?\n]*)$", 1)
    tail = F.regexp_extract(F.substring(answer, end + 1, F.length(answer)), r"^([^.!?\n]*)", 1)
    paragraph = F.lower(F.concat(head, F.substring(answer, start + 1, end - start), tail))
    return (
        F.when(at < 0, "term_absent")
        .when(T.window(low, at, 40, 0).rlike(L.NEGATION), "pre_term_negation")
        .when(sentence.rlike(L.EXEMPT), "sentence_exemption")
        .when(F.rtrim(sentence).endswith("?"), "interrogative_sentence")
        .when(sentence.rlike(L.CONTRASTIVE), "contrastive_context")
        .when(paragraph.rlike(L.EXEMPT), "paragraph_exemption")
        .when(paragraph.rlike(L.CONTRASTIVE), "paragraph_contrastive")
        .otherwise("no_exemption_found")
    )


def penalised(reason: Column) -> Column:
    return reason == "no_exemption_found"
