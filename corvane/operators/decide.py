"""Decision records: recommendation dimensions and repairs, confidence, memo rules, provenance, caps, templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions import rules as R
from corvane.functions import text as T
from corvane.operators import terms

# Words that a recommendation is judged by.
ACTION_VERBS = ("invest", "deploy", "build", "develop", "prioritize", "implement", "adopt", "establish", "expand", "reduce", "increase", "commission", "procure", "integrate", "partner", "launch", "accelerate", "begin", "start", "transition", "shift", "require", "mandate", "fund", "negotiate", "secure", "contract", "design", "upgrade", "replace")
HEDGE_VERBS = ("monitor", "evaluate", "consider", "explore", "assess", "review", "investigate", "study", "examine", "analyze", "watch", "track", "observe", "await", "continue")
TRADEOFF_WORDS = ("however", "but", "although", "while", "trade-off", "tradeoff", "trade off", "cost", "benefit", "challenge", "constraint", "drawback", "limitation", "whereas", "despite", "downside", "upside", "offset", "compromise", "balance")
# Marks of a document's revision, version, number and date.
#: Versions, numbers and months of documents.
REVISION = r"(?im)(?:^|\s)(?:revision|rev\.?)\s+([A-Z0-9][A-Z0-9._-]*)"
VERSION = r"(?im)(?:^|\s)(?:version|ver\.?)\s+(\d+(?:\.\d+)+)"
DOCUMENT_NUMBERS = (r"\b\d{3}[A-Z]\d{4}\b", r"\bDOE[-/][A-Z]{1,4}[-/][A-Z0-9][-\d]{2,}\b", r"\bNUREG[-/]\d{4,5}\b", r"\bNEA[-/][A-Z]{2,}[-/]\d{4}(?:/\d+)?\b", r"\bINL[-/][A-Z]{2,4}[-/]\d{2,4}[-/]\d{4,6}\b", r"\bIAEA[-/][A-Z\-]{3,}[-/]\d{4}\b")
MONTH_YEAR = r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(?:\d{1,2},?\s+)?(\d{4})\b"
# Kinds of research question, tried in order, and areas that a question's words open.
RESEARCH_TYPES = (("COMPARISON", r"compare| vs |versus|difference between|contrast"), ("EXPLANATION", r"why |how does|how do|explain|what causes|reason for"), ("FACT_LOOKUP", r"^(what is |what are |how many |how much |list |name |when )|output capacity|power output|how many|how much|what is the"))
QUESTION_AREAS = (("power", "Power"), ("cool", "Cooling"), ("cost", "Economics"), ("econom", "Economics"), ("deploy", "Deployment Timeline"), ("grid", "Grid Integration"), ("regulat", "Regulation"), ("safety", "Safety"), ("nuclear", "Nuclear Technology"), ("smr", "SMR Technology"), ("data center", "Data Center Requirements"), ("nvidia", "NVIDIA Technology"), ("gpu", "GPU Architecture"))
KIND_CATEGORIES = {"STRATEGIC": "other", "TECHNICAL": "other", "ECONOMIC": "economics", "RISK": "other", "REGULATORY": "licensing", "OPERATIONAL": "operations"}


def reasoning(n_hypotheses: Column, n_known: Column, rationale: Column, summary: Column) -> Column:
    s = F.when(n_hypotheses > 0, 0.40).otherwise(0.0) + F.when((n_hypotheses > 0) & (n_known > 0), 0.10).otherwise(0.0)
    s = s + F.when(F.length(rationale) >= 20, 0.25).otherwise(0.0) + F.when(F.length(summary) >= 100, 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(s, 3))


def tradeoff(summary: Column, n_triggers: Column) -> Column:
    s = F.when(R.any_term(summary, TRADEOFF_WORDS), 0.55).otherwise(0.0) + F.when(n_triggers > 0, 0.30).otherwise(0.0) + F.when(F.length(summary) >= 150, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(s, 3))


def actionability(title: Column, summary: Column, horizon: Column, priority: Column) -> Column:
    said = F.concat_ws(" ", title, summary)
    act = R.any_term(said, ACTION_VERBS)
    s = F.when(act, 0.50).otherwise(0.0) + F.when((R.term_hits(said, HEDGE_VERBS) >= 2) & ~act, 0.0).otherwise(0.20)
    s = s + F.when(horizon.isin("near_term", "medium_term", "long_term"), 0.15).otherwise(0.0) + F.when(priority.isin("high", "medium"), 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(s, 3))


def repairs(title: Column, summary: Column, n_risks: Column, n_evidence: Column, n_hypotheses: Column, rationale: Column) -> Column:
    """Names of the repairs that a recommendation needs, in order."""
    said = F.concat_ws(" ", title, summary)
    hedged = (R.term_hits(said, HEDGE_VERBS) >= 2) & ~R.any_term(said, ACTION_VERBS)
    rules = (("tradeoff", ~R.any_term(summary, TRADEOFF_WORDS)), ("risk", n_risks < 2), ("evidence", n_evidence == 0), ("actionability", hedged), ("reasoning", (F.length(rationale) < 40) | (n_hypotheses == 0)))
    return F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))


def executive_confidence(analysis: Column, critical: Column, weak: Column, high_risks: Column) -> Column:
    """(overall, readiness, board advice)."""
    made = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("overall", "readiness", "advice"), v, strict=True)])
    return (
        F.when((analysis == "High") & (critical <= 2) & (weak == 0), made("High", "Ready for Decision", "Proceed"))
        .when((analysis == "Low") | (high_risks >= 3) | (weak >= 2), made("Low", "Not Ready", "Delay Pending Evidence"))
        .otherwise(made("Medium", "Needs Additional Validation", "Proceed with Conditions"))
    )


def next_action(confidence: Column, uncovered: Column, unsupported: Column) -> Column:
    return (
        F.when(confidence != "LOW", "CONTINUE")
        .when((uncovered >= 3) & (unsupported >= 2), "REQUEST_REPLAN")
        .when((uncovered >= 1) | (unsupported >= 1), "REQUEST_EVIDENCE")
        .otherwise("CONTINUE")
    )


def research_type(question: Column) -> Column:
    return R.first_pattern(F.lower(question), RESEARCH_TYPES, "RESEARCH")


def question_areas(question: Column) -> Column:
    opened = F.array_compact(F.array(*[F.when(F.contains(F.lower(question), F.lit(w)), a) for w, a in QUESTION_AREAS]))
    return F.concat(F.array(F.lit("Overview")), F.array_distinct(opened), F.array(F.lit("Key Findings"), F.lit("Open Questions")))


def subquestions(question: Column) -> Column:
    """The questions that a research type opens, without a model."""
    chain = None
    for kind, templates in L.SUBQUESTIONS.items():
        made = F.array(*[F.concat(F.lit(t.removesuffix("{q}")), question) if t.endswith("{q}") else F.lit(t) for t in templates])
        chain = R.when(chain, research_type(question) == kind, made)
    return chain


def document_version(text: Column) -> Column:
    rev, ver = F.regexp_extract(text, REVISION, 1), F.regexp_extract(text, VERSION, 1)
    return F.when(rev != "", F.concat(F.lit("Revision "), F.upper(rev))).when(ver != "", F.concat(F.lit("Version "), ver))


def document_number(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.left(text, F.lit(800)), p, 0), F.lit("")) for p in DOCUMENT_NUMBERS])


def publication_month(text: Column) -> Column:
    month = F.initcap(F.regexp_extract(text, MONTH_YEAR, 1))
    return F.when(month != "", F.try_to_timestamp(F.concat_ws(" ", month, F.regexp_extract(text, MONTH_YEAR, 2)), F.lit("MMMM yyyy")).cast("date"))


def tiers(*columns: Column) -> Column:
    """The value of the highest tier that has one; empty strings are none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def safe_category(raw: Column, categories: Sequence[str]) -> Column:
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    kinds = F.create_map(*[F.lit(x) for kv in KIND_CATEGORIES.items() for x in kv])
    return F.when(s.isin(*categories), s).otherwise(F.coalesce(F.element_at(kinds, F.upper(raw)), F.lit("other")))


def five_scale(score: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(score * 5).cast("int")))


def agent_scores(memos: DataFrame, areas_wanted: int = 5, evidence_wanted: int = 20, gaps_wanted: int = 5, facts_wanted: int = 10) -> DataFrame:
    """Scores of the planner, evidence, review and report of each memo (areas, covered, items, good_items, gaps, facts, citation)."""
    up = lambda c, n: F.least(F.lit(1.0), F.col(c) / n)
    planner = F.when(F.col("areas") > 0, F.round(F.col("covered") / F.col("areas") * 0.7 + up("areas", areas_wanted) * 0.3, 3)).otherwise(0.5)
    share = F.when(F.col("items") > 0, F.col("good_items") / F.col("items")).otherwise(0.0)
    return memos.withColumns({
        "planner_score": planner,
        "evidence_score": F.round(up("items", evidence_wanted) * 0.5 + share * 0.5, 3),
        "review_score": F.round(up("gaps", gaps_wanted), 3),
        "report_score": F.round(F.col("citation") * 0.5 + up("facts", facts_wanted) * 0.5, 3),
    })


def memo_warnings(memos: DataFrame, key: str) -> DataFrame:
    """(key, code) of the quality rules that a memo breaks.

    memos: question, mock, documents, empty_documents, zero_chunk_documents, zero_evidence_chunks, summary, items, good_items,
    sources, empty_snippets, chunks, high_conflicts, areas, gaps, the arrays known (evidence ids) and facts, and an array
    for each of the sections in L.TOPIC_SECTIONS.  A topic of the question requires its section, with citations."""
    cited = lambda c: F.flatten(F.transform(c, T.citations))
    every = F.array_distinct(F.concat(*[cited(F.col(c)) for c in ("facts", *L.TOPIC_SECTIONS.values())]))
    asked = R.bound(F.lower("question"), lambda q: R.labels(q, L.QUESTION_TOPICS))
    rules = [
        ("mock_llm", F.col("mock")),
        ("no_sources", F.col("documents") == 0),
        ("zero_documents_loaded", F.col("documents") == 0),
        ("few_documents_loaded", F.col("documents") < 3),
        ("empty_document_text", F.col("empty_documents") > 0),
        ("missing_executive_summary", F.trim("summary") == ""),
        ("missing_confirmed_facts", F.size("facts") == 0),
        ("no_evidence", F.col("items") == 0),
        ("low_evidence_count", F.col("items") < 10),
        ("low_high_quality_evidence_count", F.col("good_items") < 10),
        ("zero_chunks_for_document", F.col("zero_chunk_documents") > 0),
        ("zero_evidence_for_chunk", F.col("zero_evidence_chunks") > 0),
        ("insufficient_source_evidence", F.col("sources") < 3),
        ("empty_evidence_snippet", F.col("empty_snippets") > 0),
        ("missing_confirmed_fact_citations", (F.size("facts") > 0) & (F.size(cited(F.col("facts"))) == 0)),
        ("unknown_evidence_citation", F.size(F.array_except(every, "known")) > 0),
        ("retrieval_metrics", F.col("chunks") > 0),
        ("coverage_matrix_metrics", F.col("areas") > 0),
        ("research_gap_metrics", F.col("gaps") > 0),
        ("high_severity_contradiction", F.col("high_conflicts") > 0),
    ]
    for topic, section in L.TOPIC_SECTIONS.items():
        on = F.array_contains("__asked", topic)
        rules += [(f"missing_{section}", on & (F.size(section) == 0)), (f"missing_{section.removesuffix('_implications')}_citations", on & (F.size(section) > 0) & (F.size(cited(F.col(section))) == 0))]
    return memos.withColumn("__asked", asked).select(key, F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))).alias("code"))


#: Programs that write their name where an author belongs.
SKIP_AUTHORS = ("creative services", "microsoft", "adobe", "acrobat", "libreoffice", "openoffice", "latex", "indesign", "quarkxpress", "mozilla", "pdfium", "chrome", "safari", "webkit")


def skipped_author(value: Column, skip: Sequence[str] = SKIP_AUTHORS) -> Column:
    """Whether an author's name is a placeholder."""
    return R.any_term(value, skip)


def cleaned(value: Column) -> Column:
    """A value without surplus blanks; null if nothing is left."""
    return F.nullif(T.compact(F.coalesce(value, F.lit(""))), F.lit(""))


def needs_more(*fields: Column) -> Column:
    """Whether no tier filled any of the provenance fields."""
    out = F.lit(True)
    for c in fields:
        out = out & c.isNull()
    return out


def markdown_sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, section, item, bullet) of every line of a markdown text that is no heading, with the heading above it."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    head = F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ ", ""))
    s = lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")))
    return s.filter(~F.col("line").rlike("^#+ ")).select(key, "pos", "section", F.regexp_replace("line", "^[-*] ", "").alias("item"), F.col("line").rlike("^[-*] ").alias("bullet"))


def citation_audit(answers: DataFrame, key: str, least: float = 1.0) -> DataFrame:
    """Answers (answer, reported) whose citation score is under a threshold, with what was found."""
    found = F.size(T.citations(F.col("answer")))
    a = answers.withColumns({"found": found, "citation_score": F.when(F.col("reported") > 0, 1.0).otherwise(0.0)})
    return a.filter(F.col("citation_score") < least).select(key, "reported", "found", (F.col("reported") != F.col("found")).alias("discrepancy"), F.length("answer").alias("length"))


def zero_yield(chunks: DataFrame, evidence: DataFrame, doc: str) -> DataFrame:
    """Documents without evidence, with advice (chunks: doc, chars)."""
    c = chunks.groupBy(doc).agg(F.count("*").alias("chunks"), F.sum("chars").alias("characters"))
    advice = F.when(F.col("chunks") >= 3, "inspect_parser_output").when(F.col("characters") > 50_000, "recover_sections").otherwise("lower_priority")
    return c.join(evidence.select(doc).distinct(), doc, "left_anti").withColumn("advice", advice)


def normalised_items(rows: DataFrame, key: str, raw: str, required: Sequence[str], string_key: str) -> tuple[DataFrame, DataFrame]:
    """(items, counts) of JSON lists: bare strings become objects, others and those without a required field drop out."""
    items = rows.select(key, F.posexplode(F.from_json(raw, "array<string>")).alias("pos", "item"))
    is_object = F.trim("item").startswith("{")
    made = F.when(is_object, F.from_json("item", "map<string,string>")).when(F.try_parse_json("item").isNull(), F.create_map(F.lit(string_key), F.col("item")))
    ok = F.lit(True)
    for f in required:
        ok = ok & F.element_at("m", f).isNotNull()
    made_rows = items.withColumn("m", made).withColumn("ok", F.col("m").isNotNull() & F.coalesce(ok, F.lit(False)))
    counts = made_rows.groupBy(key).agg(F.count("*").alias("received"), F.count_if("ok").alias("valid"))
    counts = rows.select(key).join(counts, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("received", "valid")])
    return made_rows.filter("ok").select(key, "pos", "m"), counts.withColumn("dropped", F.col("received") - F.col("valid"))


def capped(rows: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most so many records of each group, in order of importance."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= most)


def one_recommended(options: DataFrame, group: str, order: str) -> DataFrame:
    """Exactly one recommended option of each group: the first that is, else the first."""
    w = Window.partitionBy(group).orderBy(F.desc("recommended"), F.asc(order))
    return options.withColumn("recommended", F.row_number().over(w) == 1)


def bucketed(rows: DataFrame, group: str, order: str, buckets: int = 3, most: int = 9) -> DataFrame:
    """The first records of each group dealt to buckets in runs of equal length."""
    w = Window.partitionBy(group).orderBy(order)
    r = rows.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.least(F.count("*").over(Window.partitionBy(group)), F.lit(most))}).filter(F.col("__i") < F.col("__n"))
    b = F.floor(F.col("__i") / F.greatest(F.lit(1), F.floor(F.col("__n") / buckets)))
    return r.withColumn("scenario", b).filter(F.col("scenario") < buckets).drop("__i", "__n")


def by_ordinal(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """Records of two kinds of a group, the i-th with the i-th."""
    n = lambda d, o: d.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(o)))
    return n(left, left_order).join(n(right, right_order), [group, "ordinal"], "left")


def templated(evidence: DataFrame, templates: DataFrame, key: str, order: str, text: str, most: int = 3) -> DataFrame:
    """Findings (template, support): templates (template, terms) that evidence touches, with its first ids."""
    e = evidence.select(F.col(key).alias("__k"), F.col(order).alias("__o"), F.col(text).alias("__t"))
    hit = terms.labelled(e, "__t", templates.select("template", F.explode("terms").alias("term")), label="template", out="__l").withColumn("template", F.explode("__l"))
    return capped(hit.select("template", "__k", "__o"), "template", [F.asc("__o"), F.asc("__k")], most).groupBy("template").agg(F.array_sort(F.collect_list("__k")).alias("support"))


def contributing(records: DataFrame, key: str, ids: str, profiles: DataFrame) -> DataFrame:
    """(key, profiles): profiles of the evidence (id, profile) that each record names."""
    e = records.select(key, F.explode(ids).alias("id")).distinct().join(profiles, "id")
    return records.select(key).join(e.groupBy(key).agg(F.array_sort(F.collect_set("profile")).alias("profiles")), key, "left").withColumn("profiles", F.coalesce("profiles", F.array().cast("array<string>")))


def case_scores(cases: DataFrame) -> DataFrame:
    """Contradiction cases (expected, conflicts, reasons array, should_fire, should_not_fire, expected_reason): result and whether suppression was right."""
    actual = F.when(F.col("conflicts") > 0, "contradiction").otherwise("no_contradiction")
    fired = F.size("reasons") > 0
    wrong = (F.col("should_fire") & ~fired) | (F.col("should_not_fire") & fired) | ((F.col("expected_reason") != "") & fired & ~F.array_contains("reasons", F.col("expected_reason")))
    return cases.withColumns({"actual": actual, "correct": actual == F.col("expected"), "suppression_correct": ~wrong})
