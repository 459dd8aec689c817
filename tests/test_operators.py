"""Operators on small inputs of their own."""

from __future__ import annotations

import collections
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunking, classify, contradict, engage, evaluate, evidence, link, pools, retrieve, select, terms, trace
from corvane.sources import binaries, cache, objects, readers, records, sinks
from corvane.sources.store import Store
from corvane.streaming import ingest


def _cut_points(text, target, most):
    """Ends of chunks by the rule, one after the other."""
    ends = [m.end() for m in re.finditer(r"[.!?](?=[ \t\n\x0b\f\r])", text)]
    out, pos = [], 0
    while pos + most < len(text):
        first = [e for e in ends if pos + target <= e < pos + most]
        last = [e for e in ends if pos < e < pos + most]
        pos = first[0] if first else last[-1] if last else pos + most
        out.append(pos)
    return [*out, len(text)]


@pytest.mark.parametrize("target, most", [(30, 40), (1, 5), (39, 40), (7, 90)])
def test_chunks_are_cut_by_the_rule(spark, target, most):
    rng = random.Random(target)
    texts = ["".join(rng.choices("ab😀é .!?\n", weights=(rng.choice((1, 9)), 9, 1, 1, rng.choice((1, 6)), rng.choice((0, 1, 3)), 0.3, 0.3, 0.3), k=rng.randint(1, 420))) for _ in range(400)]
    texts += ["x" * n for n in (most - 1, most, most + 1, 2 * most, 3 * most + 1)] + ["x" * (most - 1) + ". y", "a. " + "x" * (2 * most) + ". " + "b. " * most]
    got = chunking.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), target, most).collect()
    by = collections.defaultdict(list)
    for r in sorted(got):
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        assert [r.end_offset for r in by[i]] == _cut_points(t, target, most), t
        assert [r.chunk_text for r in by[i]] == [t[r.start_offset : r.end_offset] for r in by[i]] and "".join(r.chunk_text for r in by[i]) == t
        assert [r.chunk_number for r in by[i]] == list(range(1, len(by[i]) + 1))


def test_text_without_stops_is_cut_hard(spark):
    d = spark.createDataFrame([(1, "x" * 20_000), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    c = {(r.doc_id, r.chunk_number): (r.start_offset, r.end_offset) for r in chunking.chunks(d).collect()}
    assert c == {(1, 1): (0, 8000), (1, 2): (8000, 16_000), (1, 3): (16_000, 20_000), (4, 1): (0, 5)}


def _claims(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "id long, claim string, entity string, scope string")


def _numeric(spark, rows, units=("kw",)):
    return contradict.classes(contradict.numeric_signatures(_claims(spark, rows), units=units))


def _outcome(spark, a, b, ea="X", eb="X", sa="unknown", sb="unknown"):
    found = _numeric(spark, [(a, ea, sa), (b, eb, sb)])
    m = contradict.suppression_metrics(contradict.numeric_pairs(found), contradict.mismatches(found, "unit")).collect()
    assert all(r.n == 1 for r in m)
    return [r.outcome for r in m] + [r.severity for r in contradict.numeric_pairs(found).collect() if r.severity]


def test_numeric_gates(spark):
    assert _outcome(spark, "X draws 120 kW.", "X draws 180 kW.") == ["conflict", "medium"]
    assert _outcome(spark, "X draws 60 kW.", "X draws 180 kW.") == ["conflict", "high"]
    assert _outcome(spark, "X draws 120 kW.", "X draws 130 kW.") == []
    assert _outcome(spark, "X draws 1 kW.", "X draws 180 kW.", sa="component", sb="rack") == ["scope_mismatch"]
    assert _outcome(spark, "X draws 1 kW.", "Y draws 180 kW.", eb="Y") == ["entity_mismatch"]
    assert _outcome(spark, "X draws 100 kW today.", "X is expected to draw 900 kW.") == ["temporal_progression"]
    assert _outcome(spark, "X draws 30-100 kW.", "X draws 60 kW.") == ["range_average_compatible"]
    assert _outcome(spark, "X is cooled by air.", "X draws 60 kW.") == []
    assert _outcome(spark, "An H100 draws 10 kW.", "A B200 draws 60 kW.") == ["generation_progression"]
    # a level and a rate measure different things: no record at all
    assert _outcome(spark, "X adds 10 kW per year.", "X draws 60 kW.") == []


def test_unknown_and_contained_names_are_compatible(spark):
    rows = [("It draws 120 kW.", "NVL72", ""), ("It draws 300 kW.", "", ""), ("It draws 900 kW.", "GB200 NVL72", ""), ("It draws 5 kW.", "NVL36", "")]
    found = _numeric(spark, rows)
    pairs = {(r.class_a, r.class_b) for r in contradict.numeric_pairs(found).filter("outcome = 'conflict'").collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (2, 4)}
    assert contradict.mismatches(found, "unit").first().pairs == 2


def test_classes_stand_for_all_their_claims(spark):
    rows = [("X draws 100 kW.", "X", ""), ("X draws 200 kW.", "X", "")] * 30 + [("X draws 9 kW.", "Y", "")] * 4
    s = contradict.numeric_signatures(_claims(spark, rows), units=("kw",))
    found = contradict.classes(s)
    pairs = contradict.numeric_pairs(found)
    assert [(r.class_a, r.class_b, r.pairs) for r in pairs.collect()] == [(1, 2, 900)]
    assert contradict.mismatches(found, "unit").first().pairs == 60 * 4
    whole = contradict.expanded(pairs, contradict.members(s)).collect()
    assert len({(r.a, r.b) for r in whole}) == 900 and all(r.a < r.b and (r.b - r.a) % 2 for r in whole)


def _classes(spark, rng, n, names, values, units=("kw", "mw")):
    """Random classes as numeric_signatures and classes make them."""
    rows = []
    for i in range(n):
        m = []
        for o, u in enumerate(units):
            if rng.random() < 0.6 or not m and o == len(units) - 1:
                lo = rng.choice(values) if rng.random() < 0.3 else None
                v = rng.choice(values)
                m.append((o, u, v, rng.choice([f"{u}_level", f"{u}_rate", "rack_power_kw"]), lo, lo and lo * rng.choice([1.0, 1.3, 4.0]), rng.choice(["primary"] * 5 + ["threshold", "historical_comparison"])))
        rows.append((i, rng.randint(1, 4), rng.choice(names), rng.choice(["unknown", "rack", "component", "site"]), rng.choice(["general", "general", "example_deployment"]), rng.choice([0, 0, 1, 2]), rng.choice(["current", "target", "unknown"]), rng.choice([0, 1, 2, 3]), m))
    return spark.createDataFrame(rows, "class long, n long, e string, s string, ctx string, prod int, kind string, topics int, m array<struct<o: int, unit: string, value: double, metric: string, lo: double, hi: double, meaning: string>>")


@pytest.mark.parametrize("seed", range(6))
def test_counts_by_value_order_equal_pairs(spark, seed):
    rng = random.Random(seed)
    values = [0.0, 0.8, 1.0, 1.2, 1.5, 4.4, 5.5, 8.0, 10.0, 12.5, 100.0] if seed % 2 else [round(rng.random() * 10 ** rng.randint(0, 3), rng.randint(0, 3)) for _ in range(60)]
    found = _classes(spark, rng, 150, [["", "nvl72", "gb200 nvl72", "x"], [""], ["a", "b", "ab"]][seed % 3], values)
    pairs = contradict.numeric_pairs(found, ("topics",), (("even", ()), ("odd", ())))
    want = {(r.outcome, r.topic): r.n for r in pairs.groupBy("outcome", "topic").agg(F.sum("pairs").alias("n")).collect()}
    got = {(r.outcome, r.topic): r.n for r in contradict.numeric_counts(found, (("even", ()), ("odd", ()))).collect()}
    assert got == want and len(want) > 3
    plain = collections.Counter()
    for (outcome, _), n in want.items():
        plain[outcome] += n
    assert {r.outcome: r.n for r in contradict.numeric_counts(found).collect()} == plain


def test_counts_of_many_values_and_one_unknown_name(spark):
    """20,000 distinct values without a name, where pairs of classes would be two hundred million."""
    one = "cast(id as long) class, cast(1 + id % 3 as long) n, '' e, 'unknown' s, 'general' ctx, 0 prod, 'unknown' kind, array(named_struct('o', 0, 'unit', 'kw', 'value', pow(1.0007, id), 'metric', 'kw_level', 'lo', cast(null as double), 'hi', cast(null as double), 'meaning', 'primary')) m"
    found = spark.range(20_000).selectExpr(*one.split(", ", 7)[:7], one.split(", ", 7)[7])
    values, n = np.array([r.v for r in found.selectExpr("m[0].value v").collect()]), np.array([1 + i % 3 for i in range(20_000)])
    want = sum(int(n[i] * n[i + 1 :][(values[i + 1 :] - values[i]) / values[i + 1 :] > 0.2].sum()) for i in range(len(values)))
    assert [(r.outcome, r.n) for r in contradict.numeric_counts(found).collect()] == [("conflict", want)]


def test_enrichment_leaves_set_rows_alone(spark):
    rows = [("The NVL72 rack draws 1 kW", "", ""), ("The NVL72 rack draws 1 kW", "Mine", ""), ("The NVL72 rack draws 1 kW", "", "site")]
    got = [(r.entity, r.scope) for r in contradict.enriched(_claims(spark, rows)).orderBy("id").collect()]
    assert got == [("NVL72", "rack"), ("Mine", ""), ("", "site")]


def test_durations(spark):
    rows = [("Alpha takes 24-36 months.", "", "unknown"), ("Alpha takes 8-12 years.", "", "unknown"), ("Alpha takes 30-40 months.", "", "unknown"), ("Beta lasts 90 years.", "", "unknown")]
    found = contradict.classes(contradict.duration_signatures(_claims(spark, rows)))
    got = {(r.class_a, r.class_b): r.severity for r in contradict.duration_pairs(found).collect()}
    assert got == {(1, 2): "high", (2, 3): "high"}


def test_durations_of_a_hot_token_equal_brute_force(spark):
    """One token in every claim, some rare ones, and claims without any other."""
    rng = random.Random(8)
    rows = []
    for i in range(700):
        lo = rng.choice([0.0, 1.0, 6.0, 11.5, 12.0, 24.0, 36.0, 60.0, 120.0, 960.0])
        w = sorted({"plant", *rng.sample(["alpha", "beta", "gamma", *(f"r{j}" for j in range(200))], rng.randint(0, 3))} - ({"plant"} if i % 50 == 0 else set()))
        rows.append((i, rng.randint(1, 3), lo, lo * rng.choice([1.0, 1.0, 1.5, 3.0]), rng.choice(["duration_construction", "duration_generic"]), w))
    found = spark.createDataFrame(rows, "class long, n long, lo double, hi double, metric string, w array<string>")
    want = {(a[0], b[0]): a[1] * b[1] for i, a in enumerate(rows) for b in rows[i + 1 :] if a[4] == b[4] and (a[3] < b[2] or b[3] < a[2]) and set(a[5]) & set(b[5])}
    pairs = contradict.duration_pairs(found)
    got = pairs.collect()
    assert len(got) == len(want) > 50_000 and {(r.class_a, r.class_b): r.pairs for r in got} == want
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("way", ["automaton", "index"])
def test_many_terms_equal_brute_force(spark, monkeypatch, way):
    if way == "index":
        monkeypatch.setattr(terms, "AUTOMATON_TERMS", 0)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcé😀 ", k=n))
    vocabulary = [(word(rng.randint(1, 6)), f"l{i % 40}") for i in range(300)] + [("", "none"), (None, "none"), ("A", "upper"), ("ab", None), ("abc", "x"), ("abc", "y")]
    texts = [(i, word(rng.choice([0, 1, 2, 3, 30, 200])).upper() if i % 3 else word(40)) for i in range(120)] + [(900, None), (901, ""), (902, "AbC"), (902, "AbC")]
    rows = spark.createDataFrame(texts, "k long, t string").withColumn("label", F.lit("clash"))
    got = terms.labelled(rows, "t", spark.createDataFrame(vocabulary, "term string, label string")).collect()
    want = lambda t: sorted({lab for w, lab in vocabulary if w and lab and t and w.lower() in t.lower()})
    assert len(got) == len(texts) and all(r.labels == want(r.t) for r in got) and sum(len(r.labels) for r in got) > 500
    none = terms.labelled(rows, "t", spark.createDataFrame([], "term string, label string")).collect()
    assert len(none) == len(texts) and not any(r.labels for r in none)


def test_a_vocabulary_of_20000_terms_in_one_pass(spark):
    """Terms are five-digit numbers: a text of digits holds those of its windows."""
    vocabulary = spark.range(10_000, 30_000).selectExpr("cast(id as string) term", "cast(id as string) label")
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("0123456789", k=400))) for i in range(200)]
    rows = terms.labelled(spark.createDataFrame(texts, "k long, t string"), "t", vocabulary)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert all(r.labels == sorted({r.t[i : i + 5] for i in range(396) if 10_000 <= int(r.t[i : i + 5]) < 30_000}) for r in rows.collect())


QUESTION_YAML = """question_id: ONE
domain: chips
question: >
  How much power
  does it draw?
must_include:
  - 120 kW
  - "rack # not this"
must_not_include: 30 kW
notes: x
"""
CASE_YAML = """claim_a: A draws 1 kW.
claim_b: A draws 2 kW.
expected_result: contradiction
suppression_should_fire: true
expected_suppression_reason: null
"""
PROFILE_YAML = """name: smr
description: reactors
topic_keywords:
  reactor design:
    - Reactor
    - core
  licensing: [NRC]
contradiction_topics:
  cost: {keywords: [Capex, opex]}
  time: [months]
domain_terms: [nuclear]
research_gap_checks:
  grid:
    - Interconnection
    - {topic: storage, keywords: [battery], priority: high}
"""


def test_records_from_files(spark, tmp_path):
    """YAML, JSON and JSON lines in folders; empty, broken, misshapen and foreign files."""
    for at, text in {
        "gold/chips/one.yaml": QUESTION_YAML, "gold/chips/two.json": '{"question": " Second? ", "must_include": null}', "gold/chips/empty.yaml": " \n", "gold/chips/bad.yaml": "a: [1", "gold/chips/list.json": "[1, 2]",
        "gold/lines.txt": '{"question_id": "L1"}\n\n{oops\n{"question_id": "L2", "domain": "d"}', "gold/many.yaml": "question_id: M1\n---\nquestion_id: M2\n", "gold/other.md": "question_id: no", "cases/c1.yaml": CASE_YAML, "profiles/smr.yaml": PROFILE_YAML, "profiles/zwei.yml": "description: nameless\n",
    }.items():
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    (tmp_path / "gold/latin.json").write_bytes(b'{"a": "\xe9"}')
    found = records.records(spark, str(tmp_path / "gold"))
    q = {r.question_id: r for r in records.gold_questions(found).collect()}
    assert set(q) == {"ONE", "two", "L1", "L2", "M1", "M2"}
    assert (q["ONE"].domain, q["ONE"].difficulty, q["ONE"].question, q["ONE"].must_include, q["ONE"].must_not_include, q["ONE"].expected_topics) == ("chips", "medium", "How much power does it draw?", ["120 kW", "rack"], ["30 kW"], [])
    assert (q["two"].domain, q["two"].question, q["two"].must_include, q["L2"].domain, q["M1"].domain) == ("chips", "Second?", [], "d", "gold")
    errors = {(r.path.rsplit("/", 1)[-1], r.ord): r.error for r in records.errors(found).collect()}
    assert set(errors) == {("empty.yaml", 0), ("bad.yaml", 0), ("list.json", 0), ("lines.txt", 1), ("latin.json", 0)} and "not list" in errors["list.json", 0]
    case = records.contradiction_cases(records.records(spark, str(tmp_path / "cases"))).first()
    assert (case.contradiction_id, case.expected_result, case.severity, case.suppression_should_fire, case.known_limitation, case.expected_suppression_reason) == ("c1", "contradiction", None, True, False, None)
    p = records.records(spark, str(tmp_path / "profiles"))
    assert {(r.profile, r.description) for r in records.profiles(p).collect()} == {("smr", "reactors"), ("zwei", "nameless")}
    assert sorted(tuple(r) for r in records.vocabulary(p).collect()) == [
        ("smr", "contradiction_topics", "cost", 0, "capex", 0), ("smr", "contradiction_topics", "cost", 0, "opex", 1), ("smr", "contradiction_topics", "time", 1, "months", 0), ("smr", "domain_terms", "", 0, "nuclear", 0),
        ("smr", "topic_keywords", "licensing", 1, "nrc", 0), ("smr", "topic_keywords", "reactor design", 0, "core", 1), ("smr", "topic_keywords", "reactor design", 0, "reactor", 0),
    ]
    assert [(r.area, r.topic, r.priority, r.keywords) for r in records.gap_checks(p).orderBy("topic").collect()] == [("grid", "Interconnection", "medium", ["interconnection"]), ("grid", "storage", "high", ["battery"])]
    assert records.chosen(p, default="smr").first().profile == records.chosen(p, "smr").first().profile == "smr"
    with pytest.raises(LookupError, match="zwei"):
        records.chosen(p, "none")


def test_embedded_metadata(spark, tmp_path):
    """PDF with a plain and with a compressed information dictionary, updated, encrypted and broken; DOCX with and without one."""
    pdf = lambda info, rest=b"": b"%PDF-1.5\n1 0 obj << " + info + b" >> endobj\n2 0 obj << /Type /Page >> endobj\n" + rest + b"\ntrailer << /Info 1 0 R >>"
    packed = zlib.compress(b"1 0 << /Title (Packed) /Author (Ann) >>")
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("docProps/core.xml", "<cp:coreProperties><dc:title>Q &amp; A</dc:title><dc:creator>Microsoft Office User</dc:creator><dcterms:created xsi:type='x'>2021-04-05T00:00:00Z</dcterms:created></cp:coreProperties>")
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("word/document.xml", "<w:t>x</w:t>")
    files = {
        "a.pdf": pdf(rb"/Title (A \(b\) \101\\) /Subject (S) /Author (Ann) /CreationDate (D:20200102030405)"),
        "update.pdf": pdf(b"/Title (Old)") + b"\n1 0 obj << /Title (New) >> endobj\ntrailer << /Info 1 0 R >>",
        "packed.pdf": b"%PDF-1.5\n5 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj",
        "wide.pdf": pdf(b"/Title <FEFF00DC0062006500720020007A>"), "draft.pdf": pdf(b"/Title (GEA34989B plan) /Author (LaTeX with hyperref)"), "locked.pdf": pdf(b"/Title (x)", b"/Encrypt 5 0 R"), "not.pdf": b"hello",
        "q.docx": docx.getvalue(), "bare.docx": bare.getvalue(), "broken.docx": b"PK",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in binaries.embedded(binaries.files_of(spark, str(tmp_path))).collect()}
    assert len(got) == len(files)
    assert (got["a.pdf"].title, got["a.pdf"].subtitle, got["a.pdf"].author, str(got["a.pdf"].published), got["a.pdf"].pages) == ("A (b) A\\", "S", "Ann", "2020-01-02", 1)
    assert got["update.pdf"].title == "New" and got["packed.pdf"].title == "Packed" and got["wide.pdf"].title == "\u00dcber z"
    assert got["draft.pdf"].title is None and got["draft.pdf"].author is None and got["draft.pdf"].error is None
    assert all(got[n].error and got[n].title is None for n in ("locked.pdf", "not.pdf", "bare.docx", "broken.docx"))
    assert (got["q.docx"].title, got["q.docx"].author, str(got["q.docx"].published), got["q.docx"].pages) == ("Q & A", None, "2021-04-05", None)
    texts = spark.createDataFrame([(r.path, "Revision b. \u00a9 2019 Example Power Corp. All rights reserved. March 2018") for r in got.values()], "path string, text string")
    p = {r.path.rsplit("/", 1)[-1]: r for r in binaries.provenance(binaries.embedded(binaries.files_of(spark, str(tmp_path))), texts).collect()}
    assert str(p["a.pdf"].published) == "2020-01-02" and str(p["wide.pdf"].published) == "2018-03-01" and p["a.pdf"].organisation == "Example Power Corp"


def test_vectors_from_files(spark, tmp_path):
    for name, v in (("a", np.arange(3, dtype="<f8")), ("b", np.array([[1, 2], [3, 4]], dtype=">i4")), ("o", np.array([{}], dtype=object))):
        np.save(tmp_path / f"{name}.npy", v)
    (tmp_path / "j.json").write_text("[0.5, 2]")
    (tmp_path / "cut.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:90])
    (tmp_path / "bad.json").write_text('{"a": 1}')
    got = {r.evidence_id: r.vector for r in binaries.vectors(binaries.files_of(spark, str(tmp_path), "*.{npy,json}")).collect()}
    assert got == {"a": [0.0, 1.0, 2.0], "b": [1.0, 2.0, 3.0, 4.0], "o": None, "j": [0.5, 2.0], "cut": None, "bad": None}


def test_blocked_joins_are_no_cross_joins(spark):
    rows = [("a 1 kW", "", "rack"), ("air cooled", "b", "rack")]
    plans = [contradict.numeric_pairs(_numeric(spark, rows)), contradict.mismatches(_numeric(spark, rows), "unit"), contradict.categorical_pairs(contradict.classes(contradict.categorical_signatures(_claims(spark, rows))))]
    for p in plans:
        plan = p._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_retrieval_modes(spark):
    s = spark.createDataFrame([(1, "power risk", [1.0, 0.0], ["a"]), (2, "power", [0.0, 1.0], []), (3, "nothing", None, []), (4, "power power", [1.0, 0.0], [])], "doc_id long, statement string, embedding array<float>, profiles array<string>")
    m = spark.createDataFrame([(1, True, 3, 0.5, 3.0), (2, True, 5, 0.5, 4.0), (3, True, 3, 0.5, 3.0), (4, False, 3, 0.5, 3.0)], "doc_id long, enabled boolean, priority int, value double, overall double")
    c = retrieve.candidates(s, m, "doc_id")
    lexical = retrieve.top(retrieve.scored(c, "lexical", ["power"]), 5, "doc_id").collect()
    assert [r.rank for r in lexical] == [1, 2] and [r.doc_id for r in lexical] == [2, 1]
    assert retrieve.scored(c, "lexical", []).count() == 0
    assert [r.doc_id for r in retrieve.scored(c, "semantic", [], [1.0, 0.0]).collect()] == [1]
    assert {r.doc_id for r in retrieve.scored(c, "hybrid", ["power"], [1.0, 0.0]).collect()} == {1, 2}
    assert {r.doc_id for r in retrieve.candidates(s, m, "doc_id", enabled_only=False).collect()} == {1, 2, 3, 4}
    assert [r.doc_id for r in retrieve.candidates(s, m, "doc_id", profile="a").collect()] == [1]
    order = spark.createDataFrame([(1, 0), (99, 1), (1, 2)], "doc_id long, position int")
    assert [r.doc_id for r in retrieve.reranked(retrieve.top(retrieve.scored(c, "lexical", ["power"]), 5, "doc_id"), order, "doc_id", 5).collect()] == [1, 2]


def test_diversity_seeds_then_caps(spark):
    """Every group's best first, then up to the cap, then the rest, as a plain loop chooses them."""
    rows = [(i, "abcd"[(i * 7) % 4], float((i * 13) % 10)) for i in range(40)]
    ranked = sorted(rows, key=lambda r: (-r[2], r[0]))
    for limit, cap in ((3, 1), (7, 2), (25, 3), (60, 2)):
        seen, passes = {}, []
        for r in ranked:
            seen[r[1]] = seen.get(r[1], 0) + 1
            passes.append((1 if seen[r[1]] == 1 else 2 if seen[r[1]] <= cap else 3, -r[2], r[0]))
        d = spark.createDataFrame(rows, "id long, g string, s double")
        got = [(x["pass"], -x.s, x.id) for x in select.diverse(d, "g", [F.desc("s"), F.asc("id")], limit, cap).collect()]
        assert got == sorted(passes)[:limit]


def test_diverse_and_budget(spark):
    r = spark.createDataFrame([(1, "a", 9.0, 5), (2, "a", 8.0, 5), (3, "a", 7.0, 2), (4, "b", 1.0, 1)], "id long, g string, s double, n long")
    order = [F.desc("s"), F.asc("id")]
    assert [x.id for x in select.diverse(r, "g", order, 3, 1).collect()] == [1, 4, 2]
    for ranges in (1, 2, None):
        fit = select.within_budget(r, [-F.col("s"), F.col("id")], "n", 8, ranges)
        assert sorted(x.id for x in fit.collect()) == [1, 3, 4] and fit.columns == r.columns


def _greedy(rows, budget):
    taken, left = set(), budget
    for i, n in sorted(rows):
        if n is not None and n <= left:
            taken.add(i)
            left -= n
    return taken


@pytest.mark.parametrize("budget", [0, 1, 17, 900, 5_000, 10**9])
def test_budget_by_ranges_equals_the_fold(spark, budget):
    rng = random.Random(budget)
    for sizes in ([rng.randint(0, 60) for _ in range(900)], [rng.choice([1, 700, None]) for _ in range(900)], [2**k for k in range(20, 0, -1)]):
        rows = list(enumerate(sizes))
        d = spark.createDataFrame(rows, "id long, n long").repartition(5)
        for ranges in (1, 13):
            assert {r.id for r in select.within_budget(d, ["id"], "n", budget, ranges).collect()} == _greedy(rows, budget)


def test_a_budget_of_a_billion_reads_one_range_by_row(spark):
    """Two million rows of 1 to 1000: all but one range are taken or passed over by their sums."""
    d = spark.range(2_000_000).select("id", (F.col("id") * 7919 % 1000 + 1).alias("n"))
    got = select.within_budget(d, ["id"], "n", 900_000_000, 40)
    n = np.arange(2_000_000, dtype=np.int64) * 7919 % 1000 + 1
    left, want = 900_000_000, 0
    for x in n.tolist():
        if x <= left:
            left -= x
            want += 1
    total = got.agg(F.sum("n").alias("s"), F.count("*").alias("c")).first()
    assert (total.s, total.c) == (900_000_000 - left, want)


def test_pools_are_compared_without_gathering_them(spark):
    a = [("x", i) for i in range(10)] + [("x", 1), ("x", None), ("y", 1), ("w", 5)]
    b = [("x", i) for i in range(5, 12)] + [("z", 3), ("w", 5)]
    d = lambda rows: spark.createDataFrame(rows, "k string, m long").withColumn("side", F.lit(0))
    keys = spark.createDataFrame([(k,) for k in ("w", "x", "y", "z", "none")], "k string")
    got = pools.comparison(d(a), d(b), "k", "m", keys)
    assert {r.k: (r.shared, r.only_a, r.only_b, r.jaccard) for r in got.collect()} == {"x": (5, 5, 2, 0.416667), "y": (0, 1, 0, 0.0), "z": (0, 0, 1, 0.0), "w": (1, 0, 0, 1.0), "none": (0, 0, 0, 1.0)}
    assert "collect_set" not in got._jdf.queryExecution().toString()
    big = lambda lo: spark.range(lo, lo + 60_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("m"))
    both = spark.createDataFrame([("p", "q"), ("p", "p"), ("p", "e")], "a string, b string")
    rows = big(0).select(F.lit("p").alias("pool"), "m").unionByName(big(20_000).select(F.lit("q").alias("pool"), "m")).unionByName(spark.createDataFrame([("e", None)], "pool string, m long"))
    est = {(r.a, r.b): r.jaccard for r in pools.estimates(pools.sketches(rows, "pool", "m"), both, "pool").collect()}
    assert abs(est["p", "q"] - 0.5) < 0.03 and est["p", "p"] == 1.0 and ("p", "e") not in est


def test_traces_equal_counted_values(spark, tmp_path):
    """Three stages, the last of them twice; the trace has what a second pass would count."""
    run = trace.Run(spark, "r1")
    a = run.stage("read", spark.range(100).withColumn("x", F.col("id") % 7), str(tmp_path / "a"), total=F.sum("x"))
    b = run.stage("kept", a.filter("x > 2"), str(tmp_path / "b"), total=F.sum("x"), least=F.min("x"))
    run.stage("none", b.filter("x > 9"), str(tmp_path / "c"), total=F.sum("x"))
    run.stage("kept", a.filter("x > 3"), str(tmp_path / "b"), total=F.sum("x"))
    for r in (run, trace.Run(spark, "r2")):
        r.save(str(tmp_path / "trace"))
    got = {(r.stage, r.metric): r.value for r in trace.traces(spark, str(tmp_path / "trace")).collect()}
    want = lambda d: d.agg(F.count("*"), F.sum("x")).first()
    assert (got["read", "rows"], got["read", "total"]) == tuple(want(a)) and (got["kept", "rows"], got["kept", "total"]) == tuple(want(a.filter("x > 3")))
    assert got["none", "rows"] == 0 and ("none", "total") not in got
    assert all(r.seconds > 0 for r in trace.traces(spark, str(tmp_path / "trace")).collect())
    t = spark.createDataFrame([("a", "scanned", 8.0), ("a", "skipped", 6.0), ("b", "scanned", 0.0)], "run_id string, metric string, value double")
    assert {r.run_id: r.ratio for r in trace.hit_ratio(t).collect()} == {"a": 0.75, "b": 0.0}


def test_cache_puts_gets_and_forgets(spark, tmp_path):
    c = cache.Cache(spark, str(tmp_path / "cache"))
    rows = lambda *r: spark.createDataFrame(r, "key string, payload string")
    wanted = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "b", "c", "d", "e", None, "a"])], "key string, payload_of int")
    hits = lambda: {(r.key, r.payload_of): r.payload for r in c.get(wanted).collect() if r.hit}
    assert c.get(wanted).count() == 7 and hits() == {} and c.misses(wanted).count() == 7
    c.put(rows(("a", '{"t": 1}'), ("b", "[]"), ("c", "{broken"), (None, "{}")), 1)
    assert hits() == {("a", 0): '{"t": 1}', ("a", 6): '{"t": 1}', ("b", 1): "[]"}
    c.put(rows(("a", '{"t": 1}'), ("b", "[]")), 1)  # replayed
    c.put(rows(("a", '{"t": 2}'), ("d", "4")), 2)
    c.invalidate(spark.createDataFrame([("b",), ("x",)], "key string"), 2)
    assert hits() == {("a", 0): '{"t": 2}', ("a", 6): '{"t": 2}', ("d", 3): "4"}
    c.put(rows(("b", '"back"'), ("a", "late")), 3)
    assert hits() == {("b", 1): '"back"', ("d", 3): "4"}  # a payload that is no JSON is a miss
    assert sorted(r.payload_of for r in c.misses(wanted).collect()) == [0, 2, 4, 5, 6]
    k = spark.createDataFrame([("u", ["c2", "c1"]), ("u", ["c1", "c2"]), ("v", ["c1"])], "q string, ids array<string>").select(cache.extraction_key(F.col("q"), F.col("ids")).alias("k")).collect()
    assert k[0].k == k[1].k != k[2].k and len(k[0].k) == 16


def test_quotas_by_turns(spark):
    """A row that is taken by an earlier profile does not count for a later one; free slots go to the first profile."""
    scores = {0: {1: 9, 2: 8, 3: 7, 4: 1, 5: 0, 6: 0}, 1: {1: 9, 2: 9, 3: 1, 4: 8, 5: 7, 6: 0}}
    rows = spark.createDataFrame([(k, p, float(s)) for p, x in scores.items() for k, s in x.items()], "k long, p int, s double")
    assert [(r.k, r.p) for r in select.quota_by_turns(rows, "p", "s", "k", 5).orderBy("position").collect()] == [(1, 0), (4, 1), (2, 0), (5, 1), (3, 0)]


def test_ids_run_on_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = {r.x: r.eid for r in select.numbered(rows, ["x"], "eid", "E").collect()}
    assert all(got[i] == f"E{i + 1:03d}" for i in range(1000))


def test_expansion_takes_first_seen(spark):
    rows = spark.createDataFrame([(0, 1, 5.0), (0, 2, 4.0), (0, 3, 3.0), (1, 2, 9.0), (1, 4, 8.0), (1, 5, 7.0)], "q int, k long, s double")
    got = select.expanded(rows, "q", [F.desc("s"), F.asc("k")], "k", 2, 3).collect()
    assert [(r.q, r.k) for r in got] == [(0, 1), (0, 2), (1, 4)]


def test_recovery_and_diagnosis(spark):
    text = "The plant draws 120 MW from the grid today, as the operator said. Nothing else is said in this quiet sentence of some length."
    chunks = spark.createDataFrame(
        [(1, 1, text, True, "evidence_dense", 0.5, 0), (1, 2, text, True, "evidence_dense", 0.1, 0), (1, 3, text, False, "evidence_dense", 0.9, 0), (1, 4, text, True, "context", 0.9, 0), (1, 5, text, True, "evidence_dense", 0.9, 2)],
        "doc_id long, chunk_number int, chunk_text string, selected boolean, chunk_type string, relevance double, items long",
    ).withColumn("quality", F.lit(5))
    kept, queue, metrics = evidence.recovery_pass(chunks, ("power", "grid"), ("power",))
    assert [(r.chunk_number, r.recovered_evidence_count) for r in queue.collect()] == [(1, 1)]
    assert [(r.chunk_number, r.reason) for r in kept.collect()] == [(1, "numeric_claim")]
    m = metrics.first()
    assert (m.eligible_chunks, m.chunks_recovered, m.recovered_evidence_items, m.items_before, m.items_after, m.with_evidence_after, m.recovery_yield) == (1, 1, 1, 2, 3, 2, 1.0)


def test_every_failure_stage(spark):
    long = "words about nothing in particular that fill a chunk well enough to be printed"
    cases = [
        ("BUDGET_EXCLUSION", long, False, 0, False, False, None, None, None), ("PARSER_FAILURE", "\x00" * 60, True, 0, False, False, None, None, None), ("NO_LLM_OUTPUT", long, True, 0, False, True, None, None, None),
        ("SCHEMA_VALIDATION_FAILURE", long, True, 0, False, True, 2, 0, 0), ("POST_PROCESSING_REJECTION", long, True, 0, False, True, 2, 2, 0), ("QUALITY_THRESHOLD_REJECTION", long, True, 0, False, True, 2, 2, 1),
        ("ATTRIBUTION_FAILURE", long, True, 3, True, False, None, None, None), ("CROSS_CHUNK", long, True, 3, False, False, None, None, None), ("EMPTY_EXTRACTION", long, True, 0, False, False, None, None, None),
        ("DUPLICATE_SUPPRESSION", long + " power", True, 0, False, False, None, None, None), ("UNKNOWN", None, True, 0, False, False, None, None, None),
    ]
    c = spark.createDataFrame(cases, "want string, chunk_text string, selected boolean, doc_items int, snippet_match boolean, called boolean, raw_items int, valid_items int, clean_items int")
    got = evidence.failure_stage(c).collect()
    assert all(r.stage == r.want and r.reason == evidence.FAILURE_REASONS[r.stage] for r in got) and {r.stage for r in got} == set(evidence.FAILURE_STAGES)


def test_coverage_levels(spark):
    e = spark.createDataFrame([("s1", "alpha"), ("s1", "beta"), ("s1", "beta"), ("s1", "gamma"), ("s1", "gamma"), ("s2", "gamma"), ("s2", "gamma"), ("s2", "gamma")], "source string, snippet string").withColumn("quality", F.lit(4))
    t = spark.createDataFrame([(x, [x]) for x in ("alpha", "beta", "gamma", "delta")], "topic string, terms array<string>")
    assert {r.topic: r.level for r in evidence.coverage(e, t).collect()} == {"alpha": "weak", "beta": "moderate", "gamma": "strong", "delta": "none"}


def test_regression_directions(spark):
    b = spark.createDataFrame([("up", 0.5), ("down", 0.5), ("same", 0.5), ("gone", 0.5)], "metric string, value double")
    c = spark.createDataFrame([("up", 0.6), ("down", 0.6), ("same", 0.52), ("new", 0.1)], "metric string, value double")
    assert {r.metric: r.status for r in evaluate.metric_diff(b, c, ("down",)).collect()} == {"up": "improved", "down": "fail", "same": "pass", "gone": "fail", "new": "improved"}


def test_best_target_ties_and_default(spark):
    i = spark.createDataFrame([(1, "grid power"), (2, "nothing here"), (3, "power grid cooling")], "id long, text string")
    t = spark.createDataFrame([(0, "power grid"), (1, "grid power"), (2, "cooling")], "t long, name string")
    assert {(r.id, r.t, r.overlap) for r in link.best_target(i, "id", "text", t, "t", "name", -1).collect()} == {(1, 0, 2), (2, -1, 0), (3, 0, 2)}


def test_text_functions(spark):
    d = spark.createDataFrame([("A  b.\n C? d",)], "t string").select(
        T.compact(F.col("t")).alias("c"), F.size(T.sentences(F.col("t"))).alias("n"), T.recommendation_id(F.lit("rec 7")).alias("r"), T.pdf_date(F.lit("D:20249915")).alias("d"), T.capitalised(F.lit("aBC")).alias("k")
    )
    r = d.first()
    assert (r.c, r.n, r.r, r.d, r.k) == ("A b. C? d", 3, "REC-007", None, "Abc")


def test_question_modes(spark):
    q = ["What factors drive cost?", "Compare A versus B", "Why is it hot?", "How many GPUs are there?", "GPU count"]
    got = [r.m for r in spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, q string").select("i", classify.question_mode(F.col("q")).alias("m")).orderBy("i").collect()]
    assert got == ["EXPLORATORY_RESEARCH", "COMPARISON", "EXPLANATION", "FACT_LOOKUP", "FACT_LOOKUP"]


def test_cosine_of_missing_vector_is_zero(spark):
    from corvane.operators.score import cosine

    r = spark.createDataFrame([([3.0, 4.0], None)], "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("a")).alias("s"), cosine(F.col("a"), F.col("b")).alias("z")).first()
    assert math.isclose(r.s, 1, abs_tol=1e-6) and r.z == 0


def test_reader_splits_good_and_bad(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.txt").write_text("   ")
    (tmp_path / "c.csv").write_text("x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "d.txt").write_text("no")
    good, bad = readers.documents(spark, str(tmp_path))
    assert [(r.name, r.char_count) for r in good.collect()] == [("a.md", 5)]
    assert [r.path.rsplit("/", 1)[-1] for r in bad.collect()] == ["b.txt"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n')
    from pyspark.sql import types as Y

    rows, corrupt = readers.json_lines(spark, str(tmp_path / "x.jsonl"), Y.StructType([Y.StructField("a", Y.LongType())]))
    assert [r.a for r in rows.collect()] == [1] and corrupt.count() == 1


def _docs(spark, rows):
    return spark.createDataFrame(rows, "uri string, text string")


LONG = "The power rack holds forty cooling pumps and a heat exchanger in every aisle. "


def test_store_builds_incrementally(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    first = store.build(_docs(spark, [("u1", LONG), ("u2", LONG + "Networks need a switch and more fibre for every single rack.")]), "d", "r1")
    assert first["added"] == 2 and first["evidence"] > 0
    again = store.build(_docs(spark, [("u1", LONG)]), "d", "r2")
    assert again == {"documents": 1, "skipped": 1, "added": 0, "evidence": 0}
    store.build(_docs(spark, [("u1", LONG + "Changed for the better with new thermal storage tanks.")]), "d", "r3")
    m = store.manifest("d").collect()
    assert sorted(r.uri for r in m) == ["u1", "u2"]
    assert [(r.domain, r.sources, r.runs, r.completed) for r in store.report().collect()] == [("d", 2, 3, 1.0)]
    assert store.read("source").count() == 3
    assert {r.run_id: r.status for r in store.runs().collect()} == {"r1": "COMPLETED", "r2": "COMPLETED", "r3": "COMPLETED"}
    e = store.read("evidence")
    assert e.count() == e.select("fingerprint").distinct().count() == store.missing_embeddings().count()
    assert [r.ready for r in store.health().collect()] == [True]
    assert [r.domain for r in store.domains().collect()] == ["d"]


@pytest.mark.parametrize("after", ["source", "evidence", "metadata"])
def test_a_broken_build_is_completed_by_the_next(spark, tmp_path, monkeypatch, after):
    """A build that breaks off after any table leaves the others readable; its repetition adds what is missing, once."""
    store, whole = Store(spark, str(tmp_path / "kb")), Store(spark, str(tmp_path / "whole"))
    docs = _docs(spark, [("u1", LONG), ("u2", LONG + "Networks need a switch and more fibre for every single rack."), ("u0", LONG)])
    whole.build(docs, "d", "r1")
    put = Store.append

    def broken(self, name, rows):
        put(self, name, rows)
        if name == after:
            raise OSError("lost")

    monkeypatch.setattr(Store, "append", broken)
    with pytest.raises(OSError, match="lost"):
        store.build(docs, "d", "r1")
    monkeypatch.undo()
    assert store.manifest("d").count() == 0
    store.build(docs, "d", "r1")
    for name in ("source", "evidence", "metadata"):
        assert sorted(map(str, store.read(name, "d").collect())) == sorted(map(str, whole.read(name, "d").collect()))
    assert sorted((r.uri, r.evidence_count) for r in store.manifest("d").collect()) == sorted((r.uri, r.evidence_count) for r in whole.manifest("d").collect())
    assert sorted(r.uri for r in store.manifest("d").collect()) == ["u0", "u2"]


def test_embedding_within_the_build(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    store.build(_docs(spark, [("u1", LONG)]), "d", "r1", embed=lambda: lambda texts: [[float(len(x))] if "rack" in x else None for x in texts])
    assert store.read("embedding").count() > 0 and store.read("embedding").filter("vector is null").count() == 0


def test_objects_have_versions(spark, tmp_path):
    kept = objects.Objects(spark, str(tmp_path / "objects"))
    assert kept.of("engagement").count() == 0 and kept.latest("engagement").count() == 0
    rows = lambda *r: spark.createDataFrame(r, "id string, n int, links array<string>")
    kept.put("engagement", rows(("a", 1, []), ("b", 1, ["x"]), (None, 0, [])), "id", 1)
    kept.put("engagement", rows(("a", 1, []), ("b", 1, ["x"])), "id", 1)  # repeated
    kept.put("model", rows(("m", 9, None)), "id", 7)
    schema = "n int, links array<string>"
    assert {(r.id, r.version, r.n, tuple(r.links)) for r in kept.of("engagement", schema).collect()} == {("a", 1, 1, ()), ("b", 1, 1, ("x",))}
    linked = engage.linked(kept.of("engagement", schema), spark.createDataFrame([("b", "y", 2), ("b", "x", 1), ("b", "y", 3), ("z", "q", 1)], "id string, link string, o int"), "id", "links", "link", "o")
    kept.put("engagement", linked.filter("id = 'b'").select("id", "n", "links"), "id", 2)
    got = kept.latest("engagement").first()
    assert (got.id, got.version) == ("b", 2) and kept.of("engagement", schema).filter("id = 'b'").first().links == ["x", "y"]
    assert kept.of("model", schema).first().n == 9


def test_memos_as_markdown(spark):
    lines = [("m", "T", "Facts", 1, 2, "two"), ("m", "T", "Facts", 1, 1, "one"), ("m", "T", "Risks", 2, 1, None), ("n", "U", "Facts", 1, 1, "x")]
    got = {r.memo: r.markdown for r in objects.markdown(spark.createDataFrame(lines, "memo string, title string, section string, section_ord int, ord int, line string")).collect()}
    assert got == {"m": "# T\n\n## Facts\n\n- one\n- two\n\n## Risks\n\n_None._\n", "n": "# U\n\n## Facts\n\n- x\n"}


def test_stream_feeds_the_store(spark, tmp_path):
    _docs(spark, [("u1", LONG)]).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "kb"))
    for _ in range(2):
        q = ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), store, "d", str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert store.read("source").count() == 1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "x")], "a long, b string")
    sinks.json_documents(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).collect()[0].b == "x"
    assert "| 1 | x |" in sinks.markdown_table(d)
    assert "- one" in sinks.memo("T", {"S": ["one"]})


def test_extension_points(spark):
    import pandas as pd

    from corvane.operators import plugin

    d = spark.createDataFrame([(1, LONG), (2, "")], "doc_id long, text string")
    assert {r.doc_id for r in plugin.extract(d, None, "").collect()} == {1}
    own = plugin.extract(d, lambda: lambda b: pd.DataFrame({"doc_id": b.doc_id, "n": b.text.str.len()}), "doc_id long, n long")
    assert {r.doc_id: r.n for r in own.collect()} == {1: len(LONG), 2: 0}
    rows = spark.createDataFrame([("a", "power grid"), ("b", "power grid"), ("c", "")], "evidence_id string, statement string")
    first = plugin.embeddings(rows, None)
    got = {r.evidence_id: r.vector for r in first.collect()}
    assert set(got) == {"a", "b"} and got["a"] == got["b"]
    assert plugin.embeddings(rows, first).count() == 0
    known = spark.createDataFrame([("E1",)], "e string")
    named = spark.createDataFrame([(1, ["E1", "E2"])], "k long, ids array<string>")
    assert [tuple(r) for r in plugin.unknown(named, "k", "ids", known, "e").collect()] == [(1, "E2")]
    assert plugin.all_covered(known, known, "e")


def test_small_readers(spark):
    import pytest

    assert readers.question_list("# x\n- How much?\n2) 'Why?'\nlist:\n") == ["How much?", "Why?"]
    assert readers.engagement({"title": "t", "question": "q", "objectives": "o", "profiles": ["p"]})["objectives"] == ["o"]
    with pytest.raises(ValueError, match="profiles"):
        readers.engagement({"title": "t", "question": "q", "objectives": ["o"]})
    w = readers.web_chunks(spark.createDataFrame([("u1", "x"), ("u2", " ")], "url string, text string")).collect()
    assert [(r.document_name, r.chunk_id) for r in w] == [("u1", "web_0000_0000")]
    v = readers.vocabulary(spark, "p", {"topics": {"a": ["X", "y"]}, "terms": ["z"]})
    assert v.count() == 3 and readers.topic_terms(v, "topics").first().terms == ["x", "y"]
    assert readers.domain_of("/a/b/", {}) == "b"


def test_compaction_keeps_what_live_sources_say(spark, tmp_path):
    """A statement of a replaced source stays if another source says it, under its old id; the old store stays as it is."""
    store = Store(spark, str(tmp_path / "kb"))
    more = "Networks need a switch and more fibre for every single rack of the power hall."
    store.build(_docs(spark, [("u1", LONG + more), ("u2", more), ("u3", "Reactor licensing takes many months of review and of public hearings.")]), "d", "r1", embed=lambda: lambda texts: [[float(len(x))] for x in texts])
    store.build(_docs(spark, [("u1", "Only cooling water and pumps are left here, for all the racks in the building.")]), "d", "r2", embed=lambda: lambda texts: [[float(len(x))] for x in texts])
    before = {n: store.read(n).count() for n in ("source", "evidence", "manifest")}
    assert {r.uri: r.evidence_count > 0 for r in store.sources_of("d").collect()}.keys() == {"u1", "u2", "u3"}
    old = {r.statement for r in store.read("evidence").collect()} - {r.statement for r in store.live("evidence").collect()}
    assert old and store.live("source").count() == 3 and store.live("metadata").count() == store.live("evidence").count() == store.live("embedding").count()
    for _ in range(2):  # again, as after a break
        small = store.compacted(str(tmp_path / "small"))
    said = {r.statement: r.evidence_id for r in small.read("evidence").collect()}
    was = {r.statement: r.evidence_id for r in store.read("evidence").collect()}
    fresh = Store(spark, str(tmp_path / "fresh"))
    fresh.build(store.live("source").select("uri", "text"), "d", "r")
    assert set(said) == {r.statement for r in fresh.read("evidence").collect()} and any("switch" in s for s in said) and not any("forty cooling pumps" in s for s in said)
    assert all(was[s] == i for s, i in said.items() if s in was)
    vectors = small.read("embedding")
    assert vectors.count() == vectors.select("evidence_id").distinct().count() > 0
    assert {n: store.read(n).count() for n in before} == before and small.issues().count() == 0
    store.append("source", spark.createDataFrame([("s", "u", "x", "bare")], "source_id string, uri string, text string, domain string"))
    assert [tuple(r) for r in store.issues().collect()] == [("bare", "no evidence")]


def test_store_keeps_a_text_of_two_domains_in_both(spark, tmp_path):
    st = Store(spark, str(tmp_path / "store"))
    for domain in ("a", "b"):
        st.build(spark.createDataFrame([("1", "Rack power is 120 kW at the liquid cooled site today.")], "uri string, text string"), domain, f"r-{domain}")
    assert {(r.domain, r.sources) for r in st.report().collect()} == {("a", 1), ("b", 1)}
    assert sorted(r.domain for r in st.live("source").collect()) == ["a", "b"]


def test_long_terms_with_a_common_beginning_are_told_apart_by_the_index(spark, monkeypatch):
    names = [f"customer#{i:09d}" for i in range(3000)] + ["x", "ab", "é😀z", "customer#000000007 and then the whole of it"]
    v = spark.createDataFrame([(n, n) for n in names], "term string, label string")
    rows_ = spark.createDataFrame([(i, f"Order of Customer#{i:09d}.") for i in range(0, 3000, 7)] + [(-1, "an É😀Z, AB"), (-2, "customer#000000007 and then the whole of it"), (-3, None)], "id long, t string")
    key = terms._runs(F.lit("er#000000007"), 12)
    assert len(spark.range(1).select(key.alias("k")).first().k) == 1
    both = []
    for most in (10**6, 0):
        monkeypatch.setattr(terms, "AUTOMATON_TERMS", most)
        both.append({r.id: r.labels for r in terms.labelled(rows_, "t", v).collect()})
    assert both[0] == both[1] and both[1][14] == ["customer#000000014"] and len(both[1]) == rows_.count()
    low = F.col("term")
    kept = terms._grams(low)
    assert v.select(F.size(F.array_intersect(kept, terms._runs(F.lit("order of customer#000000014."), 12))).alias("n"), "term").filter("n = 7").count() == 1


def test_big_side_of_a_join_is_not_broadcast_however_few_bytes_it_has(spark, tmp_path):
    from corvane.sources import scratch

    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = spark.range(10).join(scratch.bounded_broadcast(t, 10_000), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_records_of_a_long_file_come_in_bounded_batches():
    import pandas as pd

    text = "\n".join(['{"a": 1}', "", "[2]", "{oops"] * records.ROWS_AT_ONCE).encode()
    got = list(records._parse(iter([pd.DataFrame({"path": ["/f/x.txt", "/f/y.json"], "content": [text, b"[1]"]})])))
    assert max(map(len, got)) == records.ROWS_AT_ONCE and sum(map(len, got)) == 3 * records.ROWS_AT_ONCE + 1
    assert [tuple(r)[3:] for r in got[0].head(2).itertuples(index=False)] == [(0, '{"a": 1}', None), (1, None, "a mapping is wanted, not list")]


def test_links_may_be_shared_by_a_key(spark):
    rows_ = spark.createDataFrame([(i, i % 2, []) for i in range(4)], "id int, r int, l array<string>")
    links = spark.createDataFrame([(0, "b", 2), (0, "a", 1), (0, "b", 0), (1, None, 1)], "r int, link string, o int")
    assert {r.id: r.l for r in engage.linked(rows_, links, "r", "l", "link", "o").collect()} == {0: ["b", "a"], 2: ["b", "a"], 1: [], 3: []}


def test_faster_patterns_and_guards_match_the_same(spark):
    from corvane.functions import lexicon as L

    rng = random.Random(3)
    words = "MW kW GWh MWh MW(th) MWe GB/s bn mn billion USD GBP EUR PUE GPU GPUs TPU CPU ASICs rack servers FERC NERC ISO-NE IEC IRA ISO Order NARUC ANSI PUCT DOE interconnection queue transmission planning Inflation Reduction Act renewable portfolio standard more less than compared to with vs vs. versus unlike while whereas relative Jan March Sept May 2024 1999 Q3 12 1,200.5 3.4.5 % $ € million tonnes months years contents Table of ..... all rights reserved © copyright confidential and proprietary no part this report page click here next figure source: menu references bibliography works cited [3] doi: 10.1234/ www executive summary key findings conclusion cost analysis policy é Ünit İ K ſ".split()
    seps = (" ", " ", " ", "\n", ". ", "  ", "", ", ", "-", "! ", "\t", "?")
    texts = ["".join(w.swapcase() * (1 + (rng.random() < 0.02)) + rng.choice(seps) if rng.random() < 0.2 else w + rng.choice(seps) for w in rng.choices(words, k=rng.randint(0, 90))) for _ in range(1500)] + ["", " \n \t. ", "a" * 900, " " * 3000]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t")).cache()
    t, low = F.col("t"), F.col("low")
    for p in L.FASTER:
        assert d.filter(F.regexp_count(t, F.lit(p)) != F.regexp_count(t, F.lit(L.FASTER[p]))).count() == 0, p
    for p in L.NEEDS:
        assert d.filter(t.rlike(p) & (classify.R.pattern_hits(t, (p,), low) == 0)).count() == 0, p
    blank = lambda x: F.btrim(x, F.lit(" \t\r\f\x0b"))
    pieces = F.filter(F.transform(F.split(t, r"[.!?\n]+"), blank), lambda x: x != "")
    long_ = F.size(F.filter(pieces, lambda x: F.size(F.split(x, r"\s+")) > 8))
    assert d.filter((F.size(pieces) != classify.R.matches(t, classify._PIECE)) | (long_ != classify.R.matches(t, classify._LONGER))).count() == 0


def test_looks_miss_no_match_and_know_lists(spark):
    rng = random.Random(4)
    words = "MW GWh bn USD GPUs FERC Order 2023 ISO 9001 more than vs. x while whereas Jan 2024 Q3 1,200.5 % Big Blue Sky AB Table of Contents ..... all rights reserved © 2020 copyright confidential and proprietary page 3 of 4 figure 12. source: references doi: 10.1234/ [3] works cited key findings conclusions cost analysis é Ünit İ K ſ a bb ccc".split()
    seps = (" ", " ", " ", "\n", ". ", "  ", "\x0b", ", ", "\r", "! ", "\t", "?", " ", "\x85")
    made = ["".join(w + rng.choice(seps) for w in rng.choices(words, k=rng.randint(0, 60))) for _ in range(1500)]
    made += ["", "x " * 198 + "conclusionary", "more\x0bthan", "contents\r\nx", "1 2 3 4", "a. b. c. d. e.", "a b c d e f g h i. " * 5, "Big\x0bSky"]
    d = spark.createDataFrame([(t,) for t in [*made, None]], "t string").withColumn("b", classify.looks(F.col("t"))).cache()
    t = F.col("t")
    tried = {n: (p,) for n, p in classify.SIGNALS} | classify._LISTS
    for name, patterns in tried.items():
        assert d.filter((classify.R.pattern_hits(t, patterns) > 0) & ~classify._may(F.col("b"), name)).count() == 0, name
    assert d.filter((classify.R.pattern_hits(F.substring(t, 1, 400), classify.L.PRIORITY_HEADERS) > 0) & ~classify._may(F.col("b"), "header")).count() == 0
    assert d.filter("b is null").count() == d.filter("t is null").count() == 1
    assert d.filter("b = 0").count() > 0  # nothing is tried where nothing can match

    def listy(x):
        p = [q for q in re.split(r"[.!?\n]+", x) if q.strip(" \t\r\f\x0b")]
        return len(p) >= 5 and sum(len([w for w in re.split(r"[ \t\r\f\x0b]+", q) if w]) <= 8 for q in p) / len(p) > 0.6

    last = 1 << classify._LOOKS.index("listy")
    assert all(bool(r.b & last) == listy(r.t) for r in d.filter("t is not null").collect())
    c = classify.classified(d, "t")
    for n, p in classify.SIGNALS:
        assert c.filter(~F.col("signals")[n].eqNullSafe(F.regexp_count(t, F.lit(p)))).count() == 0, n


def test_topics_are_sought_where_the_text_holds_a_term(spark):
    groups = (("split", ("end. Next",)), ("none", ("zzqzz",)), ("greek", ("ας",)), ("blank", ("",)))
    long_ = "A sentence that is long enough to count, with its end. Next comes one that is long enough as well."
    d = spark.createDataFrame([(1, long_), (2, "ΑΣΑ " + "x" * 60), (3, "Word ΑΣ " + "y" * 60), (4, ""), (5, None)], "doc_id int, text string")
    held = {r.doc_id: r.h for r in d.select("doc_id", chunking._held(F.col("text"), groups).alias("h")).collect()}
    assert held[1] == [True, False, True, True] and held[2][2] and held[3][2]
    got = {(r.doc_id, r.topic): (r.snippet, r.window) for r in chunking.topic_sentences(d, groups).filter("n = 1").collect()}
    assert got[1, "split"] == (long_, True) and (1, "none") not in got and not got[3, "greek"][1] and (2, "greek") not in got
    assert {k for k in got if k[0] > 3} <= {(4, "blank")}


def test_scores_are_not_found_again_by_a_filter(spark):
    e = spark.createDataFrame([("c", "a snippet with 3 MW", "power", "r", 3)], "claim string, snippet string, category string, relevance string, quality int")
    plan = evidence.scored(e, ("with",), ("power",)).filter("overall_score >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert all("overall_score" in line or "isnotnull" in line for line in plan.split("\n") if "Filter" in line) and "Generate" in plan


def test_chunks_are_cut_by_one_pattern_and_carry_columns(spark):
    d = spark.createDataFrame([(1, "src1", "One end. " * 40 + "é😀" * 30)], "doc_id int, source string, text string")
    c = chunking.chunks(d, 70, 80, keep=("source",))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert r"{70,79}?" in plan and "split(" not in plan
    got = c.orderBy("chunk_number").collect()
    assert {r.source for r in got} == {"src1"} and "".join(r.chunk_text for r in got) == d.first().text
    assert [(r.start_offset, r.end_offset) for r in got[:2]] == [(0, 71), (71, 143)] and got[-1].end_offset == 420


def test_text_is_compacted_and_cut_without_patterns_as_with_them(spark):
    rng = random.Random(7)
    parts = ["ab", "c.", "d!", "é?", "😀", "\n", "\t", " ", "  ", "\x0b", "\x0c", "\r\n", "\u0001", ". ", " ", "\x85"]
    d = spark.createDataFrame([(t,) for t in ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(500)] + [None, "", "   "]], "t string")
    t, plain = F.col("t"), F.trim(F.regexp_replace("t", r"\s+", " "))
    cut = F.split(F.regexp_replace(plain, r"([.!?])\s+", "$1\u0001"), "\u0001")
    assert d.filter(~T.compact(t).eqNullSafe(plain) | ~T.sentences(T.compact(t), compacted=True).eqNullSafe(cut)).count() == 0


def test_scores_with_a_least_one_are_those_of_the_filter(spark):
    rng = random.Random(8)
    words = "power rack 12 MW 30 kW liquid that with from gpu of the long words here and there ups 2,500 months".split()
    made = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30))), rng.choice(["power", "other", "cooling"]), rng.choice([None, 1, 2, 3, 4, 5])) for i in range(400)]
    e = spark.createDataFrame(made, "id int, snippet string, category string, quality int").withColumns({"claim": F.upper("snippet"), "relevance": F.lit("r")})
    for least in (0.0, 3.0, 3.5, 4.2):
        some = evidence.scored(e, ("that", "with"), ("power",), least=least)
        want = evidence.scored(e, ("that", "with"), ("power",)).filter(F.col("overall_score") >= least)
        assert sorted(map(tuple, some.select(want.columns).collect())) == sorted(map(tuple, want.collect())) != []
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 4  # a filter after every score


def test_reports_are_dealt_to_all_cores(spark):
    from corvane.plans import pass_queries

    r = pass_queries.documents(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in r._jdf.queryExecution().executedPlan().toString()


def test_items_below_the_least_score_are_dropped_before_their_texts_are_made(spark):
    """What may_score drops scores less, what it keeps has the same place and score; most items of plain prose go."""
    plain, rich = "Thonen ingth velor amet dusk without anything that matters here at all, said plainly", "With that power from the rack of 40 kW and 12 GB the GPU tray aquel qui stays cool, said plainly"
    mixed = [f"{(rich if (i + j) % 5 == 0 else plain)} {chr(97 + j)}{' voltage liquid thermal switch ups' if (i * j) % 7 == 3 else ''}" for i in range(12) for j in range(5)]
    docs = spark.createDataFrame([(i, ". ".join(mixed[5 * i : 5 * i + 5]) + ". the end", 1 + i % 5) for i in range(12)] + [(98, " \t\n", 3), (99, "", 3), (100, None, 3)], "doc_id long, text string, quality int")
    terms, groups = ("that", "with", "from", "qui", "aquel", "chilled water", "note: x"), (("power", ("thonen", "rack of")), ("stop", ("that ",)))
    every = evidence.extracted(docs, terms, groups, keep=("quality",))
    early = evidence.extracted(docs, terms, groups, keep=("quality",), may_score=evidence.may_score(terms, ("power",), 3.5))
    of = lambda e, least: {(r.doc_id, r.ord, r.snippet, r.claim, r.overall_score) for r in evidence.scored(e, terms, ("power",), least=least).collect()}
    assert of(early, 3.5) == of(every, 3.5) != set()
    assert early.count() < every.count()


def test_documents_are_dealt_to_many_tasks(spark, tmp_path):
    """A single row group is not a single task, and rows of one key do not meet in one."""
    from corvane.sources.scratch import dealt, scan_bytes

    path = str(tmp_path / "docs.parquet")
    spark.range(400).selectExpr("7L doc_id", "concat('text ', id) text").coalesce(1).write.parquet(path)
    d = spark.read.parquet(path)
    sizes = dealt(d, scan_bytes(d), "doc_id", "text", piece=scan_bytes(d) // 8).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 400 and len(sizes) >= 6 and max(r["count"] for r in sizes) < 150
