"""The jobs over growing input, after a break, and from the command line; main text of pages."""

from __future__ import annotations

import itertools
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import DATA
from harness import connection, rows
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.plans import queries as _  # noqa: F401
from corvane.plans.catalog import ORACLES
from jobs import evidence_feed, page_corpus

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def wanted():
    con = connection(DATA)
    return {name: con.sql(ORACLES[name]).df() for name in ("job1_evidence_feed", "job2_page_corpus")}


def files(folder: Path) -> set[str]:
    return {str(p) for p in folder.rglob("part-*.parquet")}


def test_feed_takes_only_what_is_new(spark, tmp_path, wanted):
    docs, config = spark.read.parquet(f"{DATA}/documents.parquet"), evidence_feed.load_config()
    feed, out, state = str(tmp_path / "feed"), tmp_path / "out", tmp_path / "state"
    run = lambda: evidence_feed.run(spark, feed, str(out), str(state), config)
    docs.filter("doc_id < 70").coalesce(1).write.parquet(feed)
    first = run()
    want = wanted["job1_evidence_feed"]
    assert first["documents"] == 70 and first["written"] == int((want.doc_id < 70).sum()) > 0
    assert rows(evidence_feed.output(spark, str(out)).toPandas()) == rows(want[want.doc_id < 70])
    kept = files(out)
    docs.filter("doc_id >= 70").coalesce(1).write.mode("append").parquet(feed)
    second = run()
    assert second["documents"] == docs.count() - 70 and kept < files(out)
    assert rows(evidence_feed.output(spark, str(out)).toPandas()) == rows(want)
    kept = files(out)
    assert run() == {"batches": 0, "documents": 0, "found": 0, "written": 0} and files(out) == kept


def test_feed_is_completed_after_a_break(spark, tmp_path, wanted):
    docs, config = spark.read.parquet(f"{DATA}/documents.parquet"), evidence_feed.load_config() | {"files_per_batch": 1}
    feed, out, state = str(tmp_path / "feed"), tmp_path / "out", tmp_path / "state"
    docs.repartition(3).write.parquet(feed)
    assert evidence_feed.run(spark, feed, str(out), str(state), config)["batches"] == 3
    for name in ("2", ".2.crc"):  # as if the run had ended between the sink's commit and the stream's
        (state / "commits" / name).unlink(missing_ok=True)
    evidence_feed.run(spark, feed, str(out), str(state), config)
    assert rows(evidence_feed.output(spark, str(out)).toPandas()) == rows(wanted["job1_evidence_feed"])


def test_feed_of_odd_documents(spark, tmp_path):
    docs = [(1, None, "a"), (2, "", "a"), (None, "Text with that in it and from here on, which is long enough.", None), (4, "x" * 20_000, ""), (5, "It is in contrast to what other sources say, with that claim from them.", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("claim", F.lit(1)).write.parquet(str(tmp_path / "feed"))
    done = evidence_feed.run(spark, str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "state"), evidence_feed.load_config())
    got = evidence_feed.output(spark, str(tmp_path / "out")).collect()
    assert done["documents"] == 5 and done["found"] > done["written"] == len(got)
    assert {r.doc_id for r in got} == {None, 4, 5} and all(r.quality == 2 for r in got)


def test_feed_without_documents(spark, tmp_path):
    config, out = evidence_feed.load_config(), str(tmp_path / "out")
    none = {"batches": 0, "documents": 0, "found": 0, "written": 0}
    (tmp_path / "feed").mkdir()
    assert evidence_feed.output(spark, out).count() == 0
    assert evidence_feed.run(spark, str(tmp_path / "feed"), out, str(tmp_path / "state"), config) == none
    assert evidence_feed.output(spark, out).count() == 0
    spark.createDataFrame([], evidence_feed.DOCUMENTS).write.mode("append").parquet(str(tmp_path / "feed"))
    assert evidence_feed.run(spark, str(tmp_path / "feed"), out, str(tmp_path / "state"), config) == none
    assert evidence_feed.output(spark, out).count() == 0


def test_feed_counts_more_batches_than_the_query_reports(spark, tmp_path):
    """Progress is noted as the stream runs; files are dealt one a batch."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(40).repartition(20).write.parquet(str(tmp_path / "feed"))
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    done = evidence_feed.run(spark, str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "state"), evidence_feed.load_config() | {"files_per_batch": 1})
    assert done["documents"] == 40 and done["batches"] == len(list((tmp_path / "feed").glob("part-*"))) and done["written"] == evidence_feed.output(spark, str(tmp_path / "out")).count()
    assert spark.conf.get("spark.sql.streaming.numRecentProgressUpdates") == kept


def test_pages_are_rebuilt_as_they_grow(spark, tmp_path, wanted):
    pages, config = spark.read.parquet(f"{DATA}/pages.parquet"), page_corpus.load_config()
    took, out = str(tmp_path / "pages"), str(tmp_path / "out")
    pages.filter("page_id < 20").write.parquet(took)
    assert page_corpus.run(spark, took, out, config)["pages"] == 20
    pages.filter("page_id >= 20").write.mode("append").parquet(took)
    for _ in range(2):
        done = page_corpus.run(spark, took, out, config)
        assert rows(page_corpus.output(spark, out).toPandas()) == rows(wanted["job2_page_corpus"])
    assert done["pages"] == pages.count() and done["chunks"] == len(wanted["job2_page_corpus"])
    assert {p.name for p in (tmp_path / "out" / "chunks").iterdir() if p.is_dir()} == {f"lang={x}" for x in wanted["job2_page_corpus"].lang}


def test_equal_and_odd_pages(spark, tmp_path):
    body = " ".join(f"word{i}" for i in range(60))
    pages = [(2, "http://b.org/x", f"<p>{body}</p>"), (1, "http://a.org/x", f"<html lang=de-AT><p>{body.upper()}</p>"), (1, "http://a.org/x", f"<html lang=de-AT><p>{body.upper()}</p>"), (3, None, None), (4, "no url", ""), (5, "http://c.org", "<nav>only a menu</nav>"), (None, None, f"<div>{body} more</div>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).write.parquet(str(tmp_path / "pages"))
    done = page_corpus.run(spark, str(tmp_path / "pages"), str(tmp_path / "out"), page_corpus.load_config())
    got = page_corpus.output(spark, str(tmp_path / "out")).collect()
    assert done == {"pages": 7, "readable": 4, "chunks": 2}
    assert {(r.page_id, r.host, r.lang) for r in got} == {(1, "a.org", "de"), (None, "", "und")}
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none"))
    assert page_corpus.run(spark, str(tmp_path / "none"), str(tmp_path / "empty"), page_corpus.load_config()) == {"pages": 0, "readable": 0, "chunks": 0}


@pytest.mark.parametrize("job", ["evidence_feed", "page_corpus"])
def test_command_lines(tmp_path, spark, job):
    given = {"evidence_feed": ["--documents", f"{DATA}/documents.parque[t]", "--checkpoint", str(tmp_path / "state")], "page_corpus": ["--pages", f"{DATA}/pages.parquet"]}[job]
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "_PYSPARK"))} | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 2g --conf spark.ui.enabled=false pyspark-shell"}
    end = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), *given, "--out", str(tmp_path / "out")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert end.returncode == 0, end.stderr[-2000:]
    assert "read 200 documents in 1 batches" in end.stderr if job == "evidence_feed" else "read 50 pages" in end.stderr
    with pytest.raises(FileNotFoundError):
        (evidence_feed if job == "evidence_feed" else page_corpus).load_config(tmp_path / "none.json")


def test_configs_are_checked(tmp_path):
    at = tmp_path / "c.json"
    at.write_text('{"target_chars": 5, "most_chars": 4, "least_chars": 1}')
    with pytest.raises(ValueError, match="below"):
        page_corpus.load_config(at)
    at.write_text('{"target_chars": 3, "most_chars": 4, "least_chars": 0}')
    with pytest.raises(ValueError, match="least_chars"):
        page_corpus.load_config(at)
    at.write_text('{"terms": [], "topics": [], "focus": [], "per_document": 1, "least": 1, "files_per_batch": 1}')
    with pytest.raises(ValueError, match="topics"):
        evidence_feed.load_config(at)
    at.write_text('{"topic": []}')
    with pytest.raises(ValueError, match="unknown"):
        evidence_feed.load_config(at)


def test_jobs_import_nothing_optional():
    for p in [*(ROOT / "jobs").glob("*.py"), ROOT / "tests" / "test_jobs.py"]:
        assert not any(line.lstrip().startswith(("import corpus_pipeline", "from corvane.llm", "import corvane.llm")) for line in p.read_text().splitlines())


def test_best_run_equals_brute_force(spark):
    rng = random.Random(2)
    lists = [[rng.randint(-6, 6) for _ in range(rng.randint(0, 12))] for _ in range(400)] + [[], [0, 0], [-1, -2], [3, 0, -3, 3]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, p array<int>").select("i", H.best_run(F.col("p")).alias("r")).collect()
    for r in got:
        p = lists[r.i]
        runs = [(-sum(p[a:b]), b, a) for a, b in itertools.combinations(range(len(p) + 1), 2) if sum(p[a:b]) > 0]
        want = min(runs, default=(0, 0, -1))
        assert (r.r.best, r.r.first, r.r.last) == (-want[0], want[2], want[1] - 1), p


def planted(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the words of its article; the words of everything else are others."""
    n = itertools.count()
    say = lambda kind, k: " ".join(f"{kind}{next(n)}" for _ in range(k))
    links = lambda k: "".join(f"<li><a href='#'>{say('menu', rng.randint(1, 3))}</a></li>" for _ in range(k))
    article = [f"<p>{say('main', rng.randint(15, 70))} <b>{say('main', 2)}</b>, <a href='#'>{say('main', 2)}</a>.</p>" for _ in range(rng.randint(3, 9))]
    article.insert(rng.randint(1, len(article) - 1), f"<h2>{say('main', rng.randint(2, 6))}</h2>")
    article.insert(rng.randint(1, len(article) - 1), f"<p>{say('main', rng.randint(2, 5))}</p>")
    inside = "".join(article)
    page = f"""<html lang="en"><head><title>{say('head', 4)}</title><style>p {{ x: y }}</style></head><body><div class=top><ul>{links(rng.randint(4, 12))}</ul></div>
      <!-- {say('comment', 5)} --><nav>{say('nav', 8)}</nav><div class=ad>{say('ad', rng.randint(2, 7))}</div><div>{inside}</div>
      <div>{say('share', 2)}</div><ul>{links(rng.randint(4, 12))}</ul><div>{say('legal', rng.randint(3, 8))}</div><footer>{say('foot', 30)}</footer><script>{say('code', 9)}</script></body></html>"""
    return page, {w for w in inside.replace("<", " <").replace(">", "> ").replace(",", " ").replace(".", " ").split() if w.startswith("main")}


def test_main_text_finds_the_planted_article(spark):
    rng = random.Random(9)
    pages = [planted(rng) for _ in range(120)]
    got = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, html string").select("i", H.main_text(F.col("html")).alias("t")).collect()
    hit = said = meant = 0
    for r in got:
        words = {w.strip(".,") for w in r.t.split()} - {""}
        hit, said, meant = hit + len(words & pages[r.i][1]), said + len(words), meant + len(pages[r.i][1])
    assert hit / said > 0.99 and hit / meant > 0.99, (hit / said, hit / meant)


def test_main_text_of_odd_pages(spark):
    odd = [None, "", "plain text only", "<p>a &lt;b&gt; &amp; c</p>", "<script>never closed", "<!-- never closed", "<a href=x>link</a>", "<div><a>" * 3000, "\x01\x02 <p>short</p>", "<p>" + "w " * 50_000 + "</p>"]
    got = {r.i: r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, html string").select("i", H.main_text(F.col("html")).alias("t")).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "plain text only" and got[3] == "a <b> & c"
    assert got[6] == "" and got[7] == "" and got[8] == "short" and len(got[9]) == 99_999
