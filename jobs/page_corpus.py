"""Builds a corpus of chunks from captured web pages.

    python jobs/page_corpus.py --pages PAGES --out FOLDER [--config jobs/page_corpus.json]

Reads pages (page_id, url, html) and writes under FOLDER, partitioned by the language that a page declares:

    pages    every readable page: page_id, url, host, title, text, fingerprint, lang
    chunks   page_id, url, host, title, chunk_number, start_offset, end_offset, chunk_text, lang of one page of each text

Pages are rebuilt as a whole: both tables are overwritten, so that a run after a broken one, or a second one over the same
pages, gives the same files' content.  Chunks are made from the written pages, so html is parsed once.

Cases: a page whose main text has fewer than least_chars characters is not readable and is counted only; of pages with the
same text (whatever its spacing and case) the one with the least id, then url, stays, null ids first; a null or foreign
url has the host ''; no pages give empty tables.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corvane.functions import html as H  # noqa: E402
from corvane.functions import text as T  # noqa: E402
from corvane.operators import chunking  # noqa: E402
from corvane.sources.scratch import bounded_broadcast  # noqa: E402

CONFIG = Path(__file__).with_suffix(".json")
PAGES = "page_id long, url string, html string"
CLEAN = "page_id long, url string, host string, title string, text string, fingerprint string, row long, lang string"
CHUNKS = "page_id long, url string, host string, title string, chunk_number int, start_offset int, end_offset int, chunk_text string, lang string"
MOST_BROADCAST = 100_000
log = logging.getLogger("page_corpus")


def load_config(path: str | Path = CONFIG) -> dict:
    config = json.loads(Path(path).read_text())
    if unknown := set(config) - {"target_chars", "most_chars", "least_chars"}:
        raise ValueError(f"unknown settings in {path}: {sorted(unknown)}")
    if not 0 < config["target_chars"] < config["most_chars"]:
        raise ValueError("target_chars must be above 0 and below most_chars")
    if config["least_chars"] < 1:
        raise ValueError("least_chars must be above 0")
    return config


def clean(pages: DataFrame, least_chars: int) -> DataFrame:
    """Readable pages with their main text; row tells equal rows apart."""
    p = pages.select("page_id", "url", H.host(F.coalesce("url", F.lit(""))).alias("host"), T.title(F.col("html")).alias("title"), H.language(F.col("html")).alias("lang"), F.explode(F.array(H.main_text(F.col("html")))).alias("text"))
    p = p.filter(F.length("text") >= least_chars)
    return p.select("page_id", "url", "host", "title", "text", T.fingerprint(F.col("text")).alias("fingerprint"), F.monotonically_increasing_id().alias("row"), "lang")


def first_of_equal(pages: DataFrame) -> DataFrame:
    """One page of each fingerprint.  Only keys are shuffled to find the others, which are few as a rule and then broadcast."""
    keys = pages.select("fingerprint", "page_id", "url", "row")
    first = keys.groupBy("fingerprint").agg(F.min(F.struct("page_id", "url", "row"))["row"].alias("first"))
    others = keys.join(first, "fingerprint").filter("row <> first").select("row")
    return pages.join(bounded_broadcast(others, MOST_BROADCAST), "row", "left_anti")


def chunked(pages: DataFrame, target: int, most: int) -> DataFrame:
    """Chunks of pages with their facts, in one narrow pass."""
    facts = ("page_id", "url", "host", "title")
    c = pages.select(*facts, "lang", F.posexplode(chunking.chunk_list(F.col("text"), target, most)).alias("n", "c"))
    return c.select(*facts, (F.col("n") + 1).alias("chunk_number"), F.col("c.start").alias("start_offset"), F.col("c.end").alias("end_offset"), F.col("c.text").alias("chunk_text"), "lang")


def run(spark: SparkSession, pages: str, out: str, config: dict) -> dict[str, int]:
    """One whole build; what was read and written."""
    raw = spark.read.schema(PAGES).parquet(pages)
    clean(raw, config["least_chars"]).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/pages")
    readable = spark.read.schema(CLEAN).parquet(f"{out}/pages")
    chunked(first_of_equal(readable), config["target_chars"], config["most_chars"]).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/chunks")
    done = {"pages": raw.count(), "readable": readable.count(), "chunks": output(spark, out).count()}
    log.info("read %(pages)d pages, wrote %(readable)d readable ones and %(chunks)d chunks", done)
    return done


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{out}/chunks")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--pages", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("page_corpus").getOrCreate()
    try:
        run(spark, args.pages, args.out, load_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
