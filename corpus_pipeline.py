"""Corpus pipeline: stages over documents, each of which reads what its predecessor wrote.

Documents that the quality classifier rejects go; one document of each near-duplicate group stays; documents
that hold a benchmark item go; secrets are masked in the texts; what is left is mixed to target weights.

Cases: empty tables give an empty result; null texts count as empty ones and are judged like them; rows of null ids are
no copies of each other; of repeated rows one stays; without labels of both kinds nothing is rejected; each stage states
its ties and odd inputs in its operator's module.  A stage begins by releasing what the one before left in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, near_dedup, quality_classifier, secret_scans, source_mixing
from corvane.llm.base import fold, stash, table
from corvane.sources.scratch import release


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels, fold(labels["doc_id"], 5) != 0)
    return quality_classifier.good_documents(docs, model)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return near_dedup.deduplicated(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    masked = secret_scans.redacted(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """The shares of the documents in the mix; the mix itself is written to path (else to the shared folder)."""
    release(spark)
    return source_mixing.mix(docs, path=path)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("source mixing", mix_sources),
]
#: SQL can express neither the classifier's fit nor the permutations of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """What the last stage returns; the blocks of the mix are written to path, if one is given."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir, path) if stage is mix_sources else stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stash(docs, f"stage-{n + 1}")
    return docs
