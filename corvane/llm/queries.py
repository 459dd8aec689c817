"""The registered queries of this package: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import (
    decontamination,
    filter_audit,
    language_id,
    license_scans,
    lm_scoring,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    secret_scans,
    source_mixing,
    token_counts,
)
from corvane.llm.base import fold, table

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels, fold(labels["doc_id"], 5) != 0)
    scored = quality_classifier.quality_scores(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality_classifier.CUT).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.secret_digest(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path(TOKENIZER)
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.licenses(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: a row for each benchmark item that one holds."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "at_word", "n_words", "similarity")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.lm_scores(docs, lm_scoring.train(docs, fold(F.col("doc_id"), 7) != 2))
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold(F.col("doc_id"), 4) != 2)
    said = language_id.predict(docs, model)
    return said.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_quality_rules,
        op3_secret_scans,
        op4_token_counts,
        op5_source_mixing,
        op6_license_scans,
        op7_minhash_near_dedup,
        op8_benchmark_decontamination,
        op9_lm_scoring,
        op10_language_id,
        op11_pii,
        op12_filter_audit,
    )
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op3_secret_scans": secret_scans.ORACLE_SQL,
    "op6_license_scans": license_scans.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
