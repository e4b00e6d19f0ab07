"""The training-data queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, hard_negatives, html_text, jaccard_join, mixing, packing, pii, quality_classifier, quality_rules, simhash, spelling, token_files, toxicity


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(common.read(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "tokens")
    token_files.write_tokens(common.read(spark, sf_dir, "documents"), path)
    return token_files.digest(token_files.read_tokens(spark, path))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, common.read(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, common.read(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(common.read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(common.read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(common.read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compared(common.read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.ORACLES
