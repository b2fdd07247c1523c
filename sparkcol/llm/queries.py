"""The corpus operators as queries over whole tables, and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, language_id, quality_model, quality_rules, sharding, simhash, substring_dedup, warc
from .common import table
from .oracles import ORACLES


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_archives(table(spark, sf_dir, "pages"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_sentences", "n_removed", "text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_html_text,
        op3_decontamination,
        op4_substring_dedup,
        op5_bpe,
        op6_language_id,
        op7_quality_rules,
        op8_quality_model,
        op9_sharding,
        op10_simhash,
    )
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
