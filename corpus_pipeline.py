"""The corpus pipeline: documents through five stages, each a corpus operator.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcol.llm import bpe, common, decontaminate, quality_rules, simhash, substring_dedup


def _with_length(docs: DataFrame) -> DataFrame:
    """A changed text has a new number of characters."""
    columns = {c.lower() for c in docs.columns}
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep most of their text under the line rules, unchanged."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that with the least id."""
    return simhash.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go."""
    return _with_length(substring_dedup.drop_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words inside benchmark windows; documents of which no word is left go."""
    return _with_length(decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each remaining text."""
    return bpe.report(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: Fingerprints, hashes of tokens and the like are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage returns is written to the shared folder, read again by the next, and deleted when
    that one is written; the last stage's input stays, for its rows are read when the result is."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.delete_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
