"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import near_dup, packing, quality, secret_scan, suffix_dedup
from tamarack.llm.common import durable
from tamarack.llm.queries import WORD_TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those that score below 0.7.

    Null and empty texts are scored like others, repeated rows by their text alone. Without labels every score is 0.5
    and no document stays. Further columns, whatever their names, are kept. No rows give no rows.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one with the smallest id stays.

    Texts without words are like no other and stay; of rows with one id one stays; null ids stay. Further columns are
    kept. No rows give no rows.
    """
    return near_dup.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that stand earlier in the corpus go; n_chars follows the text.

    Every document stays, if need be with an empty text; a null text becomes an empty one, null ids count as last, of
    repeated rows the first keeps its text. Very long texts are searched whole. Further columns are kept.
    """
    return _measured(suffix_dedup.without_repeats(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text.

    Null and empty texts stay as they are, repeated rows and null ids too. Whole texts are scanned. Further columns are
    kept. No rows give no rows.
    """
    return _measured(secret_scan.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; null and empty texts are the end id alone."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality", keep_good), ("near duplicates", one_of_each), ("repeated passages", without_repeats), ("secrets", without_secrets), ("packing", packed)]

#: SQL has none of these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
