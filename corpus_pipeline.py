"""The corpus pipeline: documents through five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.bpe import encode_documents
from siltstone.llm.decontaminate import drop_leaks
from siltstone.llm.language_id import keep_languages
from siltstone.llm.minhash_dedup import keep_first
from siltstone.llm.store import save
from siltstone.llm.substring_dedup import cut_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return keep_languages(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_first(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents are cut from all but the first."""
    return cut_repeats(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return drop_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and what they decode to, beside the columns of documents."""
    return encode_documents(spark, docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages aren't expressible in SQL; the tests of their operators hold each of these against brute force.
ORACLE_SQL = None
