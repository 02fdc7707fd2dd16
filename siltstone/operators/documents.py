"""The document index: lookups, statistics, missing files and evaluation questions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "doc_id string, file_name string, file_path string, doc_type string, num_chunks int, file_size long, last_modified timestamp"


def load(spark: SparkSession, path: str, schema: str = INDEX) -> DataFrame:
    """An index or manifest; an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def find(index: DataFrame, part: str) -> DataFrame:
    """Documents with the part in their name or kind, letters of either case."""
    low = part.lower()
    return index.where(F.contains(F.lower("file_name"), F.lit(low)) | F.contains(F.lower("doc_type"), F.lit(low)))


def of_type(index: DataFrame, doc_type: str) -> DataFrame:
    return index.where(F.col("doc_type") == doc_type)


def get(index: DataFrame, doc_id: str) -> DataFrame:
    return index.where(F.col("doc_id") == doc_id)


def by_type(index: DataFrame) -> DataFrame:
    return index.groupBy("doc_type").agg(F.count("*").alias("documents"), F.sum("num_chunks").alias("chunks"), F.round(F.sum("file_size") / 1048576, 2).alias("megabytes"))


def matching(pages: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Rows of which a column matches the pattern, letters of either case."""
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.rlike(F.col(c), F.lit(f"(?i){pattern}"))
    return pages.where(hit)


def evaluation_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from CSV; the expected parts stand in a list in brackets, read as JSON and never run."""
    schema = "id string, query string, expected_intent string, expected_topic string, expected_answer_contains string, notes string"
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).csv(path)
    parts = F.from_json(F.translate("expected_answer_contains", "'", '"'), "array<string>")
    return rows.withColumn("expected_answer_contains", F.coalesce(parts, F.array().cast("array<string>")))


def evaluation_template(spark: SparkSession) -> DataFrame:
    rows = [
        ("1", "What are the admission requirements?", "admission_query", "admissions", "['requirement']", ""),
        ("2", "How much is the fee?", "fees_query", "fees", "['fee']", ""),
        ("3", "Explain the library policy", "explanation_query", "policies", "['library', 'policy']", ""),
    ]
    return spark.createDataFrame(rows, "id string, query string, expected_intent string, expected_topic string, expected_answer_contains string, notes string")
