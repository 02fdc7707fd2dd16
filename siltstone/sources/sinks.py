"""Sinks: chunk files, indexes with one row a key, and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of the chunks with a text; Spark's committer makes the write whole or nothing."""
    chunks.where(F.regexp_replace("text", r"^\s+|\s+$", "") != "").write.mode("overwrite").json(path)


def write_texts(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", "text").write.mode("overwrite").parquet(path)


def insert_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table and those new rows whose key it hasn't."""
    return table.unionByName(new.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by ``order``, new rows included."""
    both = table.unionByName(new)
    return both.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("nth = 1").drop("nth")


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vectors by model."""
    rows.write.mode("overwrite").partitionBy("model").parquet(path)


def delete_document(doc_id: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without a document's rows."""
    return [t.where(~F.col("doc_id").eqNullSafe(doc_id)) for t in tables]
