"""Streams: incremental ingest of new files, sessions of events and an answer cache that forgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Give each new Parquet file below source to the sink once, and end; the checkpoint remembers what was done."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events of a user in sessions without a longer gap; works on tables and, with a watermark on ts, on streams."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("started"), "n_events")


def latest_answers(answers: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """A stream of answers (ts, intent, question, answer) without repeats of a question within the time to live."""
    return answers.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["intent", "question"])
