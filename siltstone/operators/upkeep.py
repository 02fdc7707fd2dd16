"""Manifests, caches, statistics and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import vectors as V


def stale_files(files: DataFrame, manifest: DataFrame, model: str) -> DataFrame:
    """files (source_file, mtime) with why each must be embedded anew, null where it needn't: missing, newer or other model."""
    known = manifest.select("source_file", F.col("last_updated").alias("done"), F.col("model").alias("with_model"))
    why = F.when(F.col("done").isNull(), "missing").when(F.col("mtime") > F.col("done"), "newer").when(F.col("with_model") != model, "model")
    return files.join(known, "source_file", "left").select(*files.columns, why.alias("stale"))


def integrity(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """manifest entries against stored vectors (source_file, model, n): missing, count or model that differ, else ok."""
    own = stored.select("source_file", F.col("model").alias("own_model"), F.col("n").alias("own_n"))
    state = F.when(F.col("own_n").isNull(), "missing").when(F.col("own_n") != F.col("chunk_count"), "count").when(F.col("own_model") != F.col("model"), "model").otherwise("ok")
    return manifest.join(own, "source_file", "left").select("source_file", state.alias("state"))


def orphans(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored files that no manifest entry names."""
    return stored.join(manifest.select("embeddings_file"), "embeddings_file", "left_anti")


def current(files: DataFrame, index: DataFrame) -> DataFrame:
    """files that are new or newer than what the index has."""
    known = index.select(F.col("doc_id").alias("known"), F.col("last_modified").alias("seen"))
    return files.join(known, (F.col("doc_id") == F.col("known")) & (F.col("mtime") <= F.col("seen")), "left_anti")


def cached_answers(questions: DataFrame, cache: DataFrame, now: Column, least: float = 0.97, ttl: int = 3600) -> DataFrame:
    """The first cached answer of each question (qid, intent, v): same intent, not expired, cosine ``least`` or more.

    cache: v, answer, ts, intent, of any size: which side is broadcast, if any, is left to the sizes that Spark sees.
    """
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("ts") < ttl).select("intent", F.col("v").alias("cv"), "answer", "ts")
    near = questions.join(live, "intent").where(V.cosine(V.doubles(F.col("v")), V.doubles(F.col("cv"))) >= least)
    return near.groupBy("qid").agg(F.min_by("answer", "ts").alias("answer"))


def evict(cache: DataFrame, now: Column, ttl: int = 3600, most: int = 128) -> DataFrame:
    """The cache without expired entries and, over ``most``, without the oldest."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("ts") < ttl).orderBy(F.desc("ts"), "answer").limit(most)


def by_template(rows: DataFrame, templates: DataFrame, floor: float = 0.6, default: str = "factual_query") -> DataFrame:
    """rows (id, v) with the label of the most similar template (label, tv), the default below the floor."""
    scored = rows.join(F.broadcast(templates)).withColumn("s", V.cosine(V.doubles(F.col("v")), V.doubles(F.col("tv"))))
    best = scored.groupBy("id").agg(F.max("s").alias("score"), F.max_by("label", F.struct("s", "label")).alias("label"))
    return best.select("id", "score", F.when(F.col("score") < floor, default).otherwise(F.col("label")).alias("intent"))


def evaluate(results: DataFrame) -> DataFrame:
    """results with matches and a score: a quarter each for intent and topic, half for the share of expected parts."""
    parts = F.col("expected_answer_contains")
    has = F.size(F.filter(parts, lambda p: F.contains(F.lower("response"), F.lower(p))))
    share = F.when(F.size(parts) > 0, has / F.size(parts)).otherwise(1.0)
    out = results.withColumns({"intent_match": F.col("actual_intent") == F.col("expected_intent"), "topic_match": F.col("actual_topic") == F.col("expected_topic"), "content_share": share})
    score = 0.25 * F.col("intent_match").cast("int") + 0.25 * F.col("topic_match").cast("int") + 0.5 * F.col("content_share")
    return out.withColumn("score", score).withColumn("band", F.when(F.col("score") >= 0.7, "good").when(F.col("score") >= 0.4, "fair").otherwise("poor"))


def evaluation_report(scored: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return scored.agg(F.count("*").alias("questions"), mean("score").alias("mean_score"), mean("intent_match").alias("intent_accuracy"), mean("topic_match").alias("topic_accuracy"), mean("content_share").alias("content_accuracy"))


def run_metrics(runs: DataFrame, by: str) -> DataFrame:
    """runs (success, seconds) by worker: how many, percent that succeeded, total and mean time."""
    return runs.groupBy(by).agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("success").cast("double")), 2).alias("success_percent"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"))


def collection_statistics(chunks: DataFrame) -> DataFrame:
    """Count, mean score (missing: 0) and share of sentence-based chunks over the whole collection."""
    return chunks.agg(F.count("*").alias("chunks"), F.avg(F.coalesce("information_score", F.lit(0.0))).alias("mean_score"), F.avg(F.coalesce(F.col("semantic_chunking").cast("double"), F.lit(0.0))).alias("semantic_share"))


def retryable(results: DataFrame) -> DataFrame:
    """Failed results that may be tried again: all but timeouts."""
    return results.where(~F.col("success") & ~F.contains(F.lower(F.coalesce("error", F.lit(""))), F.lit("timeout")))
