"""Answers from timetable rows and search hits: lines, combination, labels, templates from question to SQL, statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import lexicons as L

NOTHING = "No matching schedule information found."
NO_ANSWER = "I couldn't find specific information to answer your question."


def schedule_line() -> Column:
    """One line for a timetable row; a row without subject or day lists what it has."""
    c = F.col
    said = lambda x, default="": F.coalesce(c(x), F.lit(default))
    times = F.when((said("start_time") != "") & (said("end_time") != ""), F.concat(F.lit(" from "), c("start_time"), F.lit(" to "), c("end_time"))).otherwise("")
    room = F.when(said("room") != "", F.concat(F.lit(" in "), c("room"))).otherwise("")
    line = F.concat(said("class_group"), F.lit(" has "), c("subject"), F.lit(" on "), c("day"), times, room)
    listed = F.concat_ws(", ", *(F.concat(F.lit(f"{x}: "), c(x)) for x in ("class_group", "subject", "day", "start_time", "end_time", "room")))
    return F.when(c("subject").isNotNull() & c("day").isNotNull(), line).otherwise(listed)


def format_rows(rows: DataFrame, by: str, order: list[str], most: int = 5) -> DataFrame:
    """(by, answer): the first ``most`` lines of each group and how many there are. rows: by, line and order's columns."""
    top = rows.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("n") <= most)
    lines = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("first"))
    found = lines.join(rows.groupBy(by).agg(F.count("*").alias("total")), by).withColumn("lines", F.transform("first", lambda x: x["line"]))
    rest = F.when(F.col("total") > most, F.concat(F.lit(f"\n\n(Showing first {most} of "), F.col("total"), F.lit(" results)"))).otherwise("")
    return found.select(by, F.concat(F.array_join("lines", "\n"), rest).alias("answer"))


def relevant(hits: DataFrame, by: str, order: list[str], floor: float = 0.7, among: int = 3, most: int = 2, chars: int = 200) -> DataFrame:
    """Hits of each group that are among its first ``among``, above the floor and among the first ``most`` such."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order))
    top = hits.withColumn("place", rank).where((F.col("place") <= among) & (F.col("score") > floor))
    kept = top.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy("place"))).where(F.col("n") <= most)
    return kept.withColumn("text", F.substring("text", 1, chars)).drop("place")


def combine(asked: DataFrame, structured: DataFrame, hits: DataFrame, by: str) -> DataFrame:
    """(by, response): the timetable's answer, then the relevant hits as points; one of the two alone, or a default."""
    points = hits.where(F.col("text") != "").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("points"))
    joined = asked.select(by).distinct().join(structured.select(by, "answer"), by, "left").join(points, by, "left")
    one = F.when(F.col("answer") != "", F.concat(F.lit("**Schedule Information:**\n"), F.col("answer")))
    two = F.when(F.col("points").isNotNull(), F.concat(F.lit("\n**Additional Context:**\n"), F.array_join(F.transform("points", lambda x: F.concat(F.lit("• "), x["text"], F.lit("..."))), "\n")))
    both = F.concat_ws("\n", one, two)
    return joined.select(by, F.when(both == "", NO_ANSWER).otherwise(both).alias("response"))


def approach(structured: Column, real_time: Column) -> Column:
    """What an answer was made from."""
    both = F.when(structured & real_time, "structured_schedule_with_real_time").when(structured, "structured_schedule")
    return both.when(real_time, "vector_with_real_time").otherwise("vector_only")


def source_limit(structured: Column, real_time: Column) -> Column:
    """How many chunks an answer takes beside richer sources."""
    return F.when(structured, 5).when(real_time, 10).otherwise(15)


#: Parts of a question that a template understands: a column of the timetable, and a pattern for its value.
FIELDS = {"class_group": r"\b([A-Za-z]{2,6}\s?\d[A-Za-z]?)\b", "day": rf"\b({'|'.join(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'])})\b", "room": r"\b((?:room|lab|lt)\s\d+)\b"}


def to_sql(text: Column, table: str = "schedules") -> Column:
    """A SELECT for a question, by the parts it names; null for a question that names none."""
    conditions = []
    for name, pattern in FIELDS.items():
        value = F.lower(F.regexp_extract(text, f"(?i){pattern}", 1))
        conditions.append(F.when(value != "", F.concat(F.lit(f"lower({name}) = '"), value, F.lit("'"))))
    where = F.concat_ws(" AND ", *conditions)
    return F.when(where != "", F.concat(F.lit(f"SELECT * FROM {table} WHERE "), where, F.lit(" ORDER BY day, start_time")))


def ask_schedule(spark: SparkSession, question: str, schedules: DataFrame, model=None) -> DataFrame:
    """Timetable rows for a question, by the model's SQL if it gives a SELECT, else by the template; none if neither."""
    from siltstone.operators.schedule import run_select

    sql = spark.range(1).select(to_sql(F.lit(question), "{schedules}").alias("q")).first().q
    if model is not None and re.match(r"(?i)\s*select\b", given := model(question) or ""):
        sql = given
    return run_select(spark, sql, schedules=schedules) if sql else schedules.limit(0)


def answer_schedule(rows: DataFrame) -> DataFrame:
    """One row: the formatted answer."""
    found = format_rows(rows.withColumns({"line": schedule_line(), "one": F.lit(0)}), "one", ["day", "start_time", "class_group", "room"])
    return found.agg(F.coalesce(F.first("answer"), F.lit(NOTHING)).alias("answer"))


def routing_statistics(spark: SparkSession) -> DataFrame:
    """What the router knows."""
    counts = {
        "structured_pattern_categories": len(L.STRUCTURED_PATTERNS), "total_structured_patterns": sum(map(len, L.STRUCTURED_PATTERNS.values())),
        "schedule_entity_patterns": len(L.SCHEDULE_ENTITIES), "semantic_keywords": len(L.SEMANTIC_WORDS),
    }
    return spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in counts.items()), F.lit(True).alias("supports_hybrid_queries"), F.lit(True).alias("fallback_available"))


def cache_statistics(cache: DataFrame, now: Column, ttl: int = 300) -> DataFrame:
    """Entries of a cache (ts), and those younger than ttl seconds, whole days counted in."""
    return cache.agg(F.count("*").alias("total_cached_queries"), F.count_if(F.unix_timestamp(now) - F.unix_timestamp("ts") < ttl).alias("valid_cached_entries"), F.lit(ttl).cast("long").alias("cache_ttl_seconds"))


def last_by_url(hits: DataFrame, order: str, most: int) -> DataFrame:
    """The last hit of each address, the most relevant first; a null relevance counts as none."""
    last = hits.groupBy("url").agg(F.max_by(F.struct(*[c for c in hits.columns if c != "url"]), order).alias("hit")).select("url", "hit.*")
    return last.orderBy(F.coalesce("relevance_score", F.lit(0.0)).desc(), "url").limit(most)
