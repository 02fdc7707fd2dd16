"""Answers to a table of questions in one plan: each goes the way its route says, all by joins, one row a question."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import answers, routing
from siltstone.operators.tables import cut

#: Semantic hits of a question alone and beside the timetable; fewer than LITTLE send an unknown question to the timetable.
ALONE, BESIDE, LITTLE = 15, 10, 3
FAILED = "Query processing failed: "


def asked_fields(text: Column) -> dict[str, Column]:
    """The timetable's fields that a question names, in lower case; null where it doesn't."""
    return {name: F.nullif(F.lower(F.regexp_extract(text, f"(?i){pattern}", 1)), F.lit("")) for name, pattern in answers.FIELDS.items()}


def timetable_key(fields: dict[str, Column]) -> Column:
    """The fields that are given, with their names, as one text; null if none is."""
    return F.nullif(F.concat_ws("\n", *(F.concat(F.lit(f"{name}="), value) for name, value in fields.items())), F.lit(""))


def timetable_answers(keys: DataFrame, schedules: DataFrame, most: int = 5) -> DataFrame:
    """(key, answer, total) for the asked keys that have entries: the first ``most`` lines, and how many entries there are.

    An entry has a key for each set of its fields, so all questions are answered by one join, and equal ones once.
    """
    own = {name: F.lower(name) for name in answers.FIELDS}
    sets = [dict(kept) for n in range(1, len(own) + 1) for kept in combinations(own.items(), n)]
    whole = lambda kept: reduce(lambda a, b: a & b, (v.isNotNull() for v in kept.values()))
    lines = schedules.select("day", "start_time", answers.schedule_line().alias("line"), F.explode(F.array_compact(F.array(*[F.when(whole(kept), timetable_key(kept)) for kept in sets]))).alias("key"))
    met = lines.join(keys.where("key is not null").distinct(), "key", "left_semi")
    return answers.format_rows(met, "key", ["day", "start_time", "line"], most).join(met.groupBy("key").agg(F.count("*").alias("total")), "key")


def answer_questions(questions: DataFrame, schedules: DataFrame, search: Callable[[DataFrame], DataFrame], canned: Callable[[Column], Column] = routing.canned_answer, classify=None) -> DataFrame:
    """One row for each question (qid, text): intent_type, query_type, approach, fallback, answer, sources, result_count, error.

    Questions with a canned answer get it. Structured ones are looked up in the timetable, and searched for if it has nothing;
    hybrid ones get both; semantic and unknown ones are searched for, and an unknown one with fewer than LITTLE hits goes
    to the timetable. ``search`` takes (qid, text) and returns (qid, key, text, score, rank) of the best ALONE hits at least;
    ``sources`` are their keys in order. ``answer`` is null where there are only sources. A null text has an error. schedules:
    class_group, subject, room, day, start_time, end_time. qids are unique.
    """
    asked = routing.analyse(routing.classify(questions.select("qid", "text").where("text is not null"), model=classify))
    asked = asked.withColumns({"canned": canned(F.col("intent_type")), "key": timetable_key(asked_fields(F.col("text")))})
    asked = cut(asked.select("qid", "text", "intent_type", "query_type", "canned", "key"))
    open_ = asked.where("canned is null")
    structured = cut(timetable_answers(open_.where("query_type <> 'semantic'").select("key"), schedules))
    routed = open_.join(structured, "key", "left")
    done = (F.col("query_type") == "structured") & F.col("total").isNotNull()
    hits = cut(search(routed.where(~done).select("qid", "text")).where(F.col("rank") <= ALONE))
    few = F.when(F.col("query_type") == "hybrid", BESIDE).otherwise(ALONE)
    counted = hits.join(asked.select("qid", few.alias("most")), "qid").where("rank <= most")
    sources = counted.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("sources"))
    both = open_.where("query_type = 'hybrid'")
    near = answers.relevant(hits.join(both.select("qid"), "qid", "left_semi"), "qid", ["rank"])
    mixed = answers.combine(both, both.join(structured, "key").select("qid", "answer"), near, "qid")
    out = asked.join(structured, "key", "left").join(sources, "qid", "left").join(mixed, "qid", "left")
    n, total = F.coalesce(F.size("sources"), F.lit(0)), F.coalesce("total", F.lit(0))
    n = F.when(F.col("sources").isNull(), 0).otherwise(n)
    is_canned, hybrid = F.col("canned").isNotNull(), F.col("query_type") == "hybrid"
    fell = (F.col("query_type") == "unknown") & (n < LITTLE) & (total > 0)
    by_table = ~is_canned & (((F.col("query_type") == "structured") & (total > 0)) | fell)
    answered = out.select(
        "qid", "intent_type", "query_type",
        F.when(is_canned, "canned").when(by_table, "structured").when(hybrid, "hybrid").otherwise("semantic").alias("approach"),
        F.when(is_canned, None).when(fell, "structured").when((F.col("query_type") == "structured") & ~by_table, "semantic").alias("fallback"),
        F.when(is_canned, F.col("canned")).when(by_table, F.col("answer")).when(hybrid, F.col("response")).alias("answer"),
        F.when(is_canned | by_table | F.col("sources").isNull(), F.array().cast(sources.schema["sources"].dataType)).otherwise(F.col("sources")).alias("sources"),
        F.when(is_canned, 0).when(by_table, total).when(hybrid, total + n).otherwise(n).cast("long").alias("result_count"), F.lit(None).cast("string").alias("error"),
    )
    failed = questions.where("text is null").select("qid", F.lit(f"{FAILED}no question").alias("error"), F.lit("none").alias("approach"), F.lit(0).cast("long").alias("result_count"))
    return answered.unionByName(failed, allowMissingColumns=True)
