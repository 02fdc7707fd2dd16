"""The timetable store: queries, statistics, free rooms, sentences and guarded SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ["day", "start_time"]


def contains_like(c: Column, part: str) -> Column:
    """Whether the column contains the part, letters of either case; % and _ in the part stand for themselves."""
    safe = re.sub(r"([\\%_])", r"\\\1", part)
    return F.ilike(c, F.lit(f"%{safe}%"))


def class_schedule(schedules: DataFrame, class_group: str, day: str | None = None) -> DataFrame:
    rows = schedules.where(F.col("class_group") == class_group)
    return (rows if day is None else rows.where(F.col("day") == day)).orderBy(*ORDER)


def instructor_schedule(schedules: DataFrame, name: str) -> DataFrame:
    return schedules.where(contains_like(F.col("instructor"), name)).orderBy(*ORDER)


def room_schedule(schedules: DataFrame, room: str) -> DataFrame:
    return schedules.where(contains_like(F.col("room"), room)).orderBy(*ORDER)


def free_rooms(schedules: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Rooms without an entry that overlaps the span on the day."""
    busy = schedules.where((F.col("day") == day) & ~((F.col("end_time") <= start) | (F.col("start_time") >= end))).select("room").distinct()
    return schedules.select("room").distinct().join(busy, "room", "left_anti").orderBy("room")


def free_at(schedules: DataFrame, day: str, time: str) -> DataFrame:
    """Rooms without an entry at the moment."""
    busy = schedules.where((F.col("day") == day) & (F.col("start_time") <= time) & (F.col("end_time") > time)).select("room").distinct()
    return schedules.select("room").distinct().join(busy, "room", "left_anti").orderBy("room")


def statistics(schedules: DataFrame) -> DataFrame:
    named = {"classes": "class_group", "subjects": "subject", "rooms": "room", "instructors": "instructor"}
    return schedules.agg(F.count("*").alias("entries"), *(F.countDistinct(c).alias(n) for n, c in named.items()))


def with_defaults(entries: DataFrame, doc_id: str, now: Column) -> DataFrame:
    """Entries ready to be stored: confidence 1.0 and the time where missing, and their document."""
    return entries.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "extraction_timestamp": F.coalesce("extraction_timestamp", now), "doc_id": F.lit(doc_id), "created_at": now})


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with new rows in place of those of equal key; of several new ones the last by ``seq``."""
    last = new.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).where("nth = 1").drop("nth", "seq")
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def without_document(schedules: DataFrame, doc_id: str) -> tuple[DataFrame, int]:
    """The table without a document's entries, and how many went."""
    gone = F.col("doc_id").eqNullSafe(doc_id)
    return schedules.where(~gone), schedules.where(gone).count()


#: What a statement may be made of: nodes of its parsed plan, expressions in them, and functions by name.
PLANS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedWith UnresolvedRelation OneRowRelation".split()
)
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedOrdinal Alias MultiAlias Literal UnresolvedFunction And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Between In InSubquery Exists ScalarSubquery ListQuery "
    "Like ILike RLike LikeAny LikeAll NotLikeAny NotLikeAll Cast CaseWhen If Add Subtract Multiply Divide Remainder IntegralDivide UnaryMinus UnaryPositive Concat IsNull IsNotNull SortOrder CreateNamedStruct UnresolvedExtractValue "
    "WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame UnboundedPreceding UnboundedFollowing CurrentRow".split()
)
FUNCTIONS = frozenset(
    "count sum min max avg mean first last any_value collect_list collect_set lower upper trim ltrim rtrim length char_length substring substr concat concat_ws replace coalesce nullif ifnull nvl if abs round floor ceil ceiling greatest least "
    "like contains startswith endswith instr locate split regexp_extract regexp_replace regexp_like rlike array_join sort_array size cast int string double date to_date to_timestamp date_format hour minute year month day dayofweek "
    "row_number rank dense_rank lag lead percentile stddev variance count_if isnull isnotnull and or not = == <> != < <= > >= + - * / % || between in".split()
)


def check_plan(plan, views: set[str]) -> None:
    """Raise ValueError unless a parsed plan is made of PLANS, EXPRESSIONS and FUNCTIONS and reads nothing but views.

    A common table expression may be read after its own definition, in the statement that defines it.
    """
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in PLANS:
        raise ValueError("only one SELECT is allowed")
    if kind == "UnresolvedRelation":
        name = [x.lower() for x in seq(plan.multipartIdentifier())]
        if len(name) != 1 or name[0] not in views:
            raise ValueError(f"no such view: {'.'.join(name)}")
    if kind == "UnresolvedWith":
        if plan.allowRecursion():
            raise ValueError("only one SELECT is allowed")
        for relation in seq(plan.cteRelations()):
            check_plan(relation._2(), views)
            views = views | {relation._1().lower()}

    def check(e) -> None:
        name = e.getClass().getSimpleName().rstrip("$")
        if name not in EXPRESSIONS:
            raise ValueError(f"not allowed: {name}")
        if name == "UnresolvedFunction":
            called = [x.lower() for x in seq(e.nameParts())]
            if len(called) != 1 or called[0] not in FUNCTIONS:
                raise ValueError(f"not allowed: {'.'.join(called)}")
        if name in ("InSubquery", "Exists", "ScalarSubquery", "ListQuery"):
            check_plan((e.query() if name == "InSubquery" else e).plan(), views)
        for child in seq(e.children()):
            if child.getClass().getSimpleName() != "ListQuery":
                check(child)

    for e in seq(plan.expressions()):
        check(e)
    for child in seq(plan.children()):
        check_plan(child, views)


def run_select(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """The result of one SELECT over the given views; anything else is refused.

    The statement is parsed, and every node of its plan must be one that a plain query is made of (check_plan).
    """
    statement = sql.strip().rstrip(";").strip()
    names = {k: f"view_{uuid.uuid4().hex}" for k in views}
    for k, name in names.items():
        statement = re.sub(r"\{" + re.escape(k) + r"\}", name, statement)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as e:
        raise ValueError("only one SELECT is allowed") from e
    check_plan(plan, set(names.values()))
    for k, name in names.items():
        views[k].createOrReplaceTempView(name)
    try:
        return spark.sql(statement)
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def sentences(schedules: DataFrame) -> DataFrame:
    """One sentence and id for each entry, for search beside other chunks."""
    c = F.col
    text = F.concat(
        c("class_group"), F.lit(" has "), c("subject"), F.when(F.coalesce(c("unit_code"), F.lit("")) != "", F.concat(F.lit(" ("), c("unit_code"), F.lit(")"))).otherwise(""),
        F.lit(" in "), c("room"), F.lit(" on "), c("day"), F.lit(" from "), c("start_time"), F.lit(" to "), c("end_time"),
        F.when(F.coalesce(c("instructor"), F.lit("")) != "", F.concat(F.lit(" with "), c("instructor"))).otherwise(""),
        F.lit(". This is a "), c("session_type"), F.lit(" session during "), c("semester"), F.lit("."),
    )
    key = F.md5(F.concat_ws("_", "class_group", "day", "start_time", "subject"))
    meta = F.struct(
        F.lit("schedule").alias("doc_type"), F.lit(True).alias("is_schedule"), "class_group", "subject", "day", F.concat_ws("-", "start_time", "end_time").alias("time_slot"),
        "room", "instructor", "semester", "session_type", "unit_code", c("confidence").alias("extraction_confidence"),
    )
    return schedules.select(key.alias("chunk_id"), text.alias("text"), meta.alias("metadata"))


def row_text(sep: str = " | ") -> Column:
    """An entry in one line, without its blank fields."""
    return F.concat_ws(sep, *(F.nullif(F.col(x), F.lit("")) for x in ("day", "start_time", "end_time", "subject", "room", "instructor", "class_group")))
