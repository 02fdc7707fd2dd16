"""Timetable entries from grids of cells (sheet, row, col, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import lexicons as L
from siltstone.functions import text as X


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """What a pattern matches first, null if nothing."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def likelihood(c: Column) -> Column:
    """How much a text looks like a timetable: matches of each indicator, three each at most."""
    return X.total(F.least(X.count(c, p), F.lit(3)) for p in L.SCHEDULE_INDICATORS)


def detect(docs: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """docs with is_schedule and its confidence: spreadsheets by their name, others by likelihood over 5."""
    lower = F.lower(F.col(name))
    by_name = F.rlike(lower, F.lit(r"\.xlsx?$")) & X.any_of(lower, ["schedule", "timetable", "class"])
    score = likelihood(F.col(text))
    return docs.withColumn("is_schedule", by_name | (score > 5)).withColumn("confidence", F.when(by_name, 0.9).otherwise(F.least(F.lit(1.0), score / 10)))


def time_slot(c: Column) -> Column:
    """HH:MM-HH:MM, null if there is no span of times."""
    part = [F.regexp_extract(c, L.TIME_RANGE, i) for i in range(1, 5)]
    return F.when(F.rlike(c, F.lit(L.TIME_RANGE)), F.concat(F.lpad(part[0], 2, "0"), F.lit(":"), part[1], F.lit("-"), F.lpad(part[2], 2, "0"), F.lit(":"), part[3]))


def weekday(c: Column) -> Column:
    return reduce(lambda w, d: F.when(F.contains(F.lower(c), F.lit(d.lower())), d).otherwise(w), reversed(L.DAYS), F.lit(None).cast("string"))


def class_header(c: Column) -> Column:
    """The class group and semester that a header names, null without both."""
    term = rf"{L.MONTH}(?:\s*[-–]\s*{L.MONTH})?\s+20\d{{2}}"
    forms = [(rf"(?i)([A-Z]{{2,6}}\s+\d[A-Z])\s+.*?({term})", True), (rf"(?i)\b(\d[A-Z])\b.*?({term})", True), (rf"(?i)((?:Year|Yr)\s+\d)\s+.*?({term})", False)]
    each = [F.when(F.rlike(c, F.lit(p)), F.struct((F.upper(found(c, p, 1)) if up else found(c, p, 1)).alias("class_group"), found(c, p, 2).alias("semester"))) for p, up in forms]
    return F.coalesce(*each)


def class_of_sheet(name: Column) -> Column:
    return F.upper(found(name, r"(?i)([A-Z]{2,6}\s*\d[A-Z])", 1))


def session_type(c: Column) -> Column:
    return F.when(X.any_of(F.lower(c), ["lab", "laboratory", "practical"]), "lab").otherwise("lecture")


def parse_cell(c: Column) -> Column:
    """unit_code, room, instructor, subject and session_type of a cell; null without both a code and a room."""
    code = F.replace(found(c, L.UNIT_CODE, 1), F.lit(" "), F.lit(""))
    room = F.coalesce(*(found(c, f"(?i){p}") for p in L.ROOM_PATTERNS))
    cut = "(?i)(?:" + "|".join(L.ROOM_PATTERNS) + r")|(?:ICS|HED|MATH|STAT)\s*\d{4}"
    cell = F.struct(
        code.alias("unit_code"), room.alias("room"), F.coalesce(found(c, L.INSTRUCTOR), F.lit("Unknown Instructor")).alias("instructor"),
        X.strip(F.element_at(F.split(c, cut), 1)).alias("subject"), session_type(c).alias("session_type"), F.lit(0.8).alias("confidence"),
    )
    blank = F.upper(X.strip(c)).isin("", "NAN", "NONE")
    return F.when(~blank & code.isNotNull() & room.isNotNull(), cell)


def fill_merged(grid: DataFrame, ranges: DataFrame) -> DataFrame:
    """The grid with each merged range (sheet, r0, c0, r1, c1) filled from its first cell."""
    first = grid.join(ranges, "sheet").where("row = r0 and col = c0").select("sheet", "r0", "c0", "r1", "c1", "value")
    filled = first.select("sheet", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1", "value").select("sheet", "row", F.explode(F.sequence("c0", "c1")).alias("col"), F.col("value").alias("merged"))
    return grid.join(filled, ["sheet", "row", "col"], "full_outer").select("sheet", "row", "col", F.coalesce("merged", "value").alias("value"))


def extract(grid: DataFrame, header_rows: int = 15) -> DataFrame:
    """Timetable entries of grids.

    The times are those of the first row, among the first ``header_rows``, with more than one span. A row that names a
    class group and semester holds for the rows below it; the day stands in a row's first cell; other cells are
    entries where they name a unit code and a room.
    """
    cells = grid.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("string"))
    slots = cells.where(F.col("row") < header_rows).withColumn("slot", time_slot(F.col("value"))).where("slot is not null")
    rows = slots.groupBy("sheet", "row").agg(F.count("*").alias("n")).where("n > 1").groupBy("sheet").agg(F.min("row").alias("row"))
    times = slots.join(rows, ["sheet", "row"]).select("sheet", "col", "slot", F.col("row").alias("head"))
    lines = cells.groupBy("sheet", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), " ").alias("line"), F.min_by("value", "col").alias("first"))
    down = W.partitionBy("sheet").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("header", F.last(class_header(F.col("line")), ignorenulls=True).over(down))
    lines = lines.withColumn("own", class_header(F.col("line")).isNotNull()).withColumn("day", weekday(F.col("first")))
    placed = cells.join(lines.where("day is not null and not own").select("sheet", "row", "header", "day"), ["sheet", "row"]).join(times, ["sheet", "col"]).where("row > head")
    parsed = placed.withColumn("cell", parse_cell(F.col("value"))).where("cell is not null")
    group = F.coalesce(F.col("header.class_group"), class_of_sheet(F.col("sheet")), F.col("sheet"))
    span = F.split("slot", "-")
    return parsed.select(
        group.alias("class_group"), "cell.subject", "cell.unit_code", "cell.room", "day", F.coalesce(span[0], F.lit("00:00")).alias("start_time"), F.coalesce(span[1], F.lit("00:00")).alias("end_time"),
        "cell.instructor", "cell.session_type", F.coalesce(F.col("header.semester"), F.lit("Unknown")).alias("semester"), F.col("value").alias("raw_content"), "cell.confidence",
    )
