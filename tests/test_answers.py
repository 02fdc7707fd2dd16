import pytest
from pyspark.sql import functions as F

from siltstone.operators import answers
from siltstone.operators.schedule import run_select
from siltstone.plans.engine import Engine


def test_only_given_views_can_be_read(spark, sf):
    rows = spark.createDataFrame([("G1", "Monday"), ("G2", None)], "class_group string, day string")
    assert run_select(spark, "SELECT 'data set x' AS x, day FROM {s} WHERE day = 'Monday';", s=rows).collect() == [("data set x", "Monday")]
    assert run_select(spark, "WITH d AS (SELECT * FROM {s}) SELECT count(*) AS n FROM d", s=rows).first().n == 2
    spark.range(3).createOrReplaceTempView("other")
    for sql in (
        "SELECT upper(day) AS d, count(*) AS n FROM {s} GROUP BY upper(day) HAVING count(*) >= 1 ORDER BY 1 LIMIT 5", "SELECT a.day FROM {s} AS a JOIN {s} AS b ON a.class_group = b.class_group WHERE a.day LIKE 'M%' OR a.day IS NULL AND NOT a.day IN ('x', 'y')",
        "SELECT * FROM {s} WHERE day IN (SELECT day FROM {s}) AND EXISTS (SELECT 1 FROM {s}) AND class_group BETWEEN 'A' AND 'Z'", "WITH a AS (SELECT * FROM {s}), b AS (SELECT * FROM a) SELECT DISTINCT day FROM b UNION ALL SELECT day FROM a", "SELECT class_group || 'x' AS y, CASE WHEN day = 'Monday' THEN 1 ELSE 2 END AS z, CAST(1 AS STRING) AS w, row_number() OVER (PARTITION BY day ORDER BY class_group) AS n FROM {s}",
        "select * from {s} where lower(day) = 'monday' order by day, class_group",
    ):
        assert run_select(spark, sql, s=rows).collect() is not None
    for sql in (
        f"SELECT * FROM parquet.`{sf}/nation.parquet`", "SELECT reflect('java.lang.Math', 'abs', -7) AS x", "DROP TABLE x", "SELECT java_method('java.lang.Math', 'abs', -7) AS x FROM {s}",
        "SELECT * FROM IDENTIFIER('other')", "WITH other AS (SELECT * FROM other) SELECT * FROM other", "SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', -7) FROM {s}", "SELECT 1 AS x LIMIT (SELECT count(*) FROM other)",
        f"SELECT {', '.join(f'{i} AS c{i}' for i in range(40))}, reflect('java.lang.Math', 'abs', -7) AS x FROM {{s}}", "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "SELECT (SELECT max(x) FROM other) AS y", "SELECT * FROM {s} WHERE EXISTS (SELECT * FROM other)",
        "SELECT * FROM range(3)", "SELECT transform(day) USING 'cat' FROM {s}", "SELECT x.reflect('a') FROM {s} AS x", "SELECT current_user() AS u", "WITH d AS (DELETE FROM {s}) SELECT 1", "SELECT * FROM {s} JOIN other ON true", "SELECT * FROM (SELECT * FROM (SELECT * FROM other))", "SELECT * FROM spark_catalog.default.other",
        "SELECT * FROM other", "INSERT INTO {s} VALUES (1, 2)", "SELECT * FROM {s} WHERE day IN (SELECT day FROM other)", "SET a = b", "SHOW TABLES",
    ):
        with pytest.raises(ValueError):
            run_select(spark, sql, s=rows)
    spark.catalog.dropTempView("other")


def test_answers(spark):
    rows = spark.createDataFrame([("G1", "maths", "Monday", "10:00", "11:00", "R1"), ("G1", None, None, None, None, "R2")], "class_group string, subject string, day string, start_time string, end_time string, room string")
    lines = [r.line for r in rows.select(answers.schedule_line().alias("line")).collect()]
    assert lines == ["G1 has maths on Monday from 10:00 to 11:00 in R1", "class_group: G1, room: R2"]
    assert answers.answer_schedule(rows.limit(0)).first().answer == answers.NOTHING
    many = spark.range(7).selectExpr("1 as g", "id", "concat('l', id) as line")
    assert answers.format_rows(many, "g", ["id"]).first().answer == "l0\nl1\nl2\nl3\nl4\n\n(Showing first 5 of 7 results)"
    found = answers.ask_schedule(spark, "what has g1 on monday", rows)
    assert found.count() == 1 and answers.ask_schedule(spark, "anything", rows).count() == 0
    assert answers.ask_schedule(spark, "anything", rows, lambda q: "DELETE FROM x").count() == 0
    hits = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.71), (1, "c", 0.5), (2, "d", 0.2)], "q int, text string, score double")
    kept = answers.relevant(hits, "q", [F.desc("score")])
    assert {(r.q, r.text, r.n) for r in kept.collect()} == {(1, "a", 1), (1, "b", 2)}
    out = {r.q: r.response for r in answers.combine(hits, spark.createDataFrame([], "q int, answer string"), kept, "q").collect()}
    assert out == {1: "\n**Additional Context:**\n• a...\n• b...", 2: answers.NO_ANSWER}


def test_a_second_corpus_joins_the_first(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.process_texts(spark.createDataFrame([("a", "The library opens at nine in the morning on weekdays."), ("b", "Fees are paid at the office.")], "doc_id string, text string"))
    assert engine.search("library", 2).count() == 2
    old = engine.lexical_index[0]
    engine.process_texts(spark.createDataFrame([("b", "Fees are paid online."), ("c", "The swimming pool opens in summer.")], "doc_id string, text string"))
    assert sorted(r.text for r in engine.table("chunks").collect()) == ["Fees are paid online.", "The library opens at nine in the morning on weekdays.", "The swimming pool opens in summer."]
    assert engine.lexical_index[0] is not old
    engine.delete_document("a")
    assert {r.doc_id for r in engine.table("index").collect()} == {"b", "c"}
