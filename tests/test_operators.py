import io
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import chunking, dedup, memory, routing, schedule, upkeep
from siltstone.sources import files, sinks


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab. \n!?,;", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_splitter_bounds_and_words(text, size, overlap):
    chunks = chunking.split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))


def test_splitter_cases():
    assert chunking.split_text("", 10, 2) == []
    assert chunking.split_text("short", 10, 2) == ["short"]
    assert chunking.split_text("a" * 25, 10, 0) == ["a" * 10, "a" * 10, "a" * 5]
    assert chunking.split_text("one two three four", 9, 0) == ["one two", "three", "four"]


def test_unique_sentences(spark):
    row = spark.range(1).select(dedup.unique_sentences(F.array(F.lit("The quick brown fox jumps over.")), F.array(F.lit("the quick brown fox jumps over."), F.lit("short"), F.lit("A wholly different sentence stands here."))).alias("s")).first()
    assert row.s == ["A wholly different sentence stands here."]


def test_delete_document(spark):
    rows = spark.createDataFrame([("m", ["1_0000", "2_0000"]), ("n", ["1_0001"])], "chunk_id string, merged_from array<string>")
    assert [(r.chunk_id, r.merged_from) for r in dedup.delete_document(rows, "1").collect()] == [("m", ["2_0000"])]


def test_intents(spark):
    asked = ["hello", "thanks, got it", "How do I apply for admission?", "what is the weather", "", "explain this"]
    found = [r.i.intent_type for r in spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "n int, q string").select("n", routing.intent(F.col("q")).alias("i")).orderBy("n").collect()]
    assert found == ["general_chat", "feedback", "admission_query", "factual_query", "general_chat", "explanation_query"]


def test_memory_resolves_the_latest_name(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Tell me about Jane Doe"), (1, 1, "assistant", "She teaches MATH 1101.")], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "where is she"), (2, "what now")], "conv_id long, question string")
    got = {r.conv_id: r for r in memory.context(turns, asked).collect()}
    assert got[1].context_is_relevant and got[1].resolved == "MATH 1101"
    assert not got[2].memory_available and not got[2].context_is_relevant


def test_only_select(spark):
    import pytest

    assert schedule.run_select(spark, "select 1 as x").first().x == 1
    for bad in ("drop table x", "select 1; select 2", "with a as (select 1) insert into b select * from a"):
        with pytest.raises(ValueError):
            schedule.run_select(spark, bad)


def test_cache_forgets(spark):
    now = F.timestamp_seconds(F.lit(10_000))
    cache = spark.range(200).select(F.timestamp_seconds(F.col("id") + 9_000).alias("ts"), F.col("id").cast("string").alias("answer"))
    assert upkeep.evict(cache, now, ttl=900).count() == 99
    assert upkeep.evict(cache, now, ttl=5000).count() == 128


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, n int")
    assert sorted(map(tuple, sinks.upsert(old, new, "k", "n").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, sinks.insert_absent(old, new, "k").collect())) == [("a", 1), ("b", 1), ("c", 2)]


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="BICS 1A"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="C2"><v>5</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.csv").write_text("h,i\n1,2\n")
    (tmp_path / "c.html").write_text("<p>Hi &amp; ho</p><script>x</script>")
    (tmp_path / "d.xlsx").write_bytes(workbook())
    (tmp_path / "e.bin").write_bytes(b"\0\1")
    (tmp_path / "f.json").write_text("{bad")
    (tmp_path / "g.eml").write_text("Subject: s\n\nbody here\n")
    found = {r.file_name: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert found["a.txt"].text == "plain text" and found["b.csv"].text == "h: 1\ni: 2" and found["c.html"].text.split() == ["Hi", "&", "ho"]
    assert found["g.eml"].text.strip() == "body here" and "e.bin" not in found
    cells = {(r.row, r.col): r.value for r in files.grid_cells(files.scan(spark, str(tmp_path))).collect()}
    assert cells == {(0, 0): "x", (0, 1): "x", (1, 2): "5"}


def test_chunk_files(spark, tmp_path):
    rows = spark.createDataFrame([("1_0000", "1", 0, "text"), ("1_0001", "1", 1, " ")], "chunk_id string, doc_id string, chunk_index int, text string")
    sinks.write_chunks(rows, str(tmp_path / "c"))
    with open(tmp_path / "c" / "bad.json", "w") as f:
        f.write("{not json\n")
    assert [r.chunk_id for r in files.read_chunks(spark, str(tmp_path / "c")).collect()] == ["1_0000"]


def test_address_list(spark):
    lines = ["", "# note", "nowhere", "ftp://a.b/c", "https://a.b/c", "https://a.b/c", "http://d.e"]
    got = files.address_list(spark.createDataFrame(list(enumerate(lines)), "line_num int, line string")).collect()
    assert [(r.line_num, r.url) for r in got] == [(4, "https://a.b/c"), (6, "http://d.e")]


def test_incremental_stream(spark, tmp_path):
    from siltstone.streaming.ingest import ingest_new

    seen = []
    run = lambda: ingest_new(spark, str(tmp_path / "in"), "id long", str(tmp_path / "cp"), lambda df, _: seen.append(df.count()))
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    spark.range(4).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert [n for n in seen if n] == [3, 4]


def test_clean_text(spark):
    raw = " a\n \n \n\nb\t\tc   d\x07é....!!??  "
    assert spark.createDataFrame([(raw,)], "t string").select(X.clean_text(F.col("t")).alias("t")).first().t == "a\n\nb c d...!?"


def test_clusters_are_of_whole_texts(spark, tmp_path):
    from siltstone.plans import catalogue

    body = [" ".join(f"word{i}x{k}" for k in range(80)) for i in range(3)]
    opening = "This text is published under the terms of a licence that any reader may look up."
    texts = ["First " + body[0], "Second " + body[0], f"{opening} {body[1]}", f"{opening} {body[2]}", body[1] + " alone", body[1] + " alone", "", ""]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    merged = {tuple(r.merged_from) for r in catalogue.merge_clusters(spark, str(tmp_path)).collect()}
    assert ("0", "1") in merged and not any({"2", "3"} <= set(m) for m in merged)
    assert any({"4", "5"} <= set(m) for m in merged) and not any({"6", "7"} & set(m) for m in merged)
    report = catalogue.dedup_report(spark, str(tmp_path)).first()
    assert report.chunks_before == 8 and report.merged_chunks == len(merged)


def test_an_address_is_done_by_its_first_line(spark, tmp_path):
    import duckdb

    from siltstone.plans import catalogue

    spark.createDataFrame([(3, "http://a.b/x"), (9, "http://a.b/x"), (18, "http://c.d/"), (20, "http://c.d/"), (21, "no")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.line_num, r.url) for r in catalogue.url_list_validate(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[:2] for r in con.execute(catalogue.SQL["url_list_validate"]).fetchall()} == {(3, "http://a.b/x")}


def test_embedding_of_a_long_text_is_its_counted_hashes(spark):
    import time

    import xxhash

    from siltstone.functions import embed

    words = [f"w{i * i % 977}" for i in range(60_000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, " "), (4, None)], "id long, text string")
    began = time.time()
    got = {r.id: r.v for r in rows.select("id", embed.hashed(F.col("text"), 64).alias("v")).collect()}
    assert time.time() - began < 60 and got[3] is None and got[4] is None
    for i, listed in ((1, words), (2, ["one"])):
        want = [0.0] * 64
        for t in [*listed, *map(" ".join, zip(listed, listed[1:]))]:
            h = xxhash.xxh64(t.encode(), seed=42).intdigest()
            want[h % 64] += 1 if h >> 40 & 1 else -1
        norm = sum(x * x for x in want) ** 0.5
        assert got[i] == [x / norm for x in want]
