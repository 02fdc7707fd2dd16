def test_stages(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pipeline.run(spark, sf)
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns)
    assert 0 < len(rows) <= docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) and r.n_tokens * 4 == len(r.ids) for r in rows)
    assert len(pipeline.STAGES) == 5


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
