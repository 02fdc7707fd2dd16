"""The growing inverted index against a fit of all documents at once."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import search, tables, term_index
from siltstone.operators.term_index import TermIndex


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(term_index, "BUCKETS", 4)


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "the") for b in ("ra", "se", "ti", "po", "")]


def documents(spark, ids, seed):
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 30)))) for i in ids]
    return spark.createDataFrame([(i, None if i % 17 == 0 else t) for i, t in rows], "doc_id long, text string")


def fitted(docs, queries, **settings):
    """search.tfidf of all documents, and the cosine of each query."""
    postings, idf = search.tfidf(docs.withColumn("text", F.coalesce("text", F.lit(""))), **settings)
    out = {}
    for q in queries.collect():
        hits = search.lexical(postings, idf, docs.sparkSession.createDataFrame([(q.doc_id, q.text)], "doc_id long, text string"), 5)
        out |= {(q.doc_id, r.doc_id): round(r.score, 9) for r in hits.collect()}
    return out


def found(index, queries):
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in index.search(queries, 5).collect()}


def test_index_grows_shrinks_and_refreshes_as_a_fit_of_all(spark):
    docs = documents(spark, range(120), 1)
    queries = spark.createDataFrame([(1, "kara lose miti unknown"), (2, "nupo nupo kase the"), (3, ""), (4, None)], "doc_id long, text string")
    index = TermIndex.build(docs.where("doc_id < 60"), tables.scratch(spark), features=200)
    assert found(index, queries) == fitted(docs.where("doc_id < 60"), queries, features=200)
    index.refresh()
    assert found(index, queries) == fitted(docs.where("doc_id < 60"), queries, features=200)
    index.add(docs.where("doc_id >= 60"))
    assert found(index, queries) == fitted(docs, queries, features=200)
    index.remove(spark.createDataFrame([(3,), (70,), (999,)], "doc_id long"))
    left = docs.where("doc_id not in (3, 70)")
    assert found(index, queries) == fitted(left, queries, features=200)
    again = spark.createDataFrame([(3, "kara lose miti kara lose miti")], "doc_id long, text string")
    index.add(again)
    assert found(index, queries) == fitted(left.unionAll(again), queries, features=200)
    index.refresh()
    assert found(TermIndex(spark, index.path, features=200), queries) == fitted(left.unionAll(again), queries, features=200)


def test_search_reads_only_its_terms_folders(spark):
    index = TermIndex.build(documents(spark, range(80), 2), tables.scratch(spark))
    asked = spark.createDataFrame([(1, "kara")], "doc_id long, text string")
    for refreshed in (False, True):
        if refreshed:
            index.refresh()
        postings = index._named(index._read("postings", "term string, doc_id, n long, bucket int"), index._asked(index.vocabulary(), asked))
        plan = postings._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,kara)" in plan


def test_batch_that_failed_half_way_is_not_there(spark, monkeypatch):
    docs = documents(spark, range(60), 3)
    queries = spark.createDataFrame([(1, "kara lose miti")], "doc_id long, text string")
    index = TermIndex.build(docs.where("doc_id < 40"), tables.scratch(spark))
    before = found(index, queries)
    with monkeypatch.context() as m:
        m.setattr(TermIndex, "_log", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.add(docs.where("doc_id between 40 and 49"))
    assert found(index, queries) == before


def test_empty_index(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = TermIndex.build(none, tables.scratch(spark))
    asked = spark.createDataFrame([(1, "kara")], "doc_id long, text string")
    assert index.search(asked, 3).collect() == []
    index.remove(asked)
    index.refresh()
    assert index.search(none, 3).collect() == []


def test_best_of_many_queries_is_what_all_scores_give(spark, monkeypatch):
    monkeypatch.setattr(term_index, "WEIGHTS", 300)
    docs = documents(spark, range(150), 5)
    docs = docs.unionAll(docs.where("doc_id < 40").selectExpr("doc_id + 1000", "text")).repartition(3)
    index = TermIndex.build(docs, tables.scratch(spark))
    index.remove(spark.createDataFrame([(5,), (1006,)], "doc_id long"))
    queries = documents(spark, range(30), 6)
    order = term_index.W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    want = index.scores(queries).withColumn("rank", F.row_number().over(order)).where("rank <= 4 and score > 0.1")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    found = index.best(queries, 4)
    assert rows(found) == rows(want) and len(rows(want)) > 80
    # only the best of each block leave the tasks: no exchange of all scores
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_postings_are_of_words_only(spark):
    index = TermIndex.build(spark.createDataFrame([(1, "kara lose miti"), (2, "kara lose"), (2, "miti nupo")], "doc_id long, text string"), tables.scratch(spark), most=1.0)
    postings = index._read("postings", "term string, doc_id, n long, bucket int")
    assert {(r.term, r.doc_id) for r in postings.collect()} == {("kara", 1), ("lose", 1), ("miti", 1), ("kara", 2), ("lose", 2), ("miti", 2), ("nupo", 2)}
    assert {r.term for r in index.vocabulary().collect()} == {"kara", "lose", "miti", "kara lose"}


def test_equal_documents_tie(spark):
    docs = spark.createDataFrame([(i, "kara lose miti nupo kase lora mise tira" if i % 2 else f"kara lose {i}") for i in range(60)], "doc_id long, text string").repartition(7)
    postings, idf = search.tfidf(docs)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()  # no document is shuffled
    hits = search.lexical(postings, idf, spark.createDataFrame([(1, "miti nupo kase")], "doc_id long, text string"), 9).collect()
    assert [r.doc_id for r in sorted(hits, key=lambda r: r.doc_id)] == list(range(1, 18, 2)) and len({r.score for r in hits}) == 1
