"""Decontamination against an alignment of every document with every item."""

import random

from pyspark.sql import functions as F

from siltstone.llm import decontaminate
from siltstone.llm.decontaminate import GAP, MATCH, OTHER


def brute_score(item, words):
    """Smith-Waterman, cell by cell."""
    row, best = [0.0] * (len(words) + 1), 0.0
    for v in item:
        new = [0.0]
        for j, w in enumerate(words):
            new.append(max(0.0, row[j] + (MATCH if v == w else OTHER), row[j + 1] - GAP, new[j] - GAP))
        row, best = new, max(best, max(new))
    return best


def test_against_all_alignments(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = {i: rng.choices(words, k=rng.randint(3, 40)) for i in range(25)}
    docs = {}
    for d in range(120):
        body = rng.choices(words, k=rng.randint(0, 120))
        if d % 2:
            copy = list(items[d % 25])
            for _ in range(rng.randint(0, int(0.3 * len(copy)))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(words)], [copy[k], rng.choice(words)]])
                if not copy:
                    break
            at = rng.randint(0, len(body))
            body[at:at] = copy
        docs[d] = body
    table = spark.createDataFrame([(str(d), " ".join(w), "x") for d, w in docs.items()], "doc_id string, text string, uid string").repartition(3)
    bench = spark.createDataFrame([(f"item{i}", " ".join(w).upper()) for i, w in items.items()], "item_id string, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark, table, bench).collect()}
    want, near = set(), set()
    for d, w in docs.items():
        for i, item in items.items():
            score = brute_score(item, w)
            if score >= (0.8 * (MATCH - OTHER) + OTHER) * len(item) - 1e-9:
                want.add((str(d), f"item{i}"))
                near.add((str(d), f"item{i}")) if decontaminate.edits(len(item), 0.8) else None
    assert set(found) <= want
    assert len(set(found)) >= 0.98 * len(want) and len(want) > 40
    exact = {(d, i) for d, i in want if " ".join(items[int(i[4:])]) in " ".join(docs[int(d)])}
    assert exact <= set(found) and all(found[x].score == 1 for x in exact)
    kept = {r.doc_id for r in decontaminate.drop_leaks(spark, table, bench).collect()}
    assert kept == {str(d) for d in docs} - {d for d, _ in found}


def test_short_items_and_odd_rows(spark):
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    rows = [(1, "say one two three four again"), (2, "yes"), (3, "well yes"), (4, "a\nYES\nb"), (5, None), (None, "yes"), (6, ""), (7, long + " alpha beta gamma delta epsilon " + long), (2, "yes"), (8, "alpha beta other delta epsilon")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, iid int, gram int")
    bench = spark.createDataFrame([(None, "one two three four"), (10, "Yes"), (11, None), (12, " "), (13, "alpha beta gamma delta epsilon")], "item_id long, text string")
    found = sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.find_leaks(spark, docs, bench).collect())
    assert found == sorted([("1", "None"), ("2", "10"), ("2", "10"), ("4", "10"), ("None", "10"), ("7", "13"), ("8", "13")])
    kept = decontaminate.drop_leaks(spark, docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "6"]
    assert decontaminate.find_leaks(spark, docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(spark, docs.limit(0), bench).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(400)], "item_id long, text string")
    docs = bench.select(F.col("item_id").alias("doc_id"), "text")
    want = {(i, i) for i in range(400)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "MOST_BITS", 4096)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, docs, bench).collect()} == want


def test_contract(spark, sf):
    out = decontaminate.op2_decontaminate(spark, sf)
    assert dict(out.dtypes)["doc_id"] == "bigint" and dict(out.dtypes)["item_id"] == "bigint"
    assert out.count() == out.select("doc_id", "item_id").distinct().count() > 0
