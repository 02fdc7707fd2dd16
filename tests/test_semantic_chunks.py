"""Semantic chunks: boundaries and overlaps by hand, and odd texts."""

import math
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import chunking


def test_boundaries():
    same, other, third = ["a", "b", "c"], ["x", "y"], ["p", "q"]
    assert chunking.boundaries([same] * 5, [10] * 5, 1000, 0.7) == [0, 5]
    assert chunking.boundaries([same, same, other, third, third], [10] * 5, 1000, 0.7) == [0, 2, 5]
    assert chunking.boundaries([same] * 6, [10] * 6, 20, 0.7) == [0, 3, 6]  # 40 characters at the fourth pass 30
    assert chunking.boundaries([same, other, same], [10, 100, 10], 20, 0.7) == [0, 1, 1, 3]  # apart, and too long by itself
    assert chunking.boundaries([same], [10], 1, 0.7) == [0, 1] and chunking.boundaries([[], []], [1, 1], 9, 0.7) == [0, 2]


def test_overlaps():
    assert chunking.overlapping([0, 2, 5], 0.1) == [(0, 3), (1, 5)]
    assert chunking.overlapping([0, 10, 20, 30], 0.1) == [(0, 13), (7, 23), (17, 30)]
    assert chunking.overlapping([0, 1, 1, 3], 0.1) == [(0, 2), (0, 2), (0, 3)] and chunking.overlapping([0, 8], 0.1) == [(0, 8)]


def test_odd_texts(spark):
    long = " ".join(f"Sentence {i} has words like w{i % 7} and v{i}." for i in range(400))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "no end"), (5, "One. Two. Three."), (6, long)], "doc_id long, text string")
    got = {}
    for r in chunking.semantic_chunks(docs, target=100).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(got) == [4, 5, 6] and got[4][0].text == "no end" and got[4][0].sentence_range == "0-1"
    whole = sorted(got[6], key=lambda r: r.chunk_index)
    ends = [tuple(map(int, r.sentence_range.split("-"))) for r in whole]
    assert ends[0][0] == 0 and ends[-1][1] == 400 and all(b[0] < a[1] for a, b in zip(ends, ends[1:])) and len(whole) > 100
    assert [r.semantic_boundary_score for r in whole] == [1.0] + [0.8] * (len(whole) - 2) + [1.0]


def test_cosines():
    dice = random.Random(3)
    lists = [[dice.choice("abcdeé") for _ in range(dice.choice([0, 1, 2, 5, 9]))] + [""] * dice.randrange(2) for _ in range(300)]
    counts = [Counter(w for w in x if w) for x in lists]
    norms = [math.sqrt(sum(n * n for n in c.values())) for c in counts]
    want = [sum(n * b[w] for w, n in a.items()) / (x * y) if x and y else 0.0 for a, b, x, y in zip(counts, counts[1:], norms, norms[1:])]
    made = pa.array([[], *lists], pa.list_(pa.string()))[1:]
    assert chunking.alike(made).tolist() == want and chunking.alike(made[:1]).tolist() == chunking.alike(made[:0]).tolist() == []


def test_texts_are_whole_sentences(spark):
    dice = random.Random(4)
    texts = [" ".join(f"So ünï\u2003{dice.choice(['Straße\x1cx', 'naïve', '日本'])} {'wört ' * dice.randrange(30)}{i}😀.\t" for i in range(dice.choice([1, 3, 8, 60]))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, " ", *texts])], "doc_id long, text string")
    sentences = dict(docs.select("doc_id", X.sentences(F.col("text"))).collect())
    words = dict(docs.select("doc_id", F.transform(X.sentences(F.col("text")), lambda s: X.words(F.lower(s)))).collect())
    want = []
    for i, s in sentences.items():
        ranges = chunking.overlapping(chunking.boundaries(words[i], [len(x) for x in s], 90, 0.7), 0.1) if s else []
        want += [(i, k, " ".join(s[a:z]), f"{a}-{z}") for k, (a, z) in enumerate(ranges) if a < z]
    got = chunking.semantic_chunks(docs, target=90).select("doc_id", "chunk_index", "text", "sentence_range").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 300


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string")
    plan = chunking.semantic_chunks(docs).select("doc_id", F.md5("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("split(") == 1 and plan.count("array_join(") == 1
