import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import embedding_dedup, minhash_dedup, substring_dedup
from siltstone.llm.store import components, number_rows, rank_in

WORDS = [f"w{i}" for i in range(4000)]


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.comp for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == union_find(nodes, edges)
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def corpus(rng):
    texts = []
    for _ in range(25):
        base = rng.choices(WORDS, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    base = rng.choices(WORDS, k=60)  # a large group, near the threshold
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    return [*texts, None, "", " \n", "one", "ONE", "two words", "two  words", *texts[:5]]


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, small):
    if small:  # every way to the rest
        for name, value in (("PIVOT", 8), ("PIVOTS", 1), ("PAIRWISE", 4), ("BLOCK", 8)):
            monkeypatch.setattr(minhash_dedup, name, value)
    texts = corpus(random.Random(5))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row_id string")
    decided, rid, copy = minhash_dedup.near_duplicates(spark, docs, words=3, num=85)
    got = {r.doc_id: r for r in decided.join(copy.select(rid, "doc_id"), rid).collect()}
    sets = [shingle_set(t, 3) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = union_find(range(len(sets)), edges)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.first_row == (want[i] == i) for i, r in got.items())


def test_keep_first_with_repeated_and_null_ids(spark):
    text = " ".join(WORDS[:40])
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, None)], "doc_id long, text string")
    kept = sorted(minhash_dedup.keep_first(spark, docs).collect(), key=str)
    assert len(kept) == 3 and sum(r.text == text for r in kept) == 1
    assert minhash_dedup.keep_first(spark, docs.limit(0)).count() == 0


def test_rank_in(spark):
    rows, rid = number_rows(spark, spark.range(1000).repartition(7).select((F.col("id") % 3).alias("k")))
    ranked, rank = rank_in(spark, rows, "k", rid)
    got = ranked.collect()
    for k in range(3):
        assert sorted(r[rank] for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))


def cosine(a, b):
    a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)


@pytest.mark.parametrize("chunk", [1024, 16])
def test_vectors_against_all_pairs(spark, monkeypatch, chunk):
    import numpy as np

    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            base = rng.standard_normal(16)
            rows += [(label, (base + rng.standard_normal(16) * s).tolist()) for s in rng.uniform(0.05, 0.45, rng.integers(1, 12))]
    rows += [(0, rows[0][1]), (None, rows[0][1]), (0, None), (0, [0.0] * 16), (0, [float("nan")] * 16), (0, [1.0, None]), (0, []), (0, [3.0]), (0, [2.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [1e200, 1e200]), (1, [1e-200, 1e-200]), (1, [1e-200, 1.1e-200]), (1, [-0.0, 1.0]), (1, [0.0, 1.0])] + [(0, rows[3][1])] * 30
    table = spark.createDataFrame([(i, label, v) for i, (label, v) in enumerate(rows)], "vec_id long, label int, embedding array<double>")
    got = {r.id: r for r in embedding_dedup.near_vectors(spark, table).collect()}
    links = {i: set() for i in range(len(rows))}
    good = [i for i, (label, v) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i in good:
        for j in good:
            a, b = rows[i], rows[j]
            if i != j and a[0] == b[0] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93:
                links[i].add(j)
    want = union_find(range(len(rows)), [(i, j) for i, js in links.items() for j in js])
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (len(links[i]), want[i]) for i in links}
    assert embedding_dedup.near_vectors(spark, table.limit(0)).count() == 0


def test_vectors_are_dealt_once_for_each_chunk_of_their_label(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    def dealt(least):
        return lambda t: pa.table({"a": t.column("uid"), "b": pa.nulls(len(t), pa.int64()), "n": pa.array([1] * len(t), pa.int64())})

    monkeypatch.setattr(embedding_dedup, "compare_chunks", dealt)
    v = np.random.default_rng(5).standard_normal((3000, 64))
    table = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    assert {r.n_links for r in embedding_dedup.near_vectors(spark, table).collect()} == {1}
    monkeypatch.setattr(embedding_dedup, "CHUNK", 400)
    assert {r.n_links for r in embedding_dedup.near_vectors(spark, table).collect()} == {4}


def test_a_chunk_whose_other_chunk_is_empty_is_not_compared_with_itself():
    import pyarrow as pa

    rows = {"uid": [0, 1], "copies": [1, 1], "first": [True, True], "v": [[1.0, 0.0], [1.0, 0.1]], "i": [0, 0]}
    assert len(embedding_dedup.compare_chunks(0.93)(pa.table(rows | {"j": [1, 1]}))) == 0
    assert embedding_dedup.compare_chunks(0.93)(pa.table(rows | {"j": [0, 0]})).to_pydict() == {"a": [0, 1, 0], "b": [None, None, 1], "n": [1, 1, None]}


def test_op6_on_links_at_above_and_below_the_threshold(spark, tmp_path):
    """A table as the registered query reads it; the test tables hold no pair near the threshold."""
    import numpy as np

    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k in range(60):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        w = rng.standard_normal(64)
        w -= w @ u * u
        w /= np.linalg.norm(w)
        target = 0.93 + (-1) ** k * [1e-6, 1e-4, 0.02][k % 3]
        pair = [u.astype(np.float32), (target * u + np.sqrt(1 - target**2) * w).astype(np.float32)]
        label = k % 4
        rows += [(2 * k + i, v.tolist(), label) for i, v in enumerate(pair)]
        linked = cosine(*(v.astype(float).tolist() for v in pair)) >= 0.93
        assert linked == (k % 2 == 0)
        want |= {2 * k: (int(linked), 2 * k, True), 2 * k + 1: (int(linked), 2 * k if linked else 2 * k + 1, not linked)}
    rows += [(1000 + i, [1.0] + [0.0] * 63, 9) for i in range(40)] + [(2000, [2.0] + [0.0] * 63, 9), (2001, [1.0] + [0.0] * 63, 8)]
    want |= {1000 + i: (40, 1000, i == 0) for i in range(40)} | {2000: (40, 1000, False), 2001: (0, 2001, True)}
    edge = [0.93, (1 - 0.93**2) ** 0.5] + [0.0] * 62  # at the threshold
    spark.createDataFrame([*rows, (3000, edge, 7), (3001, [1.0] + [0.0] * 63, 7)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op6_embedding_dedup(spark, str(tmp_path)).collect()}
    at = cosine(np.array(edge, np.float32).astype(float).tolist(), [1.0] + [0.0] * 63) >= 0.93
    assert got == want | {3000: (int(at), 3000, True), 3001: (int(at), 3000 if at else 3001, not at)}


def text_of(rng, n):
    out = []
    while len(out) < n:
        s = rng.choices(WORDS, k=rng.randint(5, 12))
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[: n - 1]) + " end."


def test_repeated_passages_are_cut_once(spark):
    rng = random.Random(9)
    passage, short = text_of(rng, 60), text_of(rng, 30)
    paragraph = text_of(rng, 70)
    edited = paragraph.replace(paragraph.split()[30], "other")
    texts = [text_of(rng, 120) + (" " if i % 2 else "\n") + (passage if i < 5 else short if i < 9 else "") + " " + text_of(rng, 90) for i in range(12)]
    # different words before the paragraph, as an equal one would belong to what repeats
    texts += [text_of(rng, 80) + " One.\n" + paragraph, text_of(rng, 80) + " Two.\n" + edited, None, "", "few words", "few words"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "a") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, row_id string").coalesce(1)
    out = {r.doc_id: r for r in substring_dedup.cut_repeats(spark, docs).collect()}
    assert len(out) == len(texts)
    assert [i for i in range(5) if passage in out[i].text] == [0]
    assert not any(" ".join(passage.split()[a : a + 20]) in out[i].text for i in range(1, 5) for a in range(0, 40))
    assert all(out[i].text == texts[i] for i in (0, *range(5, 13), 14, 15, 16, 17))
    assert out[13].text.strip() == texts[13].split("\n")[0] and out[13].n_chars == len(out[13].text)
    found = substring_dedup.repeated_spans(spark, docs).collect()
    assert {(r.doc_id, r.keeper_doc_id) for r in found} == {(1, 0), (2, 0), (3, 0), (4, 0), (13, 12)}
    assert substring_dedup.cut_repeats(spark, docs.limit(0)).count() == 0


def test_one_copy_stays_whatever_order_parts_are_read_in(spark):
    rng = random.Random(12)
    shared = [text_of(rng, 70) for _ in range(6)]
    # parts of very unequal size, the largest last: a saved copy is read largest file first
    parts = [[(10 * p + i, "\n".join([text_of(rng, 60), shared[i], *(text_of(rng, 400) for _ in range(p * p))])) for i in range(6)] for p in range(6)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([row for part in parts for row in part], 6), "doc_id long, text string")
    assert docs.rdd.getNumPartitions() == 6
    out = {r.doc_id: r.text for r in substring_dedup.cut_repeats(spark, docs).collect()}
    assert len(out) == 36
    assert {i: [10 * p + i for p in range(6) if shared[i] in out[10 * p + i]] for i in range(6)} == {i: [i] for i in range(6)}
    assert {(r.doc_id, r.keeper_doc_id) for r in substring_dedup.repeated_spans(spark, docs).collect()} == {(10 * p + i, i) for p in range(1, 6) for i in range(6)}
