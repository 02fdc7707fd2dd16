"""The similarity join and the vector index against all pairs in numpy."""

import numpy as np
import pytest

from siltstone.operators import similarity, tables
from siltstone.operators.vector_index import VectorIndex


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(n=2000, d=64, links=400, seed=1):
    """Random vectors, and beside the first ones others at cosines of 0.90 to 0.99."""
    draw = np.random.default_rng(seed)
    base = unit(draw.standard_normal((n, d)))
    near = []
    for i in range(links):
        t = draw.uniform(0.90, 0.99)
        side = draw.standard_normal(d)
        side -= side @ base[i] * base[i]
        near.append(t * base[i] + np.sqrt(1 - t * t) * side / np.linalg.norm(side))
    return np.vstack([base, near]) * draw.uniform(0.5, 3, (n + links, 1))


def frame(spark, v, *more):
    return spark.createDataFrame([(i, x.tolist(), *m) for i, (x, *m) in enumerate(zip(v, *more))], "id long, v array<double>" + ", part int" * len(more)).repartition(4)


def all_links(v, threshold):
    u = unit(v)
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return {*zip(i.tolist(), j.tolist())}


def test_tables_find_all_links_and_meet_few_pairs(spark):
    v = planted()
    plan = similarity.tables_for(0.92, len(v))
    assert plan is not None and (1 - similarity.agreement(0.92, plan[0]) ** plan[1]) ** plan[2] <= similarity.MISS
    rows = frame(spark, v)
    firsts, _ = similarity.classes(rows)
    met, passed = similarity.candidates(firsts, 0.92, *plan)
    want = all_links(v, 0.92)
    assert met.count() < 0.05 * len(v) * (len(v) - 1) / 2 and passed.count() < 3 * len(want) + 100
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(rows, 0.92).collect()}
    assert {*got} == want and len(want) > 250
    u = unit(v)
    assert all(abs(s - u[a] @ u[b]) < 1e-12 for (a, b), s in got.items())


def test_sketch_passes_what_it_should():
    draw = np.random.default_rng(7)
    a = unit(draw.standard_normal((4000, 32)))
    b = unit(draw.standard_normal((4000, 32)))
    b = 0.92 * a + np.sqrt(1 - 0.92**2) * unit(b - (a * b).sum(1, keepdims=True) * a)
    (_, x), (_, y) = (similarity.codes(unit(v), 16, 1, 1) for v in (a, b))
    differing = np.bitwise_count((x ^ y).view(np.uint64)).sum(1)
    assert differing.max() <= similarity.most_differing(0.92) < 50 and similarity.most_differing(0.0) > 80


def test_low_thresholds_compare_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 64)
    v = planted(300, 16, 30)
    assert similarity.tables_for(0.3, len(v)) is None
    assert {(r.a, r.b) for r in similarity.similar_pairs(frame(spark, v), 0.3).collect()} == all_links(v, 0.3)


def test_blocks_are_shuffled_once_and_forests_connect(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    v = planted(500, 16, 30)
    firsts, _ = similarity.classes(frame(spark, v))
    found = similarity.in_blocks(firsts, 0.3, len(v))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = all_links(v, 0.3)
    assert {(r.a, r.b) for r in found.collect()} == want
    tied = similarity.in_blocks(firsts, 0.3, len(v), forest=True).collect()
    assert len(tied) < len(want) / 4
    roots = {}
    for links in ([(r.a, r.b) for r in tied], want):
        top = list(range(len(v)))
        for _ in range(len(v)):
            before = list(top)
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
            if top == before:
                break
        roots[len(roots)] = top
    assert roots[0] == roots[1]


@pytest.mark.parametrize("threshold", [0.3, 0.95])
def test_odd_vectors_copies_and_parts(spark, threshold):
    near = [1.0, 0.01, 0.0]
    rows = [
        ("a", [1.0, 0.0, 0.0], 1), ("b", [1.0, -0.0, 0.0], 1), ("c", [1.0, 0.0, 0.0], 1), ("d", near, 1), ("e", near, 2), ("f", None, 1), ("g", [0.0, 0.0, 0.0], 1), ("h", [1.0, None, 0.0], 1),
        ("i", [1.0, float("nan"), 0.0], 1), ("j", [float("inf"), 0.0, 0.0], 1), ("k", [], 1), ("l", [1.0, 0.0], 1), ("m", near, None), ("n", [2.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "id string, v array<double>, part int")
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, threshold, within="part").collect()}
    assert got == {(x, y) for x in "abcdn" for y in "abcdn" if x < y}
    tied = {(r.a, r.b) for r in similarity.links(df, threshold, within="part").collect()}
    assert {("a", "b"), ("a", "c")} <= tied <= got
    assert similarity.similar_pairs(df.limit(0), threshold).collect() == []


def nearest(v, q, k, ids=None, own=None):
    """ids of the k greatest cosines, ties by id."""
    ids = range(len(v)) if ids is None else ids
    c = unit(v) @ (q / np.linalg.norm(q))
    return [i for _, i in sorted((-round(x, 12), i) for x, i in zip(c, ids) if i != own)[:k]]


def clustered(n=3000, d=24, groups=30):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((groups, d)) * 4
    return centres[draw.integers(0, groups, n)] + draw.standard_normal((n, d)) * 0.3


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_index_is_exact_prunes_cells_and_grows(spark, monkeypatch):
    from siltstone.operators import vector_index

    monkeypatch.setattr(vector_index, "BLOCK", 50)
    v = clustered()
    index = VectorIndex.build(frame(spark, v[:2500]), tables.scratch(spark))
    queries = frame(spark, v).where("id % 97 = 0")
    found = index.search(queries, 7).cache()
    assert by_query(found) == {i: nearest(v[:2500], v[i], 7) for i in range(0, 3000, 97)}
    assert found.selectExpr("avg(cells) as c").first().c < 0.4 * len(index.centres())
    index.add(frame(spark, v).where("id >= 2500"))
    assert by_query(index.search(queries, 7, exclude_self=True)) == {i: nearest(v, v[i], 7, own=i) for i in range(0, 3000, 97)}
    near = by_query(index.search(queries, 7, exact=False, probes=2))
    assert sum(len({*near[i]} & {*nearest(v, v[i], 7)}) for i in near) >= 0.9 * 7 * len(near)


def test_index_of_odd_rows(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0, 0.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [0.0, 1.0]), ("g", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    index = VectorIndex.build(df, tables.scratch(spark), cells=2)
    assert by_query(index.search(df, 3)) == {"a": ["a", "b", "c"], "b": ["a", "b", "c"], "c": ["a", "b", "c"], "f": ["f", "a", "b"]}
    assert by_query(index.search(df, 9, exclude_self=True))["f"] == ["a", "b", "c"]
    assert index.search(df.limit(0), 3).collect() == []
    empty = VectorIndex.build(df.limit(0), tables.scratch(spark))
    assert empty.search(df, 3).collect() == []
    empty.add(df.limit(0))


def test_bounds_and_what_is_connected_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 300)
    monkeypatch.setattr(similarity, "AT_ONCE", 64)
    draw = np.random.default_rng(12)
    v = draw.standard_normal((1200, 48)) + 3 * np.repeat(draw.standard_normal((40, 48)), 30, 0)
    v[::7] = np.roll(v, 1, 0)[::7] + 0.05 * draw.standard_normal((len(v[::7]), 48))
    rows = spark.createDataFrame([(i, "ab"[i % 5 > 2], [float(x) for x in r]) for i, r in enumerate(v)], "id long, part string, v array<double>").repartition(5)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for within in (None, "part"):
        firsts, _ = similarity.classes(rows, within=within)
        for threshold in (0.93, 0.97):
            assert [*similarity.axes(firsts, threshold)] == [48]
            top = [*range(len(v))]
            near = np.argwhere(np.triu(u @ u.T >= threshold, 1))
            near = [(a, b) for a, b in near.tolist() if within is None or "ab"[a % 5 > 2] == "ab"[b % 5 > 2]]
            got = [(r.a, r.b) for r in similarity.class_links(firsts, threshold, True).collect()]

            def trees(edges):
                up = top[:]
                def root(x):
                    while up[x] != x:
                        x = up[x]
                    return x
                for a, b in edges:
                    a, b = sorted((root(a), root(b)))
                    up[b] = a
                return [root(x) for x in top]

            assert len(near) > 100 and trees(got) == trees(near)


def test_classes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, "x", [3.0, 4.0]), (2, "x", [3.0, 4.0]), (2, "x", [3.0, 4.0]), (3, "y", [3.0, 4.0]), (4, None, [1.0, 0.0]), (5, "x", [0.0, 0.0]), (6, "x", None), (7, "x", []), (8, "x", [1.0, None]), (9, "x", [inf, 1.0]), (10, "x", [nan, 1.0]), (11, "x", [1.0])]
    df = spark.createDataFrame(rows, "id long, part string, v array<double>")
    for few in (0, 100):
        similarity.FEW, kept = few, similarity.FEW
        firsts, members = similarity.classes(df, within="part")
        similarity.FEW = kept
        assert sorted((r.part, r.id, r.u) for r in firsts.collect()) == [("x", 1, [0.6, 0.8]), ("x", 11, [1.0]), ("y", 3, [0.6, 0.8])]
        assert {(r.id, r.head) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (11, 11)}
