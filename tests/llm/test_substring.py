"""Repeated passages against a brute-force search of all common word runs."""

import random

import pytest

from siltstone.llm import substring_dedup
from siltstone.llm.store import components
from tests.llm.test_dedup import WORDS, text_of


def common_runs(a, b, least):
    """(begin, end) in a of all maximal runs of least words or more that a and b have in common."""
    out, row = [], [0] * (len(b) + 1)
    for i, w in enumerate(a):
        new = [0] * (len(b) + 1)
        for j, v in enumerate(b):
            if w == v:
                new[j + 1] = row[j] + 1
                if new[j + 1] >= least and (i + 1 == len(a) or j + 1 == len(b) or a[i + 1] != b[j + 1]):
                    out.append((i + 1 - new[j + 1], i + 1))
        row = new
    return out


def words_left(text):
    return (text or "").lower().split()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_repeat_goes_and_no_unique_word(spark, monkeypatch, seed):
    if seed > 1:
        monkeypatch.setattr(substring_dedup, "TOGETHER", 20)
    rng = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(rng.randint(30, 130))] for k in range(6)]
    texts = []
    for d in range(40):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [f"d{d}n{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a = rng.randint(0, 12)
                words += p[a : len(p) - rng.randint(0, 12)]
        ends = [rng.choice([" ", " ", " ", ".\n", "  "]) for _ in words]
        texts.append("".join(w + e for w, e in zip(words, ends)))
    texts = [t.replace(".\n", "\n") for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    out = {r.doc_id: words_left(r.text) for r in substring_dedup.cut_repeats(spark, docs).collect()}
    # where an earlier document still has a shorter piece, up to a window's words may stay at either end
    least, edge = substring_dedup.LEAST, substring_dedup.WINDOW - 1
    for d in range(40):
        own = words_left(texts[d])
        must, may = set(), set()
        for e in range(d):
            for a, b in common_runs(own, words_left(texts[e]), 8):
                may |= set(range(a, b))
                if b - a >= least:
                    must |= set(range(a + edge, b - edge))
        left = out.get(d, [])
        unique = [w for i, w in enumerate(own) if i not in may]
        assert [w for w in left if w in set(unique)] == unique  # every unique word stays, in order
        twice = {w for w in own if own.count(w) > 1}
        assert not {own[i] for i in must} - twice & set(left)


def test_edited_copies_inside_paragraphs(spark):
    rng = random.Random(4)
    texts, count = [], 30
    for i in range(count):
        passage = rng.choices(WORDS, k=100)
        edited = [w if (k + 1) % 20 else f"edit{k}" for k, w in enumerate(passage)]
        texts += [" ".join(rng.choices(WORDS, k=60) + passage + rng.choices(WORDS, k=40)), " ".join(rng.choices(WORDS, k=30) + edited + rng.choices(WORDS, k=50))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.keeper_doc_id): r.n_words for r in substring_dedup.repeated_spans(spark, docs).collect()}
    assert set(found) <= {(2 * i + 1, 2 * i) for i in range(count)}
    assert sum(90 <= n <= 101 for n in found.values()) >= 0.9 * count


@pytest.mark.parametrize("size,step", [(24, 8), (22, 4), (20, 8)])
def test_pieces_in_earlier_documents_hide_no_repeat(spark, size, step):
    """An 80-word passage in two documents, with pieces of it that are too short for a passage in documents before both."""
    rng = random.Random(size)
    texts, full, own = [], [], []
    for case in range(30):
        passage = [f"c{case}w{rng.randrange(10**6)}" for _ in range(80)]
        alone = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
        for a in range(0, 80 - size + 1, step):
            texts.append(" ".join(alone(40) + passage[a : a + size] + alone(40)))
        for _ in range(2):
            begin = alone(rng.randint(0, 60))
            full.append(len(texts))
            own.append(passage)
            texts.append(" ".join(begin + passage + alone(30)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in substring_dedup.repeated_spans(spark, docs).collect()}
    assert set(found) <= set(full[1::2])  # pieces and first copies stay
    assert set(found) == set(full[1::2])
    edge = substring_dedup.WINDOW + substring_dedup.SHINGLE
    assert all(80 - edge <= found[d].n_words <= 80 for d in found)
    assert sum(r.n_words for r in found.values()) >= 0.95 * 80 * 30
    for d, passage in zip(full[1::2], own[1::2]):
        assert set(texts[d][found[d].start : found[d].end].split()) <= set(passage)


def test_a_dense_chain_that_fails_hides_no_repeat(spark):
    """A long chain with many edits has the bands of the first document; a copy of its middle stands in another."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    middle = base[100:170]
    edited = [w if i % 40 < 23 else f"e{i}" for i, w in enumerate(base)]
    unique = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts = [edited, unique(30) + middle + unique(30), unique(10) + base + unique(10)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    left = {r.doc_id: r.text.split() for r in substring_dedup.cut_repeats(spark, docs).collect()}
    assert len(set(left[2]) & set(middle)) <= 2 * (substring_dedup.WINDOW - 1)


def test_a_shift_in_the_copy(spark):
    rng = random.Random(5)
    passage = rng.choices(WORDS, k=120)
    shifted = passage[:40] + ["one", "two"] + passage[40:80] + passage[83:]
    docs = spark.createDataFrame([(1, " ".join(passage)), (2, "before it " + " ".join(shifted) + " behind")], "doc_id long, text string").coalesce(1)
    (row,) = substring_dedup.repeated_spans(spark, docs).collect()
    assert (row.doc_id, row.keeper_doc_id, row.cluster_doc_id, row.n_words) == (2, 1, 1, len(shifted))


def test_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(60))
    long = " ".join(["again"] * 30_000)
    rows = [(None, same, 1), (None, same, 1), (3, None, 1), (4, "", 1), (5, " \n", 1), (6, long, 1), (7, long, 1), (8, "few words", 1), (8, "few words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marks int").coalesce(1).withColumnsRenamed({"doc_id": "row_id"})
    kept = substring_dedup.cut_repeats(spark, docs)
    assert kept.columns == ["row_id", "text", "marks"]
    assert sorted((r.text or "")[:9] for r in kept.collect()) == sorted(["w0 w1 w2 ", "", "", " \n", "again aga", "few words", "few words"])
    assert sum((r.text or "").startswith("again") for r in kept.collect()) == 1
    assert substring_dedup.cut_repeats(spark, docs.limit(0)).count() == 0


def test_components_of_a_million_edges(spark):
    """A fingerprint of so many edges once overflowed."""
    edges = spark.range(1_000_000).selectExpr("id as a", "id - id % 1000 as b").unionAll(spark.range(999).selectExpr("id * 1000 as a", "id * 1000 + 1000 as b").where("a % 10000 != 9000"))
    found = components(spark, edges)
    assert found.count() == 1_000_000
    assert found.where("comp != node - node % 10000").count() == 0
