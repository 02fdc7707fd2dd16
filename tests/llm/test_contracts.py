"""The registered queries' own columns, against plain Python over the same tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltstone.llm import bpe, language_id, lm_score, sharding
from tests.conftest import DATA


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"select doc_id, text, lang from '{DATA}/documents.parquet' order by doc_id").fetchall()


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def bucket(gram):
    """The hash of one n-gram, number by number."""
    h = 0
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x85EBCA77 & 0xFFFFFFFF) >> 17


def buckets(text):
    text = "".join(" " if 9 <= ord(c) <= 13 else c for c in text.lower())
    return Counter(bucket(text[p : p + n]) for n in language_id.ORDERS for p in range(len(text) - n + 1))


def test_op4_against_naive_bayes_in_python(spark, sf, documents):
    got = {r.doc_id: r for r in language_id.op4_language_id(spark, sf).collect()}
    assert len(got) == len(documents) and all(r.held_out == (fold(i, 4) == 2) for i, r in got.items())
    counts, texts = {}, Counter()
    for i, t, lang in documents:
        if lang is not None and t is not None and fold(i, 4) != 2:
            counts.setdefault(lang, Counter()).update(buckets(t))
            texts[lang] += 1
    size = language_id.BUCKETS
    right = 0
    for i, t, lang in documents[::4]:
        own = buckets(t or "")
        sums = {k: math.log(texts[k]) + sum(n * math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * size)) for b, n in own.items()) for k, c in counts.items()}
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        best = max(sums, key=sums.get)
        assert got[i].lang_pred == best
        assert abs(got[i].score - 1 / sum(math.exp(v - sums[best]) for v in sums.values())) < 1e-6
    held = [(i, lang) for i, t, lang in documents if got[i].held_out and lang and got[i].lang_pred != "und"]
    right = sum(got[i].lang_pred == lang for i, lang in held)
    assert right >= 0.98 * len(held)


def test_op5_against_the_library(spark, sf, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    library.no_truncation(), library.no_padding()
    got = {r.doc_id: r for r in bpe.op5_bpe(spark, sf).collect()}
    assert len(got) == len(documents)
    for i, t, _ in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op8(spark, sf, documents):
    rows = sharding.op8_sharding(spark, sf).collect()
    text = {i: t or "" for i, t, _ in documents}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()), "bytes", None) for r in rows)
    assert len({(text[r.doc_id], r.shard) for r in rows}) == len(set(text.values()))
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_op8_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, 7, 8), (2, None, 5, 6, 7, 8)], "doc_id long, text string, size int, SHARD int, text_key int, rank int")
    out = sharding.assign_shards(spark, docs, 2)[0]
    assert {*docs.columns, "size_", "shard_", "slot"} < set(out.columns)
    assert sorted((r.doc_id, r.size, r.SHARD, r.text_key, r["rank"], r.size_, r.slot) for r in out.collect()) == [(1, 5, 6, 7, 8, 2, 0), (2, 5, 6, 7, 8, 1, 0)]


def test_op10_counts_and_base(spark, sf, documents):
    got = {r.doc_id: r for r in lm_score.op10_lm_score(spark, sf).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, _ in documents}
    c = Counter(w for i, ws in tokens.items() if fold(i, 5) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(tokens)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 5) == 1, len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
