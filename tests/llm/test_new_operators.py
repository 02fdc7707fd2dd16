"""Importance resampling, archives and prefix tries: odd rows against plain Python, and the queries against their SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import importance, prefix_trie, store, warc
from tests.conftest import DATA


@pytest.mark.parametrize("module", [importance, warc, prefix_trie])
def test_queries_match_their_sql(spark, sf, module):
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    (name, query), = module.QUERIES.items()
    got = query(spark, sf)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({module.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, want))


# Importance resampling

def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for i in range(len(words)) for n in (1, 2, 3) if i + n <= len(words)]


def resampled(docs, target, percent, least):
    crc = lambda g: zlib.crc32(g.encode()) % 10_000
    s = Counter(crc(g) for _, t in docs for g in features(t)[1])
    t = Counter(crc(g) for x in target for g in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        words, grams = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000)))) for b in map(crc, grams))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    ranks = {id(x): n for n, x in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((*map(str, x[:4]), str(ranks.get(id(x)))) for x in out)


def test_resampling_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..!"), (4, "One two THREE, one-two; Één été 3a"), (5, "\x00a\x7fb c."), (6, "É é Ü É"), (None, "a b c d e"), (None, None), (7, "a b c d e"), (7, "a b c d e"), (8, "long tail " * 30_000), (9, " x y z \t\n"), (10, "ab cd ef 😀 gh")]
    target = ["one two three", None, "", "a b c", "É é"]
    schema = "doc_id long, text string, RANK string, score string, n_features int"
    frame = spark.createDataFrame([(*d, "k", "s", 1) for d in docs], schema).repartition(5)
    for percent, least in ((50, 3), (100, 0), (5, 20)):
        got = importance.resample(spark, frame, spark.createDataFrame([(x,) for x in target], "text string"), percent=percent, least_words=least).collect()
        assert sorted(tuple(map(str, r)) for r in got) == resampled(docs, target, percent, least)
    kept = importance.resample(spark, frame, spark.createDataFrame([], "text string"), keep=("RANK", "score"))
    assert kept.columns == ["doc_id", "RANK", "score", "n_features", "weight", "score_", "rank_"] and {r.score for r in kept.collect()} == {"s"}


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(spark, none, none).collect() == []


def test_resampling_stays_in_the_jvm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = importance.gains(spark, docs, docs)._jdf.queryExecution().toString() + importance.bucket_counts(docs, "text")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# WARC

def test_exits_and_walks_against_steps():
    draw = random.Random(5)
    for _ in range(300):
        start = np.array(sorted(draw.sample(range(60), draw.randint(1, 12))), dtype=np.int64)
        after = np.array([draw.choice([-1, *range(s + 1, 80)]) for s in start.tolist()], dtype=np.int64)
        to = dict(zip(start.tolist(), after.tolist()))
        got = warc.exits(start, after)
        for i, s in enumerate(start.tolist()):
            at, seen = s, []
            while at in to and to[at] >= 0:
                seen.append(at)
                at = to[at]
            assert start[warc.walk(start, after, s)].tolist() == seen
            if to[s] >= 0:
                assert got[i] == (at if at > start[-1] else -1)


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-key:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
BODIES = [
    None, "", "<p>plain</p>", INNER, "\r\n\r\n" + INNER * 3, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, ("é" * 500), ("é" * 500), "z" * 999, "z" * 999, "WARC/1.", "WARC/1.1\r\n\r\n", "ends\r\n", "ends\r\n\r\n", "\r\n\r\n\r\nWARC/1.0",
    "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: -3\r\n\r\n" * 5, ("ab" + INNER) * 60, "q" * 30_000, "WARC/1.WARC/1.WARC/1.", "\x00  WWARC/1.1", "WARC/1.1\r\nContent-Length: x\r\n\r\n",
]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(before, (str(n), "0"))]
    for k, v in before.items():
        spark.conf.set(k, v)


def test_archives_give_back_all_payloads_in_any_splits(spark, small_splits):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}?<x> %0D\r\n\r\nWARC/1.0" if i % 3 else None, b, "e") for i, b in enumerate(BODIES)], "page_id long, url string, html string, head string").coalesce(2)
    path = store.new_path(spark)
    warc.write_warc(spark, pages, path)
    for n in (1 << 27, 20_000, 1021):
        small_splits(n)
        got = {int(r.key): r for r in warc.read_warc(spark, path).collect()}
        assert sorted(got) == list(range(len(BODIES))) and all(r.whole for r in got.values())
        for i, b in enumerate(BODIES):
            body, r = (b or "").encode(), got[i]
            same = [j for j, c in enumerate(BODIES) if c == b]
            again = len(body) >= 1000 and i != max(same)
            assert (r.record_type, r.refers_to) == (("revisit", str(max(same))) if again else ("response", None))
            assert bytes(r.payload) == (b"" if again else body) and r.digest == "sha1:" + hashlib.sha1(body).hexdigest()
            assert r.url == (f"http://a.example/{i}?<x> %0D\r\n\r\nWARC/1.0" if i % 3 else None)


def test_archives_of_bytes_repeats_and_null_keys(spark):
    raw = bytes(range(256)) * 8
    rows_ = [(None, None, raw), (3, None, raw), (3, None, raw), (2, None, raw), (4, None, b"\r\n\xff" * 400), (None, "u", b"small")]
    path = store.new_path(spark)
    warc.write_warc(spark, spark.createDataFrame(rows_, "page_id long, url string, html binary"), path)
    got = sorted((r.key, r.record_type, r.refers_to, bytes(r.payload) == raw) for r in warc.read_warc(spark, path).collect() if r.url is None)
    assert got == [("", "revisit", "3", False), ("2", "revisit", "3", False), ("3", "response", None, True), ("3", "response", None, True), ("4", "response", None, False)]
    warc.write_warc(spark, spark.createDataFrame([], "page_id long, url string, html binary"), nothing := store.new_path(spark))
    assert warc.read_warc(spark, nothing).collect() == []


def test_cut_damaged_and_foreign_archives(spark, tmp_path, small_splits):
    record = lambda i, body: f"WARC/1.0\r\nContent-Length: {len(body)}\r\nWARC-Type: resource\r\nwarc-record-id: <urn:uuid:{i}>\r\n\r\n{body}\r\n\r\n".encode()
    many = [record(i, f"body {i} " * i) for i in range(40)]
    (tmp_path / "good.warc").write_bytes(b"".join(many))
    (tmp_path / "cut.warc").write_bytes(b"".join(many)[:-9])
    (tmp_path / "damaged.warc").write_bytes(b"".join(many[:10]) + b"junk" + b"".join(many[10:]))
    (tmp_path / "late.warc").write_bytes(b"junk" + b"".join(many))
    (tmp_path / "empty.warc").write_bytes(b"")
    for n in (1 << 27, 512):
        small_splits(n)
        for name, count, whole in (("good", 40, 40), ("cut", 40, 39), ("damaged", 10, 9), ("late", 0, 0), ("empty", 0, 0)):
            got = warc.read_warc(spark, f"{tmp_path}/{name}.warc").collect()
            assert (name, len(got), sum(r.whole for r in got)) == (name, count, whole)
            assert all(bytes(r.payload) == many[int(r.record_id[10:-1])].partition(b"\r\n\r\n")[2][:-4] for r in got if r.whole)
    import gzip

    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in many))
    packed = warc.read_warc(spark, f"{tmp_path}/packed.warc.gz").collect()
    assert len(packed) == 40 and sum(r.whole for r in packed) >= 39


# Prefix tries

def trie(convs):
    """convs: {id: [(role, text), ...]}; rows of prefix_trie by plain Python."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = sum(not any(len(q) == len(k) + 1 and q[: len(k)] == k for q in below) for k in below)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_of_random_conversations(spark):
    draw = random.Random(3)
    convs = {i * draw.choice([1, 5000]) - 40: [(draw.choice("ua"), draw.choice(["", "a", "bé", "😀c"])) for _ in range(draw.randint(0, 6))] for i in range(150)}
    convs |= {9_000_000_000 + i: [("u", "same")] * 30 for i in range(80)} | {-5_000: [("u", "same")] * 12}
    turns = [(c, 0, None, None) for c in convs] + [(c, n, r or None, t or None) for c, ts in convs.items() for n, (r, t) in enumerate(ts, 1)]
    frame = spark.createDataFrame([*turns, (None, 1, "u", "x")], "conv_id long, n long, role string, text string").repartition(7)
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark, frame).collect()), key=str) == trie(convs)


def test_rebuilt_conversations(spark):
    draw = random.Random(4)
    source = {c: [(draw.choice([None, draw.randint(0, 5)]), draw.choice([None, "u", "a"]), draw.choice([None, "x", "yy"])) for _ in range(draw.randint(1, 7))] for c in [*range(0, 40), *range(200, 230), *range(301, 340)]}
    order = {c: [(r or "", t or "") for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))] for c, ts in source.items()}
    convs = {}
    for c, own in order.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = order.get(c - c % 100, [])[:h] + own[h:]
    frame = spark.createDataFrame([(c, *t, 1) for c, ts in source.items() for t in ts] + [(None, 1, "u", "x", 1)], "conv_id long, turn long, role string, text string, n int")
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark, prefix_trie.rebuilt(frame)).collect()), key=str) == trie(convs)


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    schema = "conv_id long, n long, role string, text string"
    assert prefix_trie.prefix_trie(spark, spark.createDataFrame([], schema)).collect() == []
    long = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("n"), F.lit("u").alias("role"), F.lit("t" * 50).alias("text"))
    copy = long.where("n <= 2000").withColumn("conv_id", F.lit(2).cast("long"))
    got = {r.depth: r for r in prefix_trie.prefix_trie(spark, long.unionAll(copy)).collect()}
    assert len(got) == 3000 and got[0].saved_tokens == 2000 * 50 and got[1].saved_tokens == 2000 * 50 and got[2001].saved_tokens == 0 and all(r.n_leaves == 1 for r in got.values())
