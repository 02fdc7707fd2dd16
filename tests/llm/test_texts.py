import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import bpe, chat_format, decontaminate, html_text, language_id, lm_score, sharding
from siltstone.llm.store import BATCH_BYTES, bound_batches

PIECES = ["<|turn|>", "<|text|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "|", "[", "a", "é", " ", "\n", "<\\|end|>", "人"]
texts = st.lists(st.sampled_from(PIECES), max_size=20).map("".join)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", ""]), texts), max_size=5))
def test_chat_round_trip(turns):
    template = chat_format.Template()
    formatted, spans = chat_format.render(turns, template)
    assert chat_format.parse(formatted, template) == turns
    assert [chat_format.unescape(formatted[a:b], template) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("segment", [1 << 22, 1])
def test_chat_masks(spark, monkeypatch, segment):
    import public_tokenizers

    monkeypatch.setattr(chat_format, "SEGMENT", segment)
    rows = [(1, 1, "assistant", " hi </s>\n"), (1, 0, "user", "<|end|>"), (1, 2, None, None), (1, 3, "assistant", "é人 \\<|end|>"), (2, 0, "user", ""), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_conversations(df, str(public_tokenizers.path("byte_bpe_50k.json")))).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digest(chat_format.format_conversations(df.limit(0), str(public_tokenizers.path("byte_bpe_50k.json")))).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


PARTS = ["a", "b", "the", "ing", "é", "é", "'", "s", "'s", "'re", " ", "\n", "1", "٣", "人", "Σ", "İ", "<|endoftext|>", "<|end", "!", "ß", "\xa0", "ᄀ", "ᅡ", "ᆨ", "x" * 50, "?!", "Z"]


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.sampled_from([7, 64, 4096]), st.sampled_from([1, 1024]))
def test_bpe_equals_the_library(library, text, stride, usual):
    old = bpe.STRIDE, bpe.USUAL
    bpe.STRIDE, bpe.USUAL = stride, usual
    try:
        v = bpe.load(bpe.tokenizer_path())
        ids = np.frombuffer(bpe.Encoder(v).encode(text), "<u4").tolist()
    finally:
        bpe.STRIDE, bpe.USUAL = old
    want = library.encode(text, add_special_tokens=False).ids
    machine = bpe.Decoder(v, names=True)
    assert ids == want
    assert machine.feed(ids[:3]) + machine.feed(ids[3:]) + machine.finish() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 9000, "a" * 20000, "in" * 8000 + "g", "é" * 6000, "-" * 9000 + "a", "internationalization" * 700])
def test_bpe_streams_long_words(library, text):
    v = bpe.load(bpe.tokenizer_path())
    assert np.frombuffer(bpe.Encoder(v).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < v.lookahead < bpe.STRIDE


def test_bpe_table(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld"), (2, None), (3, ""), (None, "x y")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.decode_ids(bpe.encode_texts(docs, bpe.tokenizer_path()), bpe.tokenizer_path()).collect()}
    assert rows[1].decoded == "hello wörld " and rows[2].decoded == "" and bytes(rows[3].ids) == b"" and rows[None].decoded == "x y "
    assert bpe.encode_texts(docs.withColumn("IDS", F.lit(1)), bpe.tokenizer_path()).columns == ["doc_id", "text", "IDS", "ids_"]


@pytest.mark.parametrize("most", [256, 1])
def test_language(spark, monkeypatch, most):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", most)  # 1: a matrix for each language or two
    rng = random.Random(2)
    kinds = {"aa": "abcde", "bb": "bcxyz", "cc": "äöüße"}
    make = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randint(2, 7))) for _ in range(n))
    rows = [(i, make(k := list(kinds)[i % 3], 30), k if i % 10 else None, "s") for i in range(300)] + [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 !?", None, "s"), (903, "x" * 600_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(spark, docs.where(language_id.fold("doc_id", 4) != 2))
    got = {r.doc_id: r for r in language_id.predict(spark, docs, model).collect()}
    assert all(got[i].lang_pred == list(kinds)[i % 3] for i in range(300))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.fit(spark, docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(spark, docs, empty).collect()} == {"und"}
    assert {r.doc_id for r in language_id.keep_languages(spark, docs).collect()} - {903} == set(range(300))
    taken = docs.withColumnsRenamed({"source": "lang_pred", "lang": "score"})
    assert language_id.predict(spark, taken, empty).columns == [*taken.columns, "lang_pred_", "score_"]


@pytest.mark.parametrize(("block", "fan"), [(8 << 20, 8), (3000, 2)])
def test_lm_against_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)  # small ones: sums by several levels
    monkeypatch.setattr(lm_score, "FAN_BITS", fan)
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"W{i}" for i in range(60)], k=rng.randint(0, 40))) for _ in range(200)] + [None, "", "unseen WORDS here", "unseen"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, block_ string").repartition(5)
    held = lambda i, r: zlib.crc32(str(i).encode()) % 5 == r
    marked = docs.withColumns({"train": language_id.fold("doc_id", 5) != 1, "deleted": language_id.fold("doc_id", 5) == 3})
    got = {r.doc_id: r for r in lm_score.score_texts(spark, marked).collect()}
    tokens = {i: [*(t or "").lower().split(), "\n"] for i, t in enumerate(texts)}
    one, two = Counter(), Counter()
    left1, left2 = Counter(), Counter()
    for i, w in tokens.items():
        if not held(i, 1):
            one.update(w), two.update(zip(["^", *w], w))
            if not held(i, 3):
                left1.update(w), left2.update(zip(["^", *w], w))
    n, v = sum(one.values()), len(one)
    one["^"], left1["^"] = one["\n"], left1["\n"]
    cls = lambda c: 0 if not c else 1 + int(math.log2(c))
    seen = [(cls(left1[h]), left1[w] / (sum(left1.values()) - left1["^"]), left2[h, w] / max(1, left1[h])) for i, ws in tokens.items() if held(i, 3) for h, w in zip(["^", *ws], ws)]
    step = lambda p: lm_score.step(np.array([p]))[0]
    counted = Counter((c, step(p1), step(p2)) for c, p1, p2 in seen)
    c, p1, p2 = (np.array(x) for x in zip(*counted))
    weights = lm_score.learn(c, p1, p2, np.array(list(counted.values())), 1 / (sum(x > 0 for k, x in left1.items() if k != "^") + 1))
    for i, w in tokens.items():
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = 0.0
        for h, x in zip(["^", *w], w):
            k = weights[cls(one[h])].copy()
            if not one[h]:
                k = np.array([0, *(k[1:] / k[1:].sum())])
            score += math.log10(k[0] * two[h, x] / max(1, one[h]) + k[1] * one[x] / n + k[2] / (v + 1))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and abs(r.score - score) < 1e-6
    none = lm_score.score_texts(spark, marked.withColumn("train", F.lit(False))).collect()
    assert len(none) == len(texts) and all(r.base_score == 0 and r.score == 0 and r.n_known == 0 for r in none)
    assert lm_score.score_texts(spark, marked.limit(0)).count() == 0


def test_lm_score_of_blocks_over_several_row_groups(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(3000)], k=60)), i % 5 != 1, i % 5 == 3) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, deleted boolean").coalesce(1)
    want = {r.doc_id: r for r in lm_score.score_texts(spark, docs).collect()}
    small = {"parquet.block.size": "20000", "parquet.page.size": "4000", "spark.sql.files.maxPartitionBytes": "40000", "spark.sql.files.openCostInBytes": "0"}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        blocks = lm_score.save(spark, lm_score.blocks_of(docs, "text"))
        assert blocks.select("block_").distinct().count() == 1 and lm_score.requests(blocks).where("bucket = 0").count() > 1
        got = {r.doc_id: r for r in lm_score.score_texts(spark, docs).collect()}
    finally:
        for k in small:
            spark.conf.unset(k)
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
        assert abs(got[i].base_score - r.base_score) < 1e-9 and abs(got[i].score - r.score) < 1e-6


def test_leaks(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    make = lambda n: rng.choices(vocabulary, k=n)
    items = {i: make(rng.randint(15, 50)) for i in range(20)}
    docs, want = [], set()
    for d in range(120):
        body = make(200)
        if d % 4 == 0:
            item = items[d % 20]
            copy = list(item)
            for p in rng.sample(range(len(copy)), len(copy) // 10 if d % 8 == 0 else 0):
                copy[p] = rng.choice(vocabulary)
            body[50:50] = copy
            want.add((d, d % 20))
        elif d % 4 == 1:
            body[50:50] = items[d % 20][:6]  # a few words in common
        docs.append((d, " ".join(body).upper() if d % 3 == 0 else " ".join(body)))
    docs += [(500, None), (501, ""), (502, " ".join(items[0])), (502, " ".join(items[0]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, "two words"), (None, "a b c d e f")], "item_id long, text string")
    found = decontaminate.find_leaks(spark, table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(502, 0)} and sum(r.doc_id == 502 for r in found) == 2
    assert {r.doc_id for r in decontaminate.drop_leaks(spark, table, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want} - {502}
    assert decontaminate.find_leaks(spark, table, bench.limit(0)).count() == 0 and decontaminate.find_leaks(spark, table.limit(0), bench).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; bare", "plain & bare"),
        ("<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One <b>two</b>three.<p>Four,\n five.</article><footer>&copy; us</footer>", "T One twothree. Four, five."),
        ("<article><p>Text here, really.</p><section class='comments'><p>Nice post, thanks!</p></section><form><p>Mail me, please.</p></form></article>", "Text here, really."),
        ("<script>var t='</p>';</script><!-- x --><main><p>a&nbsp;b</p><aside>ad, ad.</aside></main>", "a b"),
        ("<div class='sidebar'><p>Links, links.</p></div><div id='body'><p>The long first paragraph, with marks.</p><p>And the second, too.</p></div>", "The long first paragraph, with marks. And the second, too."),
        ("<article>" * 2000 + "x", "x"), ("<p>cut &am", "cut &am"),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_schedule_is_longest_first():
    rng = random.Random(8)
    sizes = [rng.choice([1, 3, 7, 50, 900]) for _ in range(3000)]
    counts = Counter(sizes)
    plan = sharding.schedule([(s, n, s * n) for s, n in counts.items()], 16)
    loads, seen = [0] * 16, Counter()
    for size, shard, first, last in plan:
        assert first == seen[size]
        seen[size] = last
        loads[shard] += size * (last - first)
    best = [0] * 16
    for s in sorted(sizes, reverse=True):
        best[best.index(min(best))] += s
    assert seen == counts and sorted(loads) == sorted(best)


def test_sharding(spark):
    rng = random.Random(3)
    texts = ["é" * rng.randint(0, 300) + str(rng.randrange(40)) for _ in range(400)] + [None, "", "same"] + ["same"] * 50
    docs = spark.createDataFrame([(i % 350, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = sharding.assign_shards(spark, docs, 4)[0].collect()
    assert len(rows) == len(texts)
    placed = {}
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1 and placed.setdefault(r.text or "", r.shard) == r.shard
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= 0.02 * sum(loads)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(spark, docs.limit(0), 4)[0].count() == 0


def test_batches_for_workers_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64m")
    bound_batches(spark)
    wide = spark.range(0, 4000, 1, 1).withColumn("text", F.repeat(F.lit("abcdefgh"), 1000))
    sizes = wide.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()
    assert len(sizes) > 5 and max(r.n for r in sizes) <= BATCH_BYTES + 10_000
    spark.conf.set(name, "1m")
    bound_batches(spark)
    assert spark.conf.get(name) == "1m"
    spark.conf.set(name, before)
