"""Language-model scores by deleted interpolation of a word bigram model.

Maximum-likelihood estimates of a token given the word before it, of a token alone, and the uniform one are mixed by
weights that depend on how often the context was seen. The weights are learned by expectation-maximisation: a fold of
the training texts is deleted from the counts and its tokens are the held-out events.

Counts never leave the cluster. Texts are dealt into blocks of bounded size. A block asks once for each distinct word
and word pair it holds, with its own counts; requests are cut into buckets by the keys' highest bits and packed. Sums
by key go back to the blocks that asked, in the order they asked. Texts and answers meet again by block, so a frequent
word costs an entry a block, not one an occurrence.

Requests are summed as a tree. Up to FAN blocks are summed at once; of more, each FAN make a group, whose merged
requests are cut FAN times finer and summed in the same way, and its answers are dealt back to its members. So a
request has about as many keys at every level, there are as many requests as the text is long, and no task holds more
than FAN of them, however large the corpus and however frequent a word.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.language_id import fold
from siltstone.llm.store import rank_in, release, save
from siltstone.llm.words import MIX, WordHasher, finish

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
#: Bits of a key that are a block's bucket, and those that a level of the tree adds: blocks summed at once.
BITS, FAN_BITS = 8, 8
#: Hashes that stand for the end of a text, a token, and for its beginning, a context only.
END, START = np.uint64(0x1F83D9ABFB41BD6A), np.uint64(0x5BE0CD19137E2178)
#: Classes of context frequency (0, then powers of two), and steps of log10 probabilities per unit, with the last step for 0.
CLASSES, STEPS, ZERO = 42, 20, 320
#: Rounds of expectation-maximisation, and how many events the weights of all contexts count for in each class.
ROUNDS, PRIOR = 60, 20.0


@cache
def hasher() -> WordHasher:
    return WordHasher(250_000)


def tokens_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's tokens, its end included, and of the contexts before them."""
    words = hasher()(text)
    return np.append(words, END), np.insert(words, 0, START)


def unigram_keys(h: np.ndarray) -> np.ndarray:
    """The lowest bit marks a key of a single token."""
    return finish(h) | np.uint64(1)


def bigram_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return finish((context * MIX) ^ (token + np.uint64(0x2545F4914F6CDD1D))) & ~np.uint64(1)


class Block:
    """The tokens of a block's texts, and its distinct keys with their counts in training and in the deleted fold."""

    def __init__(self, texts: list, train: list[bool], deleted: list[bool]):
        pairs = [tokens_of(t) for t in texts]
        self.sizes = np.array([len(t) for t, _ in pairs])
        token, context = np.concatenate([t for t, _ in pairs]), np.concatenate([c for _, c in pairs])
        self.keys, at = np.unique(np.concatenate([unigram_keys(token), bigram_keys(context, token)]), return_inverse=True)
        n = len(token)
        self.one, self.two = at[:n], at[n:]
        # the context of a token is the one before it; a text's first has the end's count, as there are as many beginnings
        self.before = np.roll(self.one, 1)
        self.before[np.cumsum(np.r_[0, self.sizes[:-1]])] = self.one[-1]
        self.train, self.deleted = (np.repeat(np.array(x, dtype=bool), self.sizes) for x in (train, deleted))
        both = np.concatenate([self.one, self.two])
        self.n_train, self.n_deleted = (np.bincount(both[np.tile(x, 2)], minlength=len(self.keys)) for x in (self.train, self.deleted))

    def answer(self, answers: pa.Table) -> None:
        """Put the sums over all blocks, in the order of the keys, in place of the block's own counts."""
        order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        parts = [unpack(answers.column("sums")[int(i)].as_py(), np.int64, np.int64) for i in order]
        given = sum(len(t) for t, _ in parts)
        if given != len(self.keys):
            raise ValueError(f"{given} sums for {len(self.keys)} keys of a block")
        self.n_train, self.n_deleted = (np.concatenate(x) for x in zip(*parts))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed byte by byte: first all lowest bytes, then all next ones."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return struct.pack("<I", len(arrays[0])) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n, data, at, out = struct.unpack("<I", blob[:4])[0], zstandard.ZstdDecompressor().decompress(blob[4:]), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += n * size
    return out


def blocks_of(docs: DataFrame, text: str) -> DataFrame:
    """docs with a block number as last column: rows of one partition up to BLOCK_BYTES of text."""
    from pyspark.sql import types as T

    at = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 32, 0
        for batch in it:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64) + used
            used = int(ends[-1]) if len(ends) else used
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + ends // BLOCK_BYTES, pa.int64())], names=[*batch.schema.names, "block_"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("block_", T.LongType())]))


def requests(blocks: DataFrame) -> DataFrame:
    """(bucket, block_, asked): each block's sorted distinct keys and counts, cut by the keys' highest bits.

    A saved block may be read in several parts, as Spark splits files at row groups; each part then asks on its own.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        now = None

        def flush() -> pa.RecordBatch:
            block = Block(*held)
            bucket = (block.keys >> np.uint64(64 - BITS)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            asked = [packed_request(block.keys[a:b], block.n_train[a:b], block.n_deleted[a:b]) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_pydict({"bucket": bucket[cuts[:-1]], "block_": np.full(len(asked), now), "asked": pa.array(asked, pa.binary())})

        for batch in it:
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and number[a] != now:
                    yield flush()
                    held = [[], [], []]
                now = int(number[a])
                for i in range(3):
                    held[i] += batch.column(i + 1).slice(a, b - a).to_pylist()
        if now is not None:
            yield flush()

    return blocks.select("block_", "text", "train", "deleted").mapInArrow(run, "bucket long, block_ long, asked binary")


SUMS = "block_ long, bucket long, for_fold boolean, sums binary"
TOTALS = ["n_train", "n_deleted", "v_train", "v_left"]


class Merge:
    """Sums of requests of one bucket. parts: (asker, packed request) in the order of askers, whose parts follow each
    other."""

    def __init__(self, parts: list[tuple[int, bytes]]):
        self.askers = np.array([a for a, _ in parts])
        found = [unpack(blob, np.uint64, np.int64, np.int64) for _, blob in parts]
        self.sizes = np.array([len(k) for k, _, _ in found])
        key = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in found])
        train, deleted = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        self.held = deleted
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        self.keys = key[order][starts]
        self.train, self.deleted = (np.add.reduceat(x[order], starts) for x in (train, deleted))
        self.back = np.empty(len(key), np.int64)
        self.back[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))

    def answers(self, bucket: int, train: np.ndarray, deleted: np.ndarray, fold: bool) -> dict[str, pa.Array]:
        """The columns SUMS: packed sums in the order of each asker's distinct keys, in however many parts it asked; with
        ``fold`` also those of its keys in deleted texts alone."""
        ends = np.cumsum(self.sizes)
        first = np.flatnonzero(np.r_[True, np.diff(self.askers) != 0])
        rows = []
        for a, b in zip(first, np.r_[first[1:], len(self.askers)]):
            span = slice(ends[a] - self.sizes[a], ends[b - 1])
            for some in (self.back[span], self.back[span][self.held[span] > 0] if fold else None):
                if some is not None and len(some):
                    some = np.unique(some) if b > a + 1 else some
                    rows.append((int(self.askers[a]), bucket, len(rows) > 0 and rows[-1][0] == int(self.askers[a]), pack(train[some], deleted[some])))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return {name.split()[0]: pa.array(c, k) for name, c, k in zip(SUMS.split(", "), zip(*rows), kinds)}


def packed_request(keys: np.ndarray, train: np.ndarray, deleted: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), train.astype(np.int64), deleted.astype(np.int64))


def groups_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple[int, bytes]]]]:
    """Rows (group, bucket, asker, blob), sorted, as ((group, bucket), [(asker, blob), ...])."""
    held: list[tuple[int, bytes]] = []
    now = None
    for batch in it:
        for group, bucket, asker, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and (group, bucket) != now:
                yield now, held
                held = []
            now = (group, bucket)
            held.append((asker, blob))
    if held:
        yield now, held


def sum_requests(spark: SparkSession, asked: DataFrame, blocks: DataFrame, n: int, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Sums over all blocks for each block and bucket of asked (bucket, block_, asked), and a table of totals.

    blocks has each of the ``n`` values of block_. Sums come in the order of the block's distinct keys. The totals, of
    single tokens, are rows to be added up.
    """
    fold = bits == BITS
    if n <= 1 << FAN_BITS:

        def top(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, bucket), held in groups_of(it):
                merged = Merge(held)
                single = (merged.keys & np.uint64(1)) == 1
                t, d = merged.train[single], merged.deleted[single]
                out = merged.answers(bucket, merged.train, merged.deleted, fold)
                rest = [0] * (len(out["block_"]) - 1)
                counts = {name: pa.array([int(v), *rest], pa.int64()) for name, v in zip(TOTALS, (t.sum(), d.sum(), (t > 0).sum(), (t > d).sum()))}
                yield pa.RecordBatch.from_pydict(out | counts)

        rows = dealt(asked.select(F.lit(0).cast("long").alias("group"), "bucket", F.col("block_").alias("asker"), F.col("asked").alias("blob")))
        out = save(spark, rows.mapInArrow(top, SUMS + "".join(f", {name} long" for name in TOTALS)))
        return out.select("block_", "bucket", "for_fold", "sums"), out.select(*TOTALS)
    marked, rank = rank_in(spark, blocks.withColumn("all", F.lit(0)), "all", "block_")
    numbered = save(spark, marked.select("block_", F.shiftright(rank, FAN_BITS).alias("group")))
    grouped = save(spark, asked.join(numbered, "block_").select("group", "bucket", F.col("block_").alias("asker"), F.col("asked").alias("blob")))

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, _), held in groups_of(it):
            merged = Merge(held)
            fine = (merged.keys >> np.uint64(64 - bits - FAN_BITS)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(fine)) + 1).tolist(), len(fine)]
            blobs = [packed_request(merged.keys[a:b], merged.train[a:b], merged.deleted[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pydict({"bucket": fine[cuts[:-1]], "block_": np.full(len(blobs), group), "asked": pa.array(blobs, pa.binary())})

    above = numbered.select(F.col("group").alias("block_")).distinct()
    sums, totals = sum_requests(spark, dealt(grouped).mapInArrow(merge, "bucket long, block_ long, asked binary"), above, -(-n >> FAN_BITS), bits + FAN_BITS)

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bucket), held in groups_of(it):
            merged = Merge([x for x in held if x[0] >= 0])
            train, deleted = (np.concatenate(x) for x in zip(*(unpack(blob, np.int64, np.int64) for asker, blob in held if asker < 0)))
            yield pa.RecordBatch.from_pydict(merged.answers(bucket, train, deleted, fold))

    # the sums of a group stand before its members' requests, in the order of their finer buckets
    down = sums.select(F.col("block_").alias("group"), F.shiftright("bucket", FAN_BITS).alias("bucket"), (F.col("bucket") - F.lit(1 << 62)).alias("asker"), F.col("sums").alias("blob"))
    return save(spark, dealt(grouped.unionAll(down)).mapInArrow(split, SUMS)), totals


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("group", "bucket").sortWithinPartitions("group", "bucket", "asker")


def context_class(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(np.int64)


def ratio(a: np.ndarray, b) -> np.ndarray:
    return a / np.maximum(b, 1)


def step(p: np.ndarray) -> np.ndarray:
    """Probabilities in steps of their logarithm; ZERO for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-STEPS * np.log10(np.maximum(p, 1e-300))), ZERO - 1), ZERO).astype(np.int64)


def events(left: int):
    """Held-out events of a block's deleted texts, as counts by context class and steps of both estimates."""

    def run(texts: pa.Table, answered: pa.Table) -> pa.Table:
        empty = {k: pa.array([], pa.int64()) for k in ("cls", "p1", "p2", "n")}
        if not texts.num_rows:
            return pa.table(empty)
        block = Block(*(texts.column(c).to_pylist() for c in ("text", "train", "deleted")))
        block.answer(answered)
        rest = block.n_train - block.n_deleted
        cls = context_class(rest[block.before])
        p1, p2 = step(ratio(rest[block.one], left)), step(ratio(rest[block.two], rest[block.before]))
        code, n = np.unique((cls * (ZERO + 1) + p1) * (ZERO + 1) + p2, return_counts=True)
        return pa.table({"cls": code // (ZERO + 1) ** 2, "p1": code // (ZERO + 1) % (ZERO + 1), "p2": code % (ZERO + 1), "n": n})

    return run


def learn(cls: np.ndarray, p1: np.ndarray, p2: np.ndarray, n: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (class x bigram, unigram, uniform) by expectation-maximisation over counted events.

    Each class starts from, and is held to by PRIOR events, the weights of all classes together. Without events all
    weights are equal.
    """

    def value(s: np.ndarray) -> np.ndarray:
        return np.where(s == ZERO, 0.0, 10.0 ** (-s / STEPS))

    p = np.stack([value(p2), value(p1), np.full(len(n), uniform)], axis=1)
    pooled = np.full(3, 1 / 3)
    if not len(n):
        return np.tile(pooled, (CLASSES, 1))
    for _ in range(ROUNDS):
        share = p * pooled
        pooled = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0)
        pooled /= pooled.sum()
    weights = np.tile(pooled, (CLASSES, 1))
    for _ in range(ROUNDS):
        share = p * weights[cls]
        share *= (n / share.sum(1))[:, None]
        sums = PRIOR * np.tile(pooled, (CLASSES, 1))
        for k in range(3):
            sums[:, k] += np.bincount(cls, share[:, k], CLASSES)
        weights = sums / sums.sum(1, keepdims=True)
    return weights


def scores(total: int, vocabulary: int, weights: np.ndarray):
    """Scores of a block's texts."""

    def run(texts: pa.Table, answered: pa.Table) -> pa.Table:
        names = ["n_tokens", "n_known", "base_score", "score"]
        kept = texts.select(["doc_id", "train"])
        if not texts.num_rows:
            return kept.append_column("n_tokens", pa.array([], pa.int64())).append_column("n_known", pa.array([], pa.int64())).append_column("base_score", pa.array([], pa.float64())).append_column("score", pa.array([], pa.float64()))
        block = Block(*(texts.column(c).to_pylist() for c in ("text", "train", "deleted")))
        block.answer(answered)
        c1, c2, ch = (block.n_train[x].astype(np.float64) for x in (block.one, block.two, block.before))
        w = weights[context_class(ch)]
        w = np.where((ch > 0)[:, None], w, np.c_[np.zeros(len(w)), w[:, 1:] / w[:, 1:].sum(1, keepdims=True)])
        if not total:
            w = np.tile([0.0, 0.0, 1.0], (len(w), 1))
        mixed = w[:, 0] * ratio(c2, ch) + w[:, 1] * ratio(c1, total) + w[:, 2] / (vocabulary + 1)
        base = np.log10((c1 + 0.5) / (total + 0.5 * (vocabulary + 1)))
        starts = np.cumsum(np.r_[0, block.sizes])[:-1]
        sums = [np.add.reduceat(x, starts) for x in (np.ones(len(c1), np.int64), (c1 > 0).astype(np.int64), base, np.log10(mixed))]
        for name, x in zip(names, sums):
            kept = kept.append_column(name, pa.array(x))
        return kept

    return run


def score_texts(spark: SparkSession, docs: DataFrame, train: str = "train", deleted: str = "deleted", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Scores of all texts under a model of those marked by ``train``; ``deleted`` marks the fold for the weights.

    Returns, for each row of docs: doc_id, train, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (add-half unigram) and score (the model), both log10 probabilities of the whole text. A
    null text is empty and has its end alone; repeated rows count each. Without training texts every token has
    probability 1 (an empty vocabulary beside the unknown). An empty table gives no rows; other columns are left out.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(train).alias("train"), (F.col(train) & F.col(deleted)).alias("deleted"))
    blocks = save(spark, blocks_of(slim, "text"))
    numbers = save(spark, blocks.select("block_").distinct())
    packed, totals = sum_requests(spark, requests(blocks), numbers, numbers.count())
    release(spark)
    total, gone, vocabulary, left = (x or 0 for x in totals.agg(*(F.sum(c) for c in TOTALS)).first())
    by = lambda df: df.groupBy("block_")
    counted = by(blocks.where("deleted")).cogroup(by(packed.where("for_fold"))).applyInArrow(events(total - gone), "cls long, p1 long, p2 long, n long")
    #: CLASSES * (ZERO + 1) ** 2 rows at most, whatever the corpus
    table = counted.groupBy("cls", "p1", "p2").agg(F.sum("n").alias("n")).toArrow()
    weights = learn(*(table.column(c).to_numpy() for c in ("cls", "p1", "p2", "n")), 1 / (left + 1))
    release(spark)
    kind = slim.schema["doc_id"].dataType.simpleString()
    found = by(blocks).cogroup(by(packed.where("not for_fold"))).applyInArrow(scores(total, vocabulary, weights), f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(total).cast("long"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: all scored, learned from four of five folds, with one of these deleted to learn the weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = docs.withColumns({"train": fold("doc_id", 5) != 1, "deleted": fold("doc_id", 5) == 3})
    found = score_texts(spark, marked)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_score": op10_lm_score}
SQL: dict[str, str] = {}
