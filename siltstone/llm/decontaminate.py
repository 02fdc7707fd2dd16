"""Benchmark decontamination: rare n-gram seeds join documents to items, then Smith-Waterman alignment of words.

The n-grams of the benchmark make a bit filter of bounded size, by which one scan of the documents keeps the places of
n-grams that may be in the benchmark; a join with the benchmark's n-grams makes that exact. Their document frequencies
over the whole corpus order each item's n-grams, and the rarest are its seeds: as many as a copy with the allowed edits
can't lose all of. A document with a seed of an item, and with as many of its n-grams as a copy must keep, is a
candidate. Candidates whose shared n-grams lie along one diagonal are aligned by Smith-Waterman, which scores
verbatim, edited and partly reordered copies alike.

Everything grows as documents and benchmark do; neither is held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.store import drop_saved, number_rows, release, save
from siltstone.llm.words import WordHasher, batches_of, finish, shingles

#: Words of an n-gram at most; items of few words take shorter ones, those of fewer words than this stand as whole lines.
GRAM = 3
#: Bits of the filter for each n-gram of the benchmark, and of the whole filter at most (128 MB).
FILTER, MOST_BITS = 256, 1 << 30
#: Items that a candidate document is aligned with at once.
ITEMS = 256
#: Alignment: an equal word, another word, a word left out or put in.
MATCH, OTHER, GAP = 1.0, -0.5, 0.5
LINE = np.uint64(0x2B7E151628AED2A6)


def edits(length: int, similarity: float) -> int:
    """Words of an item that a copy may have replaced, left out or put in."""
    return int((1 - similarity) * length + 1e-9)


def gram_size(length: int, similarity: float) -> int:
    """The longest n-gram, up to GRAM words, of which a copy of an item keeps one whatever its edits are."""
    return max(1, min(GRAM, length // (edits(length, similarity) + 1)))


def needed(length: int, similarity: float) -> int:
    """n-grams that a copy of an item keeps at least."""
    size = gram_size(length, similarity)
    return max(1, length - size + 1 - size * edits(length, similarity))


def line_key(words: np.ndarray) -> np.ndarray:
    """The key of a short item, which stands for a whole line."""
    return finish(shingles(words, GRAM) ^ LINE)


def item_grams(words: np.ndarray, similarity: float) -> np.ndarray:
    return line_key(words) if len(words) < GRAM else shingles(words, gram_size(len(words), similarity))


def short_lines(text: str, hasher: WordHasher) -> tuple[list[int], list[np.ndarray]]:
    """The places (in words) and words of a text's lines of 1 to GRAM - 1 words."""
    at, places, found = 0, [], []
    for line in text.split("\n"):
        words = hasher.words(line)
        if 0 < len(words) < GRAM:
            places.append(at)
            found.append(hasher.hashes(words))
        at += len(words)
    return places, found


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """The best local alignment's score, and the place in words where it ends."""
    best, end = 0.0, 0
    row = np.zeros(len(words) + 1)
    along = GAP * np.arange(len(words) + 1)
    for w in item:
        step = np.zeros(len(words) + 1)
        step[1:] = np.maximum(row[:-1] + np.where(words == w, MATCH, OTHER), row[1:] - GAP)
        row = np.maximum.accumulate(np.maximum(step, 0) + along) - along
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def copy_of(item: np.ndarray, words: np.ndarray, grams: dict[int, np.ndarray], similarity: float) -> tuple[float, int, int] | None:
    """(share of the item's words, first word, words) of the best copy of an item in a document's words.

    grams keeps the document's n-grams by their size.
    """
    size = gram_size(len(item), similarity)
    if size not in grams:
        grams[size] = shingles(words, size) if len(words) >= size else np.empty(0, np.uint64)
    own = shingles(item, size)
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(own[order], grams[size])
    held = np.flatnonzero(own[order][np.minimum(at, len(own) - 1)] == grams[size])
    if not len(held):
        return None
    left, right = at[held], np.searchsorted(own[order], grams[size][held], "right")
    counts = right - left
    place = order[np.repeat(left - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    diagonal = np.sort(np.repeat(held, counts) - place)
    enough, slack = needed(len(item), similarity), edits(len(item), similarity) + 1
    best, done = (0.0, 0, 0), -len(words) - len(item)
    for s in np.flatnonzero(np.searchsorted(diagonal, diagonal + 2 * slack, "right") - np.arange(len(diagonal)) >= enough):
        if diagonal[s] + 2 * slack <= done:
            continue
        low = max(0, int(diagonal[s]) - slack)
        done = int(diagonal[s]) + 4 * slack
        part = words[low : max(0, done) + len(item) + slack]
        score, end = align(item, part)
        if score > best[0]:
            _, back = align(item[::-1], part[:end][::-1])
            best = (score, low + end - back, back)
    # an edit costs a match and half of one
    return (best[0] / len(item), best[1], best[2]) if best[0] >= (similarity * (MATCH - OTHER) + OTHER) * len(item) - 1e-9 else None


def benchmark_grams(items: DataFrame, similarity: float) -> DataFrame:
    """(gram, iid, need, size) of items (iid, text), a row for each place; items without words have none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in it:
            for start, texts in batches_of(batch.column(1)):
                words = [hasher(t) for t in texts]
                keys = [item_grams(w, similarity) for w in words]
                n = [len(k) for k in keys]
                length = np.array([len(w) for w in words], dtype=np.int32)
                size = np.array([0 if x < GRAM else gram_size(int(x), similarity) for x in length], dtype=np.int32)
                need = np.array([1 if x < GRAM else needed(int(x), similarity) for x in length], dtype=np.int32)
                iid = batch.column(0).slice(start, len(texts)).to_numpy()
                yield pa.RecordBatch.from_pydict({"gram": np.concatenate(keys).view(np.int64), "iid": np.repeat(iid, n), "need": np.repeat(need, n), "size": np.repeat(size, n)})

    return items.mapInArrow(run, "gram long, iid long, need int, size int")


def bit_filter(grams: DataFrame) -> np.ndarray:
    """A bit for the highest bits of each gram, FILTER bits a gram but MOST_BITS in all: what it lets through too much
    goes in the join."""
    distinct = grams.select("gram").distinct()
    bits = min(MOST_BITS, max(4096, 1 << (distinct.count() * FILTER).bit_length()))
    slot = F.shiftrightunsigned("gram", 64 - (bits.bit_length() - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    table = distinct.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def places_of_grams(spark: SparkSession, source: DataFrame, known: np.ndarray, sizes: list[int]) -> DataFrame:
    """(gram, uid) of source (uid, text), a row for each place of an n-gram of one of the sizes that the filter lets
    through; size 0 stands for short lines."""
    shared = spark.sparkContext.broadcast(known)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher = shared.value, WordHasher()
        shift = np.uint64(64 - (len(bits) * 64).bit_length() + 1)

        def passed(keys: np.ndarray) -> np.ndarray:
            slot = keys >> shift
            return np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))

        for batch in it:
            for start, texts in batches_of(batch.column(1), 2 << 20):
                uid = batch.column(0).slice(start, len(texts)).to_numpy()
                hashed = [hasher(t) for t in texts]
                n = np.array([len(h) for h in hashed], dtype=np.int64)
                flat, of = np.concatenate(hashed), np.repeat(np.arange(len(texts)), n)
                for size in sizes:
                    if size:
                        if len(flat) < size:
                            continue
                        keys = shingles(flat, size)
                        at = passed(keys)
                        at = at[of[at] == of[at + size - 1]]  # not over the end of a text
                        keys, rows = keys[at], of[at]
                    else:
                        found = [(i, line_key(w)[0]) for i, t in enumerate(texts) if t for w in short_lines(t, hasher)[1]]
                        keys, rows = np.array([k for _, k in found], dtype=np.uint64), np.array([i for i, _ in found], dtype=np.int64)
                        at = passed(keys)
                        keys, rows = keys[at], rows[at]
                    yield pa.RecordBatch.from_pydict({"gram": keys.view(np.int64), "uid": uid[rows]})

    return source.mapInArrow(run, "gram long, uid long")


def copies(spark: SparkSession, source: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(uid, iid, score, first_word, n_words), saved: copies of items (iid, text) in source (uid, text)."""
    grams = save(spark, benchmark_grams(items, similarity))
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # 0 to GRAM
    n_items = items.count()
    counted = save(spark, places_of_grams(spark, source, bit_filter(grams), sizes).groupBy("uid", "gram").agg(F.count("*").alias("n")))
    known = grams.select("gram").distinct()
    frequency = counted.join(known, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    lengths = grams.groupBy("iid").agg(F.max("need").alias("need"), F.count("*").alias("grams"))
    rarest = Window.partitionBy("iid").orderBy(F.coalesce("df", F.lit(0)), "gram")
    ranked = grams.select("gram", "iid").join(frequency, "gram", "left").withColumn("place", F.row_number().over(rarest)).join(lengths, "iid")
    marked = ranked.groupBy("gram", "iid", "need").agg(F.max(F.col("place") <= F.col("grams") - F.col("need") + 1).alias("seed"))
    pairs = counted.join(marked, "gram").groupBy("uid", "iid", "need").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")).where("seed and n >= need").select("uid", "iid")
    parts = -(-max(1, n_items) // ITEMS)
    listed = pairs.join(items, "iid").groupBy("uid", F.pmod(F.xxhash64("iid"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("iid", F.col("text").alias("item"))).alias("items"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in it:
            rows = []
            for i in range(batch.num_rows):
                uid, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                words, kept, lines = hasher(text), {}, None
                for part in batch.column(2)[i].as_py():
                    item = hasher(part["item"])
                    if len(item) >= GRAM:
                        found = copy_of(item, words, kept, similarity)
                    else:
                        lines = lines or short_lines(text, hasher)
                        found = next(((1.0, at, len(item)) for at, w in zip(*lines) if np.array_equal(w, item)), None)
                    if found:
                        rows.append((uid, part["iid"], *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["uid", "iid", "score", "first_word", "n_words"])

    found = save(spark, source.join(listed.hint("merge"), "uid").select("uid", "text", "items").mapInArrow(run, "uid long, iid long, score double, first_word long, n_words long"))
    drop_saved(spark, grams, counted)
    release(spark)
    return found


def numbered(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float, text: str, item_id: str, item_text: str) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """A saved copy of docs with a row id, that id's name, the benchmark as (iid, item_id, text), and the copies."""
    copy, rid = number_rows(spark, docs)
    slim, iid = number_rows(spark, benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text is not null"))
    items = slim.withColumnRenamed(iid, "iid")
    source = copy.select(F.col(rid).alias("uid"), F.col(f"`{text}`").alias("text"))
    return copy, rid, items, copies(spark, source, items.select("iid", "text"), similarity)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and benchmark item of which it holds a copy.

    Columns: doc_id, item_id, score (alignment score by the item's words; 1 is verbatim), first_word and n_words of
    the aligned passage. A copy may have the share 1 - similarity of the item's words replaced, left out or put in;
    under 1 / (1 - similarity) words that is none. An item of fewer than GRAM words is held where it is a whole line.
    Ids of any type, null ones too, are carried along. Null or empty texts hold and are nothing; repeated rows of docs
    give a row each, equal items under different ids too. A text may be of any length. Either table empty gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    copy, rid, items, found = numbered(spark, slim, benchmark, similarity, "text", item_id, item_text)
    rows = found.join(copy.select(F.col(rid).alias("uid"), "doc_id"), "uid").join(items.select("iid", "item_id"), "iid")
    return rows.select("doc_id", "item_id", "score", "first_word", "n_words")


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that hold a copy of a benchmark item, as find_leaks finds them; all columns stay."""
    copy, rid, _, found = numbered(spark, docs, benchmark, similarity, text, item_id, item_text)
    gone = found.select(F.col("uid").alias(rid)).distinct()
    return copy.join(gone, rid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against benchmark: every document and item it holds a copy of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
SQL: dict[str, str] = {}
