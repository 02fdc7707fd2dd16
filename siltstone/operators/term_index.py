"""An inverted index that grows: postings on disk by term, counts kept as deltas, TF-IDF as a fit of all documents gives it.

Documents are tokenised once, when they are added. A batch is a segment: its documents' words, its words' postings in folders
by a hash of the word, and the document frequencies of its words and pairs as a table of differences; a removal is a segment of
negative differences and of ids that are gone. The row in the log that names a segment is written last, so a batch that
failed half-way isn't there. The vocabulary and its idf are sums over the differences; nothing is fitted anew. Pairs have
no postings, as there are about as many as words in all texts: a document with a pair is found by its first word.

A search reads the folders of its own words. Lengths of documents hang on every idf, so each batch changes them all: they
are worked out from the words of the documents that were found, or, after ``refresh``, are part of the weights that
it has written for all. Many searches at once (``best``) go through the documents, block by block, and keep the best of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import lexicons as L
from siltstone.operators.search import slices, tallied, term_counts, terms, weighted, weights_of, worded
from siltstone.operators.tables import bound_batches, cut, saved

BUCKETS = 64
#: Tasks to which the documents of a folder's terms are dealt, weights of a block of documents, blocks of queries.
SHARES, WEIGHTS, QUERY_BLOCKS = 8, 1 << 20, 4
#: Up to this many different terms are named in the scan's filter; more are joined.
NAMED = 2000


def bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


class TermIndex:
    """An index in a folder. Document ids are longs or strings, as the documents that it began with had."""

    def __init__(self, spark: SparkSession, path: str, features: int = 5000, most: float = 0.95, least: int = 2, stop: list[str] = L.STOP_WORDS):
        self.spark, self.path, self.features, self.most, self.least, self.stop = spark, path.rstrip("/"), features, most, least, stop

    @classmethod
    def build(cls, docs: DataFrame, path: str, **settings) -> TermIndex:
        """A new index of docs (doc_id, text)."""
        index = cls(docs.sparkSession, path, **settings)
        docs.select("doc_id").limit(0).write.parquet(f"{index.path}/ids")
        index._log([])
        index.add(docs)
        return index

    def _log(self, rows: list[tuple[int, int, str]]) -> None:
        self.spark.createDataFrame(rows, "seg int, n_docs long, kind string").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def segments(self) -> list[tuple[int, int, str]]:
        """(seg, difference in documents, kind) of each batch that is whole, in order; one row a batch."""
        return sorted(tuple(r) for r in self.spark.read.schema("seg int, n_docs long, kind string").parquet(f"{self.path}/log").collect())

    def _next(self) -> int:
        return max((s for s, _, _ in self.segments()), default=0) + 1

    def _read(self, name: str, columns: str) -> DataFrame:
        """A table's rows of whole segments."""
        done = [s for s, _, kind in self.segments() if kind in ("add", "remove")]
        ids = self.spark.read.parquet(f"{self.path}/ids").schema["doc_id"].dataType.simpleString()
        shape = f"{columns.replace('doc_id', f'doc_id {ids}')}, seg int"
        folders = {"postings": [f"{self.path}/postings"], "documents": [f"{self.path}/documents"], "counts": [f"{self.path}/counts"], "gone": [f"{self.path}/gone"]}[name]
        try:
            return self.spark.read.schema(shape).parquet(*folders).where(F.col("seg").isin(done) if done else F.lit(False))
        except Exception as e:  # nothing was ever written there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], shape)

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (seg, doc_id) without those of documents that are gone since."""
        if not any(kind == "remove" for _, _, kind in self.segments()):
            return rows
        gone = self._read("gone", "doc_id").groupBy("doc_id").agg(F.max("seg").alias("until"))
        return rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["seg"] < gone["until"]), "left_anti")

    def _own(self, seg: int) -> DataFrame:
        """The documents of a segment, whether it is in the log or not."""
        ids = self.spark.read.parquet(f"{self.path}/ids").schema["doc_id"].dataType.simpleString()
        return self.spark.read.schema(f"doc_id {ids}, words string, seg int").parquet(f"{self.path}/documents").where(F.col("seg") == seg)

    def _by_term(self, rows: DataFrame) -> DataFrame:
        """rows (term, doc_id, ...) sorted in folders of their terms, each dealt to several tasks."""
        rows = rows.withColumn("bucket", bucket("term")).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
        return rows.sortWithinPartitions("bucket", "term")

    def add(self, docs: DataFrame) -> None:
        """Documents that the index doesn't have; a null text is empty. Repeated ids would be one document."""
        seg = self._next()
        listed = worded(docs, self.stop).withColumn("seg", F.lit(seg))
        listed.write.mode("append").option("compression", "zstd").partitionBy("seg").parquet(f"{self.path}/documents")
        own = self._own(seg)
        n, ids = own.count(), own.select("doc_id").distinct().count()
        if ids < n:  # two blanks keep the last word of one text and the first of the next from being a pair
            again = saved(own.groupBy("doc_id").agg(F.array_join(F.collect_list("words"), "  ").alias("words")))
            seg += 1
            again.withColumn("seg", F.lit(seg)).write.mode("append").option("compression", "zstd").partitionBy("seg").parquet(f"{self.path}/documents")
            own = self._own(seg)
        id_type = own.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, words in slices(batch.column(1)):
                    text, word, n, names = tallied(words, pairs=False)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(word)).cast(pa.string()), batch.column(0).take(pa.array(text + start)), pa.array(n)], names=["term", "doc_id", "n"])

        bound_batches(self.spark)
        postings = own.select("doc_id", "words").mapInArrow(run, f"term string, doc_id {id_type}, n long")
        self._by_term(postings).withColumn("seg", F.lit(seg)).write.mode("append").option("compression", "zstd").partitionBy("seg", "bucket").parquet(f"{self.path}/postings")
        term_counts(own).withColumn("seg", F.lit(seg)).write.mode("append").option("compression", "zstd").partitionBy("seg").parquet(f"{self.path}/counts")
        self._log([(seg, ids, "add")])

    def _documents(self) -> DataFrame:
        """(doc_id, words) of all documents that aren't gone."""
        return self._live(self._read("documents", "doc_id, words string")).select("doc_id", "words")

    def remove(self, ids: DataFrame) -> None:
        """Documents (doc_id) out of the index; those that it doesn't have are passed over."""
        seg = self._next()
        gone = saved(self._documents().join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
        term_counts(gone, -1).withColumn("seg", F.lit(seg)).write.mode("append").option("compression", "zstd").partitionBy("seg").parquet(f"{self.path}/counts")
        gone.select("doc_id").distinct().withColumn("seg", F.lit(seg)).write.mode("append").partitionBy("seg").parquet(f"{self.path}/gone")
        self._log([(seg, -gone.count(), "remove")])

    def vocabulary(self) -> DataFrame:
        """(term, idf) of the terms that a fit of all documents keeps: at most ``features`` rows, so it may be broadcast."""
        n = sum(d for _, d, _ in self.segments())
        sums = self._read("counts", "term string, df long, cf long")
        if sum(kind != "weights" for _, _, kind in self.segments()) > 1:  # one segment has each term once
            sums = sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        kept = sums.where((F.col("df") >= self.least) & (F.col("df") <= self.most * n)).orderBy(F.desc("cf"), "term").limit(self.features)
        return kept.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))

    def refresh(self) -> None:
        """Write the weights of all postings as they are now; searches read them until the next batch."""
        version = max((s for s, _, kind in self.segments() if kind != "weights"), default=0)
        if any((s, kind) == (version, "weights") for s, _, kind in self.segments()):
            return
        idf = cut(self.vocabulary())
        weights = self._by_term(weighted(self._documents(), idf))
        weights.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/weights/{version}")
        idf.write.mode("overwrite").parquet(f"{self.path}/idf/{version}")
        self._log([(version, 0, "weights")])

    def _asked(self, idf: DataFrame, queries: DataFrame) -> DataFrame:
        x = terms(queries, self.stop).join(F.broadcast(idf), "term").withColumn("x", F.col("n") * F.col("idf"))
        length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("doc_id")))
        return cut(x.select(F.col("doc_id").alias("query_id"), "term", "idf", (F.col("x") / length).alias("q")))

    def _named(self, postings: DataFrame, asked: DataFrame) -> DataFrame:
        """postings cut down to the folders and terms that are asked for, if these can be named."""
        words = [r.term for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        if len(words) > NAMED:
            return postings
        folders = sorted({r.b for r in asked.select(bucket("term").alias("b")).distinct().collect()})
        return postings.where(F.col("bucket").isin(folders) & F.col("term").isin(words))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score): the cosine of each query (doc_id, text) with each document that has a term of it."""
        segments = self.segments()
        version = max((s for s, _, kind in segments if kind != "weights"), default=0)
        if any((s, kind) == (version, "weights") for s, _, kind in segments):
            asked = self._asked(self.spark.read.parquet(f"{self.path}/idf/{version}"), queries)
            ids = self.spark.read.parquet(f"{self.path}/ids").schema["doc_id"].dataType.simpleString()
            weights = self.spark.read.schema(f"term string, doc_id {ids}, w double, bucket int").parquet(f"{self.path}/weights/{version}")
            return self._named(weights, asked).join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))
        idf = cut(self.vocabulary())
        asked = self._asked(idf, queries)
        words = cut(asked.select(F.split("term", " ")[0].alias("term")).distinct())
        found = self._named(self._live(self._read("postings", "term string, doc_id, n long, bucket int")), words).join(F.broadcast(words), "term")
        x = weighted(self._documents().join(found.select("doc_id").distinct(), "doc_id", "left_semi"), idf)
        return x.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))

    def best(self, queries: DataFrame, k: int, floor: float = 0.1, digits: int = 9) -> DataFrame:
        """(query_id, doc_id, score, rank): the k documents of the greatest cosine with each query, ties of so many digits by
        id; of these, those over the floor. For many queries: blocks of documents are scored with blocks of queries in tasks,
        and only the best k of each leave them, so what is shuffled doesn't grow with queries times documents.

        queries are broadcast: their terms are far fewer than those of the documents.
        """
        idf = cut(self.vocabulary())
        asked, of, docs = self._asked(idf, queries), weights_of(idf), self._documents()
        id_type, query_type = docs.schema["doc_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def out() -> pa.RecordBatch:
                ids, text, term, w = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))))
                order = np.argsort(term, kind="stable")
                blobs = [pa.array([x[order].astype(t).tobytes()], pa.binary()) for x, t in ((text, np.int32), (term, np.int32), (w, np.float64))]
                return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *blobs], names=["ids", "text", "term", "w"])

            n = 0
            for batch in batches:
                for start, words in slices(batch.column(1)):
                    text, term, w = of(words)
                    held.append((batch.column(0).slice(start, len(words)), text + n, term, w))
                    n, size = n + len(words), size + len(w)
                    if size > WEIGHTS:
                        yield out()
                        held, size, n = [], 0, 0
            if held:
                yield out()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = {t: i for i, t in enumerate(of.terms)}
            for batch in batches:
                for r in range(batch.num_rows):
                    ids = batch.column(0)[r].values
                    text, term, w = (np.frombuffer(batch.column(c)[r].as_buffer(), dtype=t) for c, t in ((1, np.int32), (2, np.int32), (3, np.float64)))
                    ends = np.searchsorted(term, np.arange(len(of.terms) + 1))
                    # places of ids in their order, for ties
                    rank = np.empty(len(ids), dtype=np.int64)
                    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    found = []
                    for q, query in enumerate(batch.column(4)[r].values.to_pylist()):
                        total = np.zeros(len(ids))
                        for name, value in sorted(zip(query["terms"], query["qs"])):
                            own = slice(ends[at[name]], ends[at[name] + 1])
                            total[text[own]] += w[own] * value
                        over = np.flatnonzero(total > floor)
                        if len(over) > 4 * k:
                            over = over[total[over] >= np.partition(total[over], -k)[-k] - 10.0**-digits]
                        over = over[np.lexsort((rank[over], -np.round(total[over], digits)))[:k]]
                        found.append((np.full(len(over), q), over, total[over]))
                    q, doc, value = (np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.zeros(0, np.int64),) * 3
                    asked_ids = batch.column(4)[r].values.field("query_id")
                    yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(q)), ids.take(pa.array(doc)), pa.array(value.astype(float))], names=["query_id", "doc_id", "score"])

        bound_batches(self.spark)
        one = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("q").alias("qs"))
        listed = one.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(QUERY_BLOCKS)).alias("block")).agg(F.collect_list(F.struct("query_id", "terms", "qs")).alias("queries")).drop("block")
        blocks = docs.mapInArrow(pack, f"ids array<{id_type}>, text binary, term binary, w binary")
        hits = blocks.crossJoin(F.broadcast(listed)).mapInArrow(score, f"query_id {query_type}, doc_id {id_type}, score double")
        order = W.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "doc_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, floor: float = 0.1) -> DataFrame:
        """(query_id, doc_id, score, rank): the k documents of the greatest cosine with each query, ties by id; of these, those over the floor."""
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return self.scores(queries).withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= k) & (F.col("score") > floor))
