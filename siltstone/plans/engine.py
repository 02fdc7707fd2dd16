"""The engine as one object: ingest, search, answers, timetable, upkeep. Every method gives DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone import providers
from siltstone.config import Settings
from siltstone.functions import text as X
from siltstone.functions import vectors as V
from siltstone.operators import chunking, dedup, memory, route, routing, schedule, search, timetable, upkeep
from siltstone.operators.tables import scratch
from siltstone.operators.vector_index import VectorIndex
from siltstone.sources import files, sinks


class Engine:
    """A corpus in a folder: documents, chunks, vectors and the timetable, as Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, embed=None, classify=None, generate=None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), (settings or Settings()).from_environment()
        self.embed, self.classify, self.generate = embed or providers.embed, classify, generate or providers.generate
        if errors := [t for kind, t in self.settings.problems() if kind == "error"]:
            raise ValueError("; ".join(errors))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        if name == "index":  # what was made of it is old now
            self.__dict__.pop("lexical_index", None)
            self.__dict__.pop("vector_index", None)

    def _upsert(self, df: DataFrame, name: str) -> None:
        """Put in place of the rows of df's documents, and keep those of others. df must not read the table."""
        try:
            old = self.table(name)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self._put(df, name)
        self._put(df, f"{name}_new")
        new = self.table(f"{name}_new")
        rest = old.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
        self._put(rest.unionByName(new, allowMissingColumns=True), f"{name}_all")
        self._put(self.table(f"{name}_all"), name)

    def process_folder(self, path: str) -> DataFrame:
        """Read all supported files, chunk, score, merge duplicates and embed; returns one row a file with its error."""
        found = files.extract(files.scan(self.spark, path))
        self._put(found, "read")
        self._upsert(self.table("read"), "documents")
        return self.process_texts(self.table("read"))

    def process_texts(self, docs: DataFrame) -> DataFrame:
        """The same from documents (doc_id, text and what else is known of them). What the corpus has of the same
        documents is replaced, the rest stays."""
        s = self.settings
        self._put(chunking.chunk_documents(docs.where("text is not null"), s.chunk_size, s.chunk_overlap), "cut")
        self._upsert(self.table("cut"), "chunks")
        chunks = self.table("cut").where(X.strip(F.col("text")) != "")
        self._upsert(chunks.withColumn("embedding", self.embed(F.col("text"), s.dimensions)).where("embedding is not null"), "index")
        if s.deduplicate:
            self.deduplicate()
        counts = self.table("cut").groupBy("doc_id").agg(F.count("*").alias("num_chunks"))
        return docs.drop("text").join(counts, "doc_id", "left").withColumn("num_chunks", F.coalesce("num_chunks", F.lit(0)))

    def deduplicate(self) -> DataFrame:
        """Merge chunks that are alike; the report is one row."""
        rows = self.table("index").withColumn("id", F.xxhash64("chunk_id"))
        edges = dedup.links(rows, self.settings.similarity_threshold, "id", "embedding")
        placed = dedup.clusters(self.spark, rows.withColumn("source_file", F.col("doc_id").cast("string")), edges, "id", "information_score")
        merged = dedup.merge_clusters(placed)
        after = dedup.deduplicated(rows, merged)
        self._put(after, "deduplicated")
        return dedup.report(rows, self.table("deduplicated"))

    @cached_property
    def lexical_index(self) -> tuple[DataFrame, DataFrame]:
        postings, idf = search.tfidf(self.table("index").select(F.col("chunk_id").alias("doc_id"), "text"))
        self._put(postings, "postings")
        self._put(idf, "terms")
        return self.table("postings"), self.table("terms")

    def vector(self, query: str) -> list[float]:
        return list(self.spark.range(1).select(self.embed(F.lit(query), self.settings.dimensions).alias("v")).first().v or [0.0] * self.settings.dimensions)

    def search(self, query: str, k: int = 15, doc_id: str | None = None) -> DataFrame:
        """The best k chunks by meaning and words, reranked."""
        index = self.table("index")
        near = search.nearest(index, self.vector(query), k, "chunk_id", "embedding", None if doc_id is None else F.col("doc_id") == doc_id)
        asked = self.spark.createDataFrame([("?", query)], "doc_id string, text string")
        words = search.lexical(*self.lexical_index, asked, max(1, k // 2)).withColumnRenamed("doc_id", "chunk_id")
        hits = index.drop("embedding").join(F.broadcast(search.fuse(near, words, "chunk_id")), "chunk_id").withColumn("semantic_boundary_score", F.lit(0.5))
        return search.rerank(hits, k, "chunk_id")

    def multi_search(self, query: str, k: int = 15) -> DataFrame:
        """The same with up to three longer forms of the query."""
        forms = self.spark.range(1).select(search.expansions(F.lit(query), self.settings.org_name).alias("e")).first().e
        score = lambda df: df.select("chunk_id", F.coalesce("enhanced_score", "score").alias("score"))
        merged = search.multi_query(score(self.search(query, max(1, int(k * 0.6)))), [score(self.search(q, 5)) for q in forms], k, "chunk_id")
        return self.table("index").drop("embedding").join(F.broadcast(merged), "chunk_id").orderBy(F.desc("score"), "chunk_id")

    def similar_chunks(self, chunk_id: str, k: int = 5) -> DataFrame:
        return search.similar_to(self.table("index"), chunk_id, k, "chunk_id", "embedding")

    @cached_property
    def vector_index(self) -> VectorIndex:
        return VectorIndex.build(self.table("index"), scratch(self.spark), "chunk_id", "embedding")

    def schedules(self) -> DataFrame:
        """The timetable; empty before anything was uploaded."""
        try:
            return self.table("schedules")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "class_group string, subject string, day string, start_time string, end_time string, room string")

    def answer_all(self, questions: DataFrame) -> DataFrame:
        """One row for each question (qid, text), answered by its route: the timetable, chunks near in meaning, or both."""

        def near(asked: DataFrame) -> DataFrame:
            vectors = asked.select("qid", self.embed(F.col("text"), self.settings.dimensions).alias("embedding")).where("embedding is not null")
            hits = self.vector_index.search(vectors, route.ALONE, "qid", "embedding")
            return hits.join(self.table("index").select(F.col("chunk_id").alias("id"), "text"), "id").select(F.col("query_id").alias("qid"), F.col("id").alias("key"), "text", "score", "rank")

        return route.answer_questions(questions, self.schedules(), near, classify=self.classify)

    def answer(self, query: str, k: int = 15) -> DataFrame:
        """One row: the question's intent and route, what answered it, the context's sources and the answer.

        The route's answer stands where it has one; else one is made from packed context.
        """
        one = self.spark.createDataFrame([(0, query)], "qid long, text string")
        asked = routing.classify(routing.analyse(one), model=self.classify)
        routed = self.answer_all(one).select("qid", "approach", "result_count", "answer")
        ranked = self.search(query, k).withColumn("rank", F.row_number().over(W.orderBy(F.coalesce("enhanced_score", "score").desc(), "chunk_id")))
        packed = memory.pack_context(ranked, self.settings.context_budget)
        context = packed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"), F.sort_array(F.collect_set("doc_id")).alias("sources"))
        return asked.join(routed, "qid").drop("qid").join(context).withColumn("response", F.coalesce("answer", self.generate(F.col("text"), F.col("context")))).drop("answer")

    def upload_schedule(self, cells: DataFrame, doc_id: str, now=None) -> int:
        """Entries of grids into the timetable; how many."""
        entries = timetable.extract(cells).withColumn("extraction_timestamp", F.lit(None).cast("timestamp"))
        fresh = schedule.with_defaults(entries, doc_id, now if now is not None else F.current_timestamp())
        fresh.write.mode("append").parquet(f"{self.folder}/schedules")
        return self.table("schedules").where(F.col("doc_id") == doc_id).count()

    def statistics(self) -> DataFrame:
        return upkeep.collection_statistics(self.table("index").withColumn("semantic_chunking", F.lit(False)))

    def sound_vectors(self) -> DataFrame:
        return self.table("index").where(V.nonzero(F.col("embedding")))

    def delete_document(self, doc_id: str) -> None:
        """A document out of documents, chunks, index, timetable and the merged set; each table is written anew beside the
        old one. The postings are made anew by the next search."""
        for name in ("documents", "chunks", "index", "schedules"):
            try:
                rows = self.table(name)
            except Exception as e:
                if "PATH_NOT_FOUND" in str(e):
                    continue
                raise
            (left,) = sinks.delete_document(doc_id, rows)
            self._put(left, f"{name}_new")
            self._put(self.table(f"{name}_new"), name)
        merged = dedup.delete_document(self.table("deduplicated"), doc_id) if self.settings.deduplicate else None
        if merged is not None:
            self._put(merged, "deduplicated_new")
            self._put(self.table("deduplicated_new"), "deduplicated")
