"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all labelled training texts are gathered per task, summed by Spark, and make a matrix of log probabilities
(BUCKETS x languages), which is broadcast. Texts are scored in batches: the n-grams of all whole texts of a batch are a
sparse matrix of (text, bucket) places, of which each piece of bounded length is multiplied with the log probabilities
and added to the texts' sums. More labels than MOST_LANGUAGES make several matrices, each with a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.store import bound_batches, fresh
from siltstone.llm.words import batches_of, tidy

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Labels of one matrix, about: it stays under 128 MB.
MOST_LANGUAGES = 256
#: Additive smoothing of bucket counts.
SMOOTH = 0.5
#: Code points hashed at once.
PIECE = 1 << 18
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Languages in order, log probabilities of buckets (BUCKETS x languages) and how many texts each was learned from."""

    languages: list[str]
    table: np.ndarray
    texts: np.ndarray


def grams_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, buckets) of all character n-grams of the lower-cased texts, piece by piece; white space is blank."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    flat = np.concatenate([*codes, np.empty(0, np.uint32)])
    flat[(flat >= 9) & (flat <= 13)] = 32
    of = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    longest = max(ORDERS)
    for start in range(0, len(flat), PIECE):
        piece, own = (x[start : start + PIECE + longest - 1] for x in (flat, of))
        h = np.zeros(len(piece), dtype=np.uint32)
        rows, buckets = [], []
        for n in range(1, longest + 1):
            size = min(PIECE, len(piece) - n + 1)
            if size <= 0:
                break
            h = (h[:size] ^ piece[n - 1 : n - 1 + size]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                within = own[:size] == own[n - 1 : n - 1 + size]
                rows.append(own[:size][within])
                buckets.append(((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1))[within])
        yield np.concatenate(rows), np.concatenate(buckets)


def fit(spark: SparkSession, rows: DataFrame, text: str = "text", label: str = "lang") -> list[Model]:
    """Models of all rows of rows with a text and a label, each of about MOST_LANGUAGES labels; none without such rows."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        place: dict[str, int] = {}
        sums, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in it:
            for start, texts in batches_of(batch.column(0), 1 << 20):
                of = np.array([place.setdefault(x, len(place)) for x in batch.column(1).slice(start, len(texts)).to_pylist()], dtype=np.int64)
                docs = np.r_[docs, np.zeros(len(place) - len(docs), np.int64)] + np.bincount(of, minlength=len(place))
                sums = np.r_[sums, np.zeros(len(place) * BUCKETS - len(sums), np.int64)]
                for at, bucket in grams_of(texts):
                    sums += np.bincount(of[at] * BUCKETS + bucket, minlength=len(sums))
        for lang, i in place.items():
            own = sums[i * BUCKETS : (i + 1) * BUCKETS]
            full = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(full) + 1), pa.string()), "bucket": np.r_[full, -1].astype(np.int32), "n": np.r_[own[full], docs[i]]})

    bound_batches(spark)
    used = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("lang")).where("text is not null and lang is not null")
    parts = -(-used.select("lang").distinct().count() // MOST_LANGUAGES)
    models = []
    for part in range(parts):
        own = used.where(F.pmod(F.xxhash64("lang"), F.lit(parts)) == part) if parts > 1 else used
        #: about MOST_LANGUAGES x (BUCKETS + 1) rows at most, whatever the corpus
        table = own.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        languages = sorted(set(table.column("lang").to_pylist()))
        if not languages:
            continue
        place = {x: i for i, x in enumerate(languages)}
        at = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64)
        bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
        counts, docs = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
        grams = bucket >= 0
        counts[bucket[grams], at[grams]] = n[grams]
        docs[at[~grams]] = n[~grams]
        counts += SMOOTH
        models.append(Model(languages, np.log(counts / counts.sum(axis=0)), docs))
    return models


def log_likelihoods(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (texts x languages) of the texts' n-grams, and how many of these each text has."""
    sums, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for rows, buckets in grams_of(texts):
        counts += np.bincount(rows, minlength=len(texts))
        for i in range(len(model.languages)):
            sums[:, i] += np.bincount(rows, model.table[:, i][buckets], len(texts))
    return sums, counts


STATE = ["lang", "top", "total", "chance"]


def scored(spark: SparkSession, docs: DataFrame, models: list[Model], text: str) -> tuple[DataFrame, list[str]]:
    """docs with the best language (``und`` for a text that is null or letterless), its log probability with the
    texts it was learned from as prior, the sum of all languages' as logarithm, and the log probability of the text's
    n-grams by chance, all buckets being equally likely; and the names of these columns, which docs doesn't have."""
    names: list[str] = []
    for x in STATE:
        names.append(fresh([*docs.columns, *names], x))
    at, width = docs.columns.index(text), len(docs.columns)
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    docs = docs.withColumns({names[0]: F.lit(UNKNOWN), **{n: F.lit(float("-inf")) for n in names[1:]}})
    for model in models:
        shared = spark.sparkContext.broadcast(model)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tidy()
            known = shared.value
            prior = np.log(known.texts)
            table = np.asfortranarray(known.table)
            known = Model(known.languages, table, known.texts)
            for batch in it:
                for start, texts in batches_of(batch.column(at), 1 << 20):
                    part = batch.slice(start, len(texts))
                    sums, counts = log_likelihoods(known, [t or "" for t in texts])
                    told = np.array([bool(t and LETTER.search(t)) for t in texts])
                    sums = np.where(told[:, None], sums + prior, -np.inf)
                    best = sums.argmax(axis=1)
                    top = sums[np.arange(len(texts)), best]
                    lang, old, total = part.column(width).to_pylist(), part.column(width + 1).to_numpy(), part.column(width + 2).to_numpy()
                    lang = [known.languages[b] if t > o else x for b, t, o, x in zip(best, top, old, lang)]
                    out = [np.maximum(top, old), np.logaddexp(total, np.logaddexp.reduce(sums, axis=1)), np.where(told, -np.log(BUCKETS) * counts, 0.0)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in out)], names=schema.names)

        docs = docs.mapInArrow(run, schema)
    return docs, names


def predict(spark: SparkSession, docs: DataFrame, models: list[Model], text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score from 0 to 1 as two more columns, from the whole text alone.

    A null, empty or letterless text, or no model, gives ``und`` with score 0. Any other column is kept as it is;
    where docs has one of the two names, underscores are put behind the new one's.
    """
    found, (best, top, total, _) = scored(spark, docs, models, text)
    lang = fresh(docs.columns, lang)
    score = fresh([*docs.columns, lang], score)
    value = F.when(F.col(best) == UNKNOWN, 0.0).otherwise(F.exp(F.col(top) - F.col(total)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(best).alias(lang), value.alias(score))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids fall into part 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: learned from three quarters of the labelled ones, predicted for all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit(spark, docs.where(fold("doc_id", 4) != 2))
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return predict(spark, rows, models).drop("text")


#: The least posterior that the pipeline takes as an answer.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents whose language can't be told go.

    These are texts without a letter, those with a score under LEAST_SCORE, and those whose n-grams are less likely in
    any language learned than by chance. Without labelled texts all documents stay.
    """
    models = fit(spark, docs.where(fold("doc_id", 4) != 2))
    if not models:
        return docs
    found, (lang, top, total, chance) = scored(spark, docs, models, "text")
    return found.where((F.col(lang) != UNKNOWN) & (F.exp(F.col(top) - F.col(total)) >= LEAST_SCORE) & (F.col(top) >= F.col(chance))).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
