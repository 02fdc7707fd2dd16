"""Chunks of documents: recursive splitter, fixed windows and sentence-based chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import lexicons as L
from siltstone.functions import text as X
from siltstone.operators.tables import bound_batches


def pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces to chunks of at most ``size`` characters; each starts with up to ``overlap`` of the one before."""
    window: list[str] = []
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window).strip()
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window).strip()


def split_text(text: str, size: int, overlap: int, separators: list[str] = L.SEPARATORS) -> list[str]:
    """Chunks by the first separator that the text has; longer pieces are split by the separators after it."""
    at = next(i for i, s in enumerate(separators) if s in text)
    mark, rest = separators[at], separators[at + 1 :]
    if mark:
        first, *others = text.split(mark)
        pieces = [p for p in (first, *(mark + o for o in others)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    small: list[str] = []
    for piece in pieces:
        if len(piece) < size or not mark:
            small.append(piece)
            continue
        out += pack(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, rest) if rest else [piece.strip()]
    out += pack(small, size, overlap)
    return [c for c in out if c]


def chunk_id(doc: Column, index: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit("_"), F.lpad(index.cast("string"), 4, "0"))


def with_metadata(chunks: DataFrame) -> DataFrame:
    """Id, counts and information score of chunks (doc_id, chunk_index, text)."""
    return chunks.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "text",
        F.length("text").alias("char_count"), X.word_count(F.col("text")).alias("word_count"), X.basic_score(F.col("text")).alias("information_score"),
    )


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200, clean: bool = True) -> DataFrame:
    """Chunks of documents (doc_id, text) by the recursive splitter, on the cleaned text."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    text = X.clean_text(F.col("text")) if clean else F.col("text")
    return with_metadata(docs.select("doc_id", F.posexplode(split(text)).alias("chunk_index", "text")))


def chunk_fixed(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of ``size`` characters, each beginning ``size - overlap`` after the one before; no Python."""
    text = X.clean_text(F.col("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("clean") - 1 - overlap), F.lit(size - overlap))
    cut = docs.select("doc_id", text.alias("clean")).where("clean <> ''").select("doc_id", "clean", F.posexplode(starts).alias("chunk_index", "start"))
    return cut.select("doc_id", "chunk_index", F.substring("clean", F.col("start") + 1, F.lit(size)).alias("text"))


def alike(words: pa.Array) -> np.ndarray:
    """The cosine of the word counts of each list of words with the next one's; 0 where a list has no word."""
    n, flat = len(words), words.flatten()
    worded = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy())[worded]
    coded = flat.dictionary_encode()
    step = len(coded.dictionary) + 1
    keys, counts = np.unique(owner * step + coded.indices.to_numpy()[worded], return_counts=True)
    owner = keys // step
    norms = np.sqrt(np.bincount(owner, counts * counts, n))
    at = np.searchsorted(keys, keys + step)  # the same word in the next list
    both = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == keys + step)
    dots = np.bincount(owner[both], counts[both] * counts[at[both]], n)[: max(0, n - 1)]
    scale = norms[:-1] * norms[1:]
    return np.divide(dots, scale, out=np.zeros_like(scale), where=scale > 0)


def begins(apart: list[bool], lengths: list[int], target: int) -> list[int]:
    """Where chunks begin, and last the number of sentences; ``apart`` tells of each sentence whether it is unlike both neighbours."""
    found, grown, last = [0], lengths[0], len(lengths) - 1
    for i in range(1, last):
        n = lengths[i]
        if apart[i]:
            found.append(i)
            grown = n
        else:
            grown += n
        if grown > 1.5 * target:
            found.append(i)
            grown = n
    return [*found, last + 1]


def unlike(words: pa.Array, floor: float) -> np.ndarray:
    """Whether the cosines of each list of words with both neighbours are under ``floor``; false at both ends."""
    low = alike(words) < floor
    return np.concatenate(([False], low[:-1] & low[1:], [False]))[: len(words)]


def boundaries(words: list[list[str]], lengths: list[int], target: int, floor: float) -> list[int]:
    """Where chunks begin, by sentence numbers, and last the number of sentences.

    A sentence that is neither the first nor the last begins one if the cosines of its word counts with both neighbours are under
    ``floor``; then it begins one, perhaps again, if the sentences since the last beginning, itself included, pass one and
    a half of ``target`` characters.
    """
    return begins(unlike(pa.array(words, pa.list_(pa.string())), floor).tolist(), lengths, target)


def overlapping(bounds: list[int], ratio: float) -> list[tuple[int, int]]:
    """From each boundary to the next, end excluded, with as many sentences more on both inner sides as overlap."""
    n = bounds[-1]
    more = int(n * ratio) if n > 5 else 1
    last = len(bounds) - 2
    return [(max(0, a - more * (i > 0)), min(n, b + more * (i < last))) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def semantic_chunks(docs: DataFrame, target: int = 400, floor: float = 0.7, ratio: float = 0.1) -> DataFrame:
    """Overlapping chunks of whole sentences between places where sentences are unlike both neighbours, bounded in length.

    docs: doc_id, text. A sentence's vector counts its words. Chunks of a document overlap by ``ratio`` of its sentences, by
    one where it has five or fewer. sentence_range has the numbers of the first sentence and of the one after the last. The
    first and the last chunk have a boundary score of 1, others 0.8. A text without a sentence has no chunk.
    """

    @F.arrow_udf("array<struct<first: int, last: int, start: int, bytes: int>>")
    def ranges(listed: pa.Array, lowered: pa.Array) -> pa.Array:
        flat = listed.flatten()
        apart, lengths = unlike(pc.ascii_split_whitespace(lowered.flatten()), floor).tolist(), pc.utf8_length(flat).to_pylist()
        places = np.append(0, np.cumsum(pc.binary_length(flat).to_numpy() + 1))  # of sentences joined by one space each
        found, bases, upto, sizes = [], [], 0, []
        for n in pc.list_value_length(listed).to_pylist():
            one = overlapping(begins(apart[upto : upto + n], lengths[upto : upto + n], target), ratio) if n else []
            found += one
            bases.append(upto)
            sizes.append(len(one))
            upto += n
        first, last = np.array(found, np.int64).reshape(-1, 2).T
        base = np.repeat(np.array(bases, np.int64), sizes)
        start = places[base + first]
        columns = [first, last, start - places[base], np.maximum(0, places[base + last] - start - 1)]
        made = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["first", "last", "start", "bytes"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), made)

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    # No filter may be pushed below the ranges: it would clean, cut and compare every text again.
    cut = rows.select("doc_id", F.array_join("s", " ").cast("binary").alias("whole"), ranges("s", F.transform("s", F.lower)).alias("r"))
    each = cut.select("doc_id", "whole", F.size("r").alias("n"), F.posexplode_outer("r").alias("chunk_index", "r")).where("r.first < r.last")
    # The overlap grows with the document, so the chunks of a long one are far larger together than it: one at a time.
    out = each.select("doc_id", "n", "chunk_index", "r.first", "r.last", F.substring("whole", F.col("r.start") + 1, F.col("r.bytes")).cast("string").alias("text"))
    edge = (F.col("chunk_index") == 0) | (F.col("chunk_index") == F.col("n") - 1)
    return out.select("doc_id", "chunk_index", "text", F.concat_ws("-", "first", "last").alias("sentence_range"), F.when(edge, 1.0).otherwise(0.8).alias("semantic_boundary_score"), X.chunker_score(F.col("text")).alias("information_score"))
