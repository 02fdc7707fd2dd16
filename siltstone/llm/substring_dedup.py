"""Substring dedup: passages that repeat across documents are cut from all but the first.

A copied passage seldom begins and ends where a line does, so the paragraphs compared here are all windows of
``SHINGLE + WINDOW - 1`` neighbouring words. A window's band is a MinHash of one row: the least hash among its word
shingles. Neighbouring windows share their minima, so a text has about two bands for every WINDOW words, and any
window that two texts have in common collides for certain, wherever it stands: recall of unedited passages is 1, and
an edited passage is found by the windows between its edits.

Collisions with the first document that has the band are chained along the text and each chain is verified against
that document's own words: equal and different words are aligned between the colliding windows and as far as the
match goes beyond them, and the best-scoring stretches are taken, in which at least ``num / den`` of the words are equal
(a bound on the edit distance). Stretches that touch make a passage, which is cut if it has ``LEAST`` words. Linked
documents are clustered by connected components. In every link the document with the smaller row id keeps its copy.

The first document of a band may hold a piece only that is too short for a passage, and copies behind it would never
meet. So places whose collisions made no passage go through a second round with tight bands: minima of shingles of
``LONG`` words. Any LEAST words in common collide there, and the first document of such a band has LONG of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.store import components, drop_saved, fresh, number_rows, release, save
from siltstone.llm.words import MIX, WordHasher, batches_of, finish, tidy

#: Words of a passage that is cut, of a verified stretch of it, of a shingle, and shingles in a window; powers of two.
LEAST, STRETCH, SHINGLE, WINDOW = 50, 25, 8, 16
#: Words between collisions of one chain at most, words that they may shift by, and words looked at beyond a chain:
#: enough to find a passage of LEAST words round one collision, where others collide with still earlier documents.
GAP, SHIFT, GROW = 48, 8, 64
#: Words of a shingle of the second round and shingles in its window: LONG + NEAR - 1 is LEAST.
LONG, NEAR = 47, 4
#: Words per band of a chain at most that leaves no other chain inside it. Equal texts have one for every 8.5 words; runs of
#: under STRETCH equal words between more edits than num / den allows keep less than 0.57 of their shingles, one band for 15.
DENSE = 14
#: Slices of first documents begin and end at multiples of this many words, so that many chains share one.
TILE = 64
#: Words whose hashes a worker remembers, and collisions that it looks at together (or those of one text).
ROOM, TOGETHER = 50_000, 50_000
#: Words that the windows of a passage of LEAST words cover at least.
COVERED = LEAST - 2 * (WINDOW - 1)
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def rolled(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` (a power of two) neighbouring values."""
    step = 1
    while step < width:
        values = op(values[:-step], values[step:])
        step *= 2
    return values


def shingled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, put together from runs of powers of two."""
    out, done, power, size = None, 0, hashes, 1
    while size <= width:
        if width & size:
            out = power if out is None else finish(out[: len(power) - done] * MIX + power[done:])
            done += size
        if 2 * size <= width:
            power = finish(power[:-size] * MIX + power[size:])
        size *= 2
    return out


def bands(hashes: np.ndarray, sizes: np.ndarray, of: int = SHINGLE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, places and keys of the windows' minima in texts of ``sizes`` words (LEAST at least) laid end to end."""
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    shingle = shingled(hashes, of)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = (place <= sizes[text] - of)[: len(shingle)]
    shingle = shingle[inside]
    text, place = (x[: len(inside)][inside] for x in (text, place))
    least = rolled(shingle, window, np.minimum)
    least[place[: len(least)] > sizes[text[: len(least)]] - of - window + 1] = 0  # not within one text
    around = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    chosen = rolled(around, window, np.maximum) == shingle
    return text[chosen], place[chosen], shingle[chosen]


def find_bands(source: DataFrame) -> DataFrame:
    """(key, uid, place) of source (uid, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ROOM)
        for batch in it:
            for start, texts in batches_of(batch.column(1), 1 << 19):
                hashed = [hasher(t) for t in texts]
                sizes = np.array([len(h) for h in hashed], dtype=np.int64)
                long = np.flatnonzero(sizes >= LEAST)
                text, place, key = bands(np.concatenate([hashed[i] for i in long]) if len(long) else np.empty(0, np.uint64), sizes[long])
                uid = batch.column(0).slice(start, len(texts)).to_numpy()
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "uid": uid[long][text], "place": place.astype(np.int32)})

    return source.mapInArrow(run, "key long, uid long, place int")


def likely(begin: np.ndarray, end: np.ndarray, who: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first and last of the chains, sorted by who and begin, that stand in runs long enough for a passage."""
    number = np.cumsum(np.r_[0, np.diff(who) != 0]) * (1 << 40)
    # a chain within a long one is left to that one, if so many of its bands collide that it is sure to be verified
    broad = (end - begin >= LEAST) & ((last - first + 1) * DENSE >= end - begin)
    over = np.r_[-1, np.maximum.accumulate(np.where(broad, end + number, -1))[:-1]]
    keep = end + number > over
    begin, end, number, first, last = (x[keep] for x in (begin, end, number, first, last))
    reach = np.maximum.accumulate(end + number)
    new = np.r_[True, (begin + number)[1:] > reach[:-1] + SHINGLE + WINDOW - 1]
    long = (np.maximum.reduceat(end, np.flatnonzero(new)) - begin[new] >= COVERED)[np.cumsum(new) - 1]
    return first[long], last[long]


def chains(collisions: DataFrame, tight: bool = False) -> DataFrame:
    """(uid, keeper, lo, hi, own, theirs): chains of collisions that may be part of a passage, with the places in both
    texts of their ends and shifts, and the slice of the keeper's words to verify them on.

    collisions: uid and marks, a list of (place, keeper, kplace). The lists of many rows are worked on at once. Tight
    collisions are those of the second round, which are stretches by themselves: all their chains stay.
    """
    kind = "uid long, keeper long, lo int, hi int, own array<int>, theirs array<int>"

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            start = 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, side="right")))
                yield batch.slice(start, stop - start)
                start = stop

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in pieces(it):
            marks = batch.column(1)
            flat = marks.flatten()
            uid = np.repeat(batch.column(0).to_numpy(), np.diff(marks.offsets.to_numpy()))
            place, keeper, kplace = (flat.field(i).to_numpy() for i in range(3))
            order = np.lexsort((kplace, place, keeper, uid))
            uid, place, keeper, kplace = uid[order], place[order].astype(np.int64), keeper[order], kplace[order].astype(np.int64)
            if not len(uid):
                continue
            step, kstep = np.diff(place), np.diff(kplace)
            new = np.r_[True, (np.diff(uid) != 0) | (np.diff(keeper) != 0) | (step > GAP) | (kstep <= 0) | (np.abs(kstep - step) > SHIFT)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(uid)] - 1
            # chains near each other make a run; a run too short for a passage goes
            begin, end, who = place[first], place[last] + SHINGLE, uid[first]
            order = np.lexsort((-end, begin, who))
            begin, end, who, first, last = (x[order] for x in (begin, end, who, first, last))
            if not tight:
                first, last = likely(begin, end, who, first, last)
            if not len(first):
                continue
            # of each chain its ends and the places where it shifts
            sizes = last - first + 1
            taken = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            turn = np.diff((kplace - place)[taken]) != 0
            kept = np.r_[turn, False] | np.r_[False, turn]
            kept[np.cumsum(sizes) - sizes] = kept[np.cumsum(sizes) - 1] = True
            sizes = np.add.reduceat(kept.astype(np.int64), np.cumsum(sizes) - sizes)
            taken = taken[kept]
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            lo = np.maximum(kplace[first] - GROW, 0) // TILE * TILE
            hi = -(-(kplace[last] + SHINGLE + GROW) // TILE) * TILE
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[taken].astype(np.int32))) for x in (place, kplace)]
            yield pa.RecordBatch.from_arrays([pa.array(uid[first]), pa.array(keeper[first]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), *lists], names=["uid", "keeper", "lo", "hi", "own", "theirs"])

    return collisions.mapInArrow(run, kind)


def short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def slices(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(keeper, lo, hi, words): 32 bits of each word lo to hi of first documents. wanted: keeper, lo and hi."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ROOM)
        for batch in it:
            for i in range(batch.num_rows):
                words, own = short(hasher(batch.column(1)[i].as_py())), batch.column(2)[i].as_py()
                for at in range(0, len(own), 64):
                    some = own[at : at + 64]
                    yield pa.RecordBatch.from_pydict({
                        "keeper": pa.array([batch.column(0)[i].as_py()] * len(some), pa.int64()), "lo": pa.array([w["lo"] for w in some], pa.int32()),
                        "hi": pa.array([w["hi"] for w in some], pa.int32()), "words": pa.array([words[w["lo"] : w["hi"]].tobytes() for w in some], pa.binary()),
                    })

    per_keeper = wanted.distinct().groupBy("keeper").agg(F.collect_list(F.struct("lo", "hi")).alias("own"))
    return source.join(per_keeper.hint("merge"), source["uid"] == per_keeper["keeper"]).select("keeper", "text", "own").mapInArrow(run, "keeper long, lo int, hi int, words binary")


def equal_at(words: np.ndarray, other: np.ndarray, shift: int, begin: int, end: int) -> np.ndarray:
    """Whether words[i] is other[i + shift], for i from begin to end; False outside of other."""
    out = np.zeros(end - begin, dtype=bool)
    a, b = max(begin, -shift), min(end, len(other) - shift)
    if a < b:
        out[a - begin : b - begin] = words[a:b] == other[a + shift : b + shift]
    return out


def stretches(words: np.ndarray, other: np.ndarray, own: np.ndarray, theirs: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """The stretches of words, along a chain, that score best against other: 1 for an equal word, -penalty for another,
    and for every word by which the alignment shifts. Each begins and ends with an equal word."""
    shift = theirs - own
    turns = np.flatnonzero(np.diff(shift))
    begin = max(0, int(own[0]) - GROW)
    score, at, now = [], begin, int(shift[0])
    for t in turns:
        a, b, then = int(own[t]), int(own[t + 1]) + SHINGLE, int(shift[t + 1])
        one, two = equal_at(words, other, now, a, b), equal_at(words, other, then, a, b)
        split = max(at, a + int((np.r_[0, np.cumsum(one)] + np.r_[np.cumsum(two[::-1])[::-1], 0]).argmax()))
        score.append(np.where(equal_at(words, other, now, at, split), 1.0, -penalty))
        if split > at:
            score[-1][-1] -= penalty * abs(then - now)
        at, now = split, then
    score.append(np.where(equal_at(words, other, now, at, max(at, min(len(words), int(own[-1]) + SHINGLE + GROW))), 1.0, -penalty))
    values = np.concatenate(score)
    out, todo = [], [(0, len(values))]
    while todo:
        a, b = todo.pop()
        if b - a < STRETCH:
            continue
        total = np.r_[0, np.cumsum(values[a:b])]
        low = np.minimum.accumulate(total)
        end = int((total - low).argmax())
        if total[end] - low[end] <= 0:
            continue
        first = int(end - total[: end + 1][::-1].argmin())
        if end - first >= STRETCH:
            out.append((begin + a + first, begin + a + end))
            todo += [(a, a + first), (a + end, b)]
    return out


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Passages (begin, end, smallest keeper) of stretches that overlap or touch, of LEAST words at least."""
    out: list[list[int]] = []
    for a, b, keeper in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], b), min(out[-1][2], keeper)
        else:
            out.append([a, b, keeper])
    return [(a, b, k) for a, b, k in out if b - a >= LEAST]


def stretches_of(words: np.ndarray, parts: list[dict], penalty: float) -> list[tuple[int, int, int]]:
    """Stretches (begin, end, keeper) of a text's words (short hashes), from its chains with their keepers' words."""
    spans = []
    for part in parts:
        theirs = np.array(part["theirs"], dtype=np.int64) - part["lo"]
        found = stretches(words, np.frombuffer(part["words"], np.uint32), np.array(part["own"], dtype=np.int64), theirs, penalty)
        spans += [(a, b, part["keeper"]) for a, b in found]
    return spans


def unsettled(size: int, parts: list[dict], passages: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where a text of ``size`` words has SHINGLE words or more of collisions outside of its passages, with LEAST words
    around them: (begin, end), apart from each other and each of LEAST words at least."""
    open_ = np.zeros(size + 2, dtype=bool)
    for p in parts:
        open_[p["own"][0] + 1 : p["own"][-1] + SHINGLE + 1] = True
    for a, b, _ in passages:
        open_[a + 1 : b + 1] = False
    open_[size + 1] = False
    edges = np.flatnonzero(open_[1:] != open_[:-1])
    out: list[list[int]] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= SHINGLE:
            lo, hi = max(0, a - LEAST), min(size, b + LEAST)
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
    return [(a, b) for a, b in out]


def collide(spark: SparkSession, source: DataFrame, marks: DataFrame, tight: bool = False) -> DataFrame:
    """(uid, parts): the texts with chains, each with a list of its chains and the words to verify them on. The joins are
    all by sorting: their sides grow with the documents. marks is a saved table, which goes."""
    shared = marks.groupBy("key").agg(F.min(F.struct("uid", "place")).alias("first"), F.max("uid").alias("last")).where("first.uid < last")
    firsts = shared.select("key", F.col("first.uid").alias("keeper"), F.col("first.place").alias("kplace"))
    collisions = marks.join(firsts.hint("merge"), "key").where("uid != keeper").groupBy("uid").agg(F.collect_list(F.struct("place", "keeper", "kplace")).alias("marks"))
    chained = save(spark, chains(collisions, tight))
    drop_saved(spark, marks)
    release(spark)
    sliced = save(spark, slices(source, chained.select("keeper", "lo", "hi")))
    release(spark)
    parts = chained.join(sliced.hint("merge"), ["keeper", "lo", "hi"])
    return parts.groupBy("uid").agg(F.collect_list(F.struct("keeper", "lo", "own", "theirs", "words")).alias("parts"))


def char_spans(text: str, passages: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Character spans of passages of words."""
    words = [m.span() for m in WORD.finditer(text)]
    return [(words[a][0], words[b - 1][1]) for a, b, _ in passages]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans and the white space after each."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        while b < len(text) and text[b] in " \t\n\r\x0b\x0c":
            b += 1
        at = b
    return "".join([*parts, text[at:]])


SPANS = {"row": pa.int64(), "keeper": pa.int64(), "start": pa.int64(), "end": pa.int64(), "n_words": pa.int64(), "passage_sha256": pa.string()}
#: Rows of a round: passages by characters; of texts that go on the stretches and bands by words, and the text.
KINDS = {"kind": pa.string(), **SPANS, "key": pa.int64(), "text": pa.large_string()}
PASSAGE, STRETCHED, BAND, TEXT = "passage", "stretch", "band", "text"


def rows_of(kind: str, n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of KINDS, null where no column is given."""
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in KINDS.items()], names=list(KINDS))


def verified(spark: SparkSession, found: DataFrame, num: int, den: int, last: bool) -> DataFrame:
    """A saved table of KINDS. found: uid, text, parts and earlier stretches; in the last round no text goes on."""
    penalty = num / (den - num)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ROOM)
        for batch in it:
            cut = []
            for uid, text, parts, earlier in zip(*(batch.column(i) for i in range(4))):
                uid, text, parts = uid.as_py(), text.as_py(), parts.as_py() or []
                hashes = hasher(text)
                spans = stretches_of(short(hashes), parts, penalty) + [(s["start"], s["end"], s["keeper"]) for s in earlier.as_py() or []]
                passages = joined(spans)
                again = [] if last else unsettled(len(hashes), parts, passages)
                if again:
                    sizes = np.array([b - a for a, b in again], dtype=np.int64)
                    which, place, key = bands(np.concatenate([hashes[a:b] for a, b in again]), sizes, LONG, NEAR)
                    place = place + np.array([a for a, _ in again], dtype=np.int64)[which]
                    yield rows_of(BAND, len(key), row=np.full(len(key), uid), start=place, key=key.view(np.int64))
                    yield rows_of(STRETCHED, len(spans), row=[uid] * len(spans), start=[s[0] for s in spans], end=[s[1] for s in spans], keeper=[s[2] for s in spans])
                    yield rows_of(TEXT, 1, row=[uid], text=[text])
                elif passages:
                    for (a, b, keeper), (start, end) in zip(passages, char_spans(text, passages)):
                        cut.append((uid, keeper, start, end, b - a, hashlib.sha256(text[start:end].encode("utf-8", "surrogatepass")).hexdigest()))
            if cut:
                yield rows_of(PASSAGE, len(cut), **dict(zip(SPANS, zip(*cut))))

    names = {pa.int64(): "long", pa.string(): "string", pa.large_string(): "string"}
    rows = found.select("uid", "text", "parts", "earlier").mapInArrow(run, ", ".join(f"{name} {names[kind]}" for name, kind in KINDS.items()))
    saved = save(spark, rows)
    release(spark)
    return saved


def passages(spark: SparkSession, docs: DataFrame, text_col: str, num: int, den: int) -> tuple[DataFrame, str, DataFrame]:
    """A saved copy of docs with a row id, the id's name, and a row for each passage: SPANS, by row ids and characters."""
    copy, rid = number_rows(spark, docs)
    source = copy.select(F.col(rid).alias("uid"), F.col(f"`{text_col}`").alias("text"))
    found = collide(spark, source, save(spark, find_bands(source)))
    none = F.lit(None).cast("array<struct<start:long,end:long,keeper:long>>").alias("earlier")
    first = verified(spark, source.join(found.hint("merge"), "uid").select("uid", "text", "parts", none), num, den, False)
    left = first.where(F.col("kind") == TEXT).select(F.col("row").alias("uid"), "text")
    marks = save(spark, first.where(F.col("kind") == BAND).select("key", F.col("row").alias("uid"), F.col("start").cast("int").alias("place")))
    again = collide(spark, left, marks, True)
    earlier = first.where(F.col("kind") == STRETCHED).groupBy(F.col("row").alias("uid")).agg(F.collect_list(F.struct("start", "end", "keeper")).alias("earlier"))
    second = verified(spark, left.join(again.hint("merge"), "uid", "left").join(earlier.hint("merge"), "uid", "left"), num, den, True)
    return copy, rid, first.unionByName(second).where(F.col("kind") == PASSAGE).select(*SPANS)


def cut_repeats(spark: SparkSession, docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", num: int = 80, den: int = 100) -> DataFrame:
    """docs with repeated passages cut from the text, and the count of characters, if there is such a column, renewed.

    Null, empty and short texts have no repeats; a passage that repeats within one row only isn't one. Of repeated rows
    all but the first are repeats as a whole. Very long texts are compared whole. Where several earlier rows hold a
    passage and the first of them a shorter piece of it, up to WINDOW + SHINGLE words may stay at either end, an unedited
    passage of less than LEAST + 2 * (NEAR - 1) words may stay, and so may an edited one. Rows that lose all their words
    go; every other row and column stays.
    """
    copy, rid, spans = passages(spark, docs, text_col, num, den)
    names = docs.columns
    other, marks = fresh(copy.columns, "other_id"), fresh(copy.columns, "marks")
    per_row = spans.groupBy(F.col("row").alias(other)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(marks))
    joint = copy.join(per_row.hint("merge"), copy[rid] == per_row[other], "left")
    at, end = names.index(text_col), len(names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in it:
            for start, texts in batches_of(batch.column(at)):
                part = batch.slice(start, len(texts))
                keep = [True] * len(texts)
                for i, mark in enumerate(part.column(end)):
                    if mark.is_valid:
                        texts[i] = without(texts[i], [(m["start"], m["end"]) for m in mark.as_py()])
                        keep[i] = bool(WORD.search(texts[i]))
                columns = [pa.array(texts, pa.string()) if c == at else part.column(c) for c in range(end)]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = joint.select(*[F.col(f"`{c}`") for c in names], marks).mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[chars_col].dataType)) if chars_col in names else out


def repeated_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """The spans that cut_repeats cuts, one row each.

    Columns: doc_id, keeper_doc_id (the first row that the passage is verified against), cluster_doc_id (the first row
    of the component that such links make), start and end (characters), n_words and passage_sha256.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    copy, rid, spans = passages(spark, slim, "text", num, den)
    groups = components(spark, spans.select(F.col("row").alias("a"), F.col("keeper").alias("b")))
    ids = copy.select(F.col(rid).alias("id"), "doc_id")
    out = spans.join(groups.withColumnRenamed("node", "row"), "row")
    for column, name in (("row", "doc_id"), ("keeper", "keeper_doc_id"), ("comp", "cluster_doc_id")):
        out = out.join(ids.select(F.col("id").alias(column), F.col("doc_id").alias(name)), column)
    return out.select("doc_id", "keeper_doc_id", "cluster_doc_id", "start", "end", "n_words", "passage_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: every span that repeats a passage of an earlier document."""
    return repeated_spans(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
SQL: dict[str, str] = {}
