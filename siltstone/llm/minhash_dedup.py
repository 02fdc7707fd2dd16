"""Near duplicates by b-bit MinHash: bands propose pairs, packed low bits screen them, full sets confirm them.

A unit's set is hashed with ``bands * rows`` permutations. Each band's minima make a key; of all minima only the low
four bits are kept, sixteen to a long. Units that share a band key are candidates. The share of equal nibbles, freed
of chance collisions (1 in 16), estimates the similarity; pairs more than five standard deviations under the
threshold go. What is left is compared on the full sets.

Buckets aren't expanded into pairs. Units with equal sets are first folded into one. Then each bucket is compared
with one pivot; large buckets whose members are still in several components get further pivots; for what no pivot
connects, the members of different components are compared in blocks. So a bucket whose members are linked with each
other costs as many comparisons as it has members, and no link between components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.store import components, drop_saved, number_rows, release, save
from siltstone.llm.words import MIX, WordHasher, batches_of, finish, shingles, tidy

ROWS = 3
#: A pair at the threshold is missed by all bands with this probability at most.
MISS = 1e-6
#: Buckets above PIVOT members get PIVOTS more pivots; those of up to PAIRWISE are joined with themselves.
PIVOT, PIVOTS, PAIRWISE, BLOCK = 64, 3, 16, 256


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` minima that all miss a pair at the threshold with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (units x bands) and packed low bits (units x longs) of non-empty sets."""
    multiply, flip = permutations(bands * rows)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    minima = np.empty((len(sets), bands * rows), dtype=np.uint64)
    for j in range(bands * rows):
        minima[:, j] = np.minimum.reduceat((flat ^ flip[j]) * multiply[j], starts)
    keys = np.zeros((len(sets), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = finish(keys ^ minima[:, r::rows])
    low = np.zeros((len(sets), -(-bands * rows // 16) * 16), dtype=np.uint64)
    low[:, : bands * rows] = minima & np.uint64(15)
    low <<= np.tile(np.arange(0, 64, 4, dtype=np.uint64), low.shape[1] // 16)
    packed = np.bitwise_or.reduce(low.reshape(len(sets), -1, 16), axis=2)
    return keys.view(np.int64), packed.view(np.int64)


def set_hash(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a sorted set of hashes."""
    with np.errstate(over="ignore"):
        one = finish(values + np.uint64(11)).sum(dtype=np.uint64)
        two = finish(values ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def lists(rows: np.ndarray) -> pa.ListArray:
    """A 2-d array as an Arrow column of lists."""
    offsets = np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()))


UNITS = "n long, h1 long, h2 long, sig array<long>, bands array<long>"


def unit_columns(sets: list[np.ndarray], bands: int) -> dict[str, pa.Array]:
    """The columns of UNITS; empty sets have null signatures and bands."""
    full = [i for i, s in enumerate(sets) if len(s)]
    hashes = np.array([set_hash(s) for s in sets], dtype=np.int64).reshape(len(sets), 2)
    keys, packed = [None] * len(sets), [None] * len(sets)
    if full:
        k, p = signatures([sets[i] for i in full], bands)
        for at, i in enumerate(full):
            keys[i], packed[i] = k[at], p[at]
    kind = pa.list_(pa.int64())
    if len(full) == len(sets) and full:
        return {"n": pa.array([len(s) for s in sets], pa.int64()), "h1": pa.array(hashes[:, 0]), "h2": pa.array(hashes[:, 1]), "sig": lists(p), "bands": lists(k)}
    return {"n": pa.array([len(s) for s in sets], pa.int64()), "h1": pa.array(hashes[:, 0]), "h2": pa.array(hashes[:, 1]), "sig": pa.array(packed, kind), "bands": pa.array(keys, kind)}


def pack_set(values: np.ndarray) -> bytes:
    """A set of hashes, eight bytes each."""
    return values.astype("<u8").tobytes()


def unpack_set(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def unequal(a: str, b: str) -> Column:
    """How many nibbles of two packed signatures differ, by bit counts."""

    def per_long(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, per_long), F.lit(0), lambda s, x: s + x)


def screen(threshold: float, minima: int) -> int:
    """The most unequal nibbles of a pair that may reach the threshold (collision-corrected, five deviations)."""
    equal = threshold + (1 - threshold) / 16
    return math.ceil(minima * (1 - equal) + 5 * math.sqrt(minima * equal * (1 - equal)))


def confirm(spark: SparkSession, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) with den * |intersection| >= num * |union| of their full sets (uid, blob), saved."""

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in it:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = unpack_set(x.as_py()), unpack_set(y.as_py())
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(den * common >= num * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("uid").alias("a"), F.col("blob").alias("x"))
    right = sets.select(F.col("uid").alias("b"), F.col("blob").alias("y"))
    return save(spark, pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))


def link_units(spark: SparkSession, units: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect the units exactly as all links with similarity >= num / den do.

    units: a saved table with uid (a unique long) and the columns UNITS. sets_of takes a table of uids and returns
    (uid, blob) with their full sets, see pack_set. Units with equal sets are linked through one of them.
    """
    threshold = num / den
    minima = bands_for(threshold) * ROWS
    some = units.where("n > 0")
    folded = some.groupBy("h1", "h2", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"))
    copies = save(spark, some.select("uid", "h1", "h2", "n").join(folded.where("copies > 1"), ["h1", "h2", "n"]).select(F.col("rep").alias("a"), F.col("uid").alias("b")).where("a != b"))
    reps = some.select("uid", "sig", "bands").join(copies.select(F.col("b").alias("uid")), "uid", "left_anti")
    rows = reps.select("uid", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("uid").alias("first")).where("size > 1")
    members = save(spark, rows.join(shared, "key"))
    release(spark)
    sigs = save(spark, reps.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", "sig"))
    sets = save(spark, sets_of(sigs.select("uid")))
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        left = sigs.select(F.col("uid").alias("a"), F.col("sig").alias("sa"))
        right = sigs.select(F.col("uid").alias("b"), F.col("sig").alias("sb"))
        close = pairs.distinct().join(left, "a").join(right, "b").where(unequal("sa", "sb") <= screen(threshold, minima)).select("a", "b")
        return confirm(spark, close, sets, num, den)

    edges = verified(members.where("uid != first").select(F.col("first").alias("a"), F.col("uid").alias("b")))
    for turn in range(PIVOTS + 1):
        found = components(spark, edges)
        placed = members.where("size > 2").join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key")
        left = save(spark, placed.join(mixed, "key").select("key", "uid", "comp", "size"))
        if turn == PIVOTS or left.where(F.col("size") > PIVOT).isEmpty():
            break
        wide = left.where(F.col("size") > PIVOT)
        pivots = wide.groupBy("key").agg(F.min(F.xxhash64("uid", F.lit(turn))).alias("draw"))
        pivots = wide.withColumn("draw", F.xxhash64("uid", F.lit(turn))).join(pivots, ["key", "draw"]).select("key", F.col("uid").alias("p"), F.col("comp").alias("pc"))
        tried = wide.join(pivots, "key").where("comp != pc").select(F.least("p", "uid").alias("a"), F.greatest("p", "uid").alias("b"))
        edges = save(spark, edges.unionAll(verified(tried)))
        release(spark)
    few = left.where(F.col("size") <= PAIRWISE)
    other = few.select("key", F.col("uid").alias("v"), F.col("comp").alias("vc"))
    rest = few.join(other, "key").where("uid < v and comp != vc").select(F.col("uid").alias("a"), F.col("v").alias("b"))
    edges = edges.unionAll(verified(rest))
    many = left.where(F.col("size") > PAIRWISE)
    if not many.isEmpty():
        edges = edges.unionAll(in_blocks(many.join(reps.select("uid", "bands"), "uid").join(sets, "uid"), num, den))
    out = save(spark, copies.unionAll(edges))
    drop_saved(spark, copies, members, sigs, sets, left)
    return out


def in_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between units of the same key and different components, counted on their full sets.

    rows: key, uid, comp, size, bands, blob. A key's rows are dealt into blocks of about BLOCK rows; each task
    compares two blocks. A pair that shares several keys is compared at the first of them only.
    """

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("first").to_numpy()
        bands = np.array(table.column("bands").to_pylist(), dtype=np.int64)
        uid, comp, key = table.column("uid").to_numpy(), table.column("comp").to_numpy(), table.column("key")[0].as_py()
        sets = [unpack_set(x) for x in table.column("blob").to_pylist()]
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(np.r_[0, sizes])
        one = np.flatnonzero(side)
        two = np.flatnonzero(~side) if not side.all() else one
        members = np.concatenate([flat[starts[j] : starts[j + 1]] for j in two])
        edges = np.cumsum(np.r_[0, sizes[two]])[:-1]
        mark = np.zeros(flat.max() + 1, dtype=np.int64)
        a, b = [], []
        for i in one:
            own = flat[starts[i] : starts[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[members], edges)
            mark[own] = 0
            good = (den * common >= num * (sizes[i] + sizes[two] - common)) & (comp[two] != comp[i])
            if two is one:
                good &= two > i
            for j in two[good]:
                if bands[i][(bands[i] == bands[j]).argmax()] == key:
                    a.append(uid[i])
                    b.append(uid[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("key", "uid", "comp", "bands", "blob", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") <= F.col("with")).alias("first"))
    pairs = keyed.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def document_sets(k: int) -> Callable[[str | None], np.ndarray]:
    hasher = WordHasher()
    return lambda text: np.unique(shingles(hasher(text), k))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, str, DataFrame]:
    """Group the rows of docs whose sets of distinct ``words``-word shingles are linked: similarity >= num / den.

    Words are runs of bytes other than ASCII white space, A to Z lower-cased; a text of fewer words is one shingle;
    a null text or one without words has an empty set and is linked with nothing. Returns a saved table of row id,
    n_shingles, component_id (the smallest non-null id reachable, null if there is none) and first_row (true for one
    row of each group: the smallest id, then the smallest row id); the row id's name, which docs doesn't have; and the
    saved copy of docs with that row id. Repeated rows, also with equal or null ids, are linked as equal texts. An
    empty table has no rows.
    """
    bands = bands_for(num / den)
    copy, rid = number_rows(spark, docs)

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = document_sets(words)
        for batch in it:
            for start, texts in batches_of(batch.column(1), 1 << 20):
                sets = [of(t) for t in texts]
                yield pa.RecordBatch.from_pydict({"uid": batch.column(0).slice(start, len(texts)), **unit_columns(sets, bands)})

    def full(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = document_sets(words)
        for batch in it:
            for start, texts in batches_of(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_pydict({"uid": batch.column(0).slice(start, len(texts)), "blob": pa.array([pack_set(of(t)) for t in texts], pa.binary())})

    text = F.col(f"`{text_col}`")
    source = copy.select(F.col(rid).alias("uid"), text.alias("text"))
    units = save(spark, source.mapInArrow(sign, "uid long, " + UNITS))
    sets_of = lambda needed: source.join(needed.hint("merge"), "uid", "left_semi").mapInArrow(full, "uid long, blob binary")
    edges = link_units(spark, units, sets_of, num, den)
    groups = components(spark, edges)
    release(spark)
    ids = units.select("uid", "n").join(copy.select(F.col(rid).alias("uid"), F.col(f"`{id_col}`").alias("id")), "uid").join(groups.withColumnRenamed("node", "uid"), "uid", "left")
    placed = save(spark, ids.select("uid", "n", "id", F.coalesce("comp", "uid").alias("comp"), F.col("comp").isNotNull().alias("linked")))
    many = placed.where("linked")
    least = many.groupBy("comp").agg(F.min("id").alias("least"))
    firsts = many.join(least, "comp").where(F.col("id").eqNullSafe(F.col("least"))).groupBy("comp").agg(F.min("uid").alias("head"))
    leading = least.join(firsts, "comp")
    decided = placed.join(leading, "comp", "left").select(
        F.col("uid").alias(rid), F.col("n").alias("n_shingles"),
        F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("linked"), F.col("uid") == F.col("head")).otherwise(True).alias("first_row"),
    )
    out = save(spark, decided)
    drop_saved(spark, units, edges, placed)
    return out, rid, copy


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: 3-word shingles, linked at a similarity of 0.85 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    decided, rid, copy = near_duplicates(spark, docs, words=3, num=85, den=100)
    joined = decided.join(copy.select(rid, "doc_id"), rid)
    return joined.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates (five words, 0.8) stays."""
    decided, rid, copy = near_duplicates(spark, docs)
    return copy.join(decided.where("first_row").select(rid), rid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op9_minhash_dedup": op9_minhash_dedup}
SQL = {
    "op9_minhash_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b
), k AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT node AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, node = component_id AS kept FROM k LEFT JOIN n ON n.doc_id = node
"""
}
