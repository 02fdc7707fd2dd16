"""Near-duplicate vectors by a blocked join within labels.

Vectors of one label and length are dealt to chunks, and each pair of chunks is compared by matrix products, a tile at a
time. A vector is shuffled once for each chunk of its label, so labels of up to CHUNK vectors are shuffled once; a grid on a
few components, which rules out next to nothing in many dimensions, would take a copy for each cell and block of
components. A link is decided by its cosine in double precision, and what leaves a task is counts and a spanning
forest, not pairs.

Equal vectors are folded into one with a count first, so a group of copies costs as much as one vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.store import components, drop_saved, number_rows, release, save

#: Most vectors of a chunk, fewer where they would have more than CHUNK_BYTES as doubles; rows of a tile.
CHUNK, CHUNK_BYTES, TILE = 8192, 32 << 20, 256
#: Cosines of matrix products are off by less; those as near to the threshold are taken anew, so many at a time.
SLACK, ANEW = 1e-9, 1 << 14


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled so that squares neither overflow nor vanish, and their norms."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.linalg.norm(x, axis=1)


def compare_chunks(least: float):
    """Links between the rows of two chunks of a label: counts of the vectors they stand for as (uid, null, n) and a
    spanning forest as (a, b, null)."""

    def run(table: pa.Table) -> pa.Table:
        first, uid, copies = (table.column(c).to_numpy(zero_copy_only=False) for c in ("first", "uid", "copies"))
        one = np.flatnonzero(first)
        two = one if table.column("i")[0].equals(table.column("j")[0]) else np.flatnonzero(~first)
        counts, tree, a, b = np.zeros(len(uid), np.int64), np.arange(len(uid)), [], []
        if len(uid) > 1 and len(one):
            x, norm = unit(matrix(table.column("v").combine_chunks()))
            y = x / norm[:, None]
            right = y[two].T.copy()
        for at in range(0, len(one) if len(uid) > 1 else 0, TILE):
            rows = one[at : at + TILE]
            dots = y[rows] @ right
            i, j = np.nonzero(dots >= least - SLACK)
            if two is one:
                later = j > i + at
                i, j = i[later], j[later]
            close = np.flatnonzero(dots[i, j] < least + SLACK)
            keep = np.ones(len(i), dtype=bool)
            for k in range(0, len(close), ANEW):
                some = close[k : k + ANEW]
                p, q = rows[i[some]], two[j[some]]
                keep[some] = (x[q] * x[p]).sum(1) / (norm[q] * norm[p]) >= least
            i, j = rows[i[keep]], two[j[keep]]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
            for begin, end in zip(starts, [*starts[1:], len(i)]):
                met = np.unique(tree[np.r_[i[begin], j[begin:end]]])
                if len(met) > 1:  # trees that the row's links join
                    tree[np.isin(tree, met)] = met[0]
                    a += [uid[met[0]]] * (len(met) - 1)
                    b += uid[met[1:]].tolist()
        full = np.flatnonzero(counts)
        out = {"a": [*uid[full], *a], "b": [*[None] * len(full), *b], "n": [*counts[full], *[None] * len(a)]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def near_vectors(spark: SparkSession, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """Links of the vectors of table with an equal, non-null label and a cosine of ``least`` or more.

    Returns a row for each row of table: its id (any name; kept as ``id``), n_links (other rows linked directly),
    component_id (the smallest non-null id reachable by links, its own included) and linked. A vector that is null,
    empty, zero or has null or non-finite components, or a null label, is linked with nothing; so are vectors of
    different lengths. Equal vectors, repeated rows and rows of equal ids are rows of their own and link. Other
    columns of table aren't looked at.
    """
    slim = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    copy, rid = number_rows(spark, slim)
    sound = "label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x != 0)"
    rows = copy.where(sound).select(F.col(rid).alias("uid"), "label", F.size("v").alias("dims"), "v")
    classes = save(spark, rows.groupBy("label", "dims", "v").agg(F.min("uid").alias("uid"), F.count("*").alias("copies")))
    many = classes.where("copies > 1").select(F.xxhash64("label", "v").alias("h"), F.col("label").alias("l"), F.col("v").alias("w"), F.col("uid").alias("head"), "copies")
    twins = save(spark, rows.withColumn("h", F.xxhash64("label", "v")).join(many, "h").where("label = l and v = w").select(F.col("uid").alias("twin"), "head", "copies"))
    most = F.least(F.lit(CHUNK), F.greatest(F.lit(256), F.floor(F.lit(CHUNK_BYTES) / 8 / F.col("dims"))))
    # a row for each label of several chunks: at most one for so many vectors as make a chunk
    large = save(spark, classes.groupBy("label", "dims").agg(F.count("*").alias("size")).where(F.col("size") > most).withColumn("chunks", F.ceil(F.col("size") / most).cast("int")).drop("size"))
    dealt = classes.join(F.broadcast(large), ["label", "dims"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunked = dealt.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
    spread = chunked.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keyed = spread.select("label", "dims", "uid", "copies", "v", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), (F.col("chunk") <= F.col("with")).alias("first"))
    found = save(spark, keyed.groupBy("label", "dims", "i", "j").applyInArrow(compare_chunks(least), "a long, b long, n long"))
    release(spark)
    counts = found.where("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("n"))
    groups = components(spark, found.where("b is not null").select("a", "b"))
    stood = copy.select(rid, "id").join(twins.withColumnRenamed("twin", rid), rid, "left").withColumn("head", F.coalesce("head", rid))
    placed = stood.join(counts, "head", "left").join(groups.withColumnRenamed("node", "head"), "head", "left")
    placed = save(spark, placed.select("id", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("comp", "head").alias("comp")))
    smallest = placed.where("n_links > 0").groupBy("comp").agg(F.min("id").alias("smallest"))
    out = placed.join(smallest, "comp", "left").select("id", "n_links", F.when(F.col("n_links") == 0, F.col("id")).otherwise(F.col("smallest")).alias("component_id"), (F.col("n_links") > 0).alias("linked"))
    drop_saved(spark, classes, twins, large, found)
    return out


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: links within labels at a cosine of 0.93 or more."""
    found = near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
SQL = {
    "op6_embedding_dedup": """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM unit
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node AND reach.root < links.b
), comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM unit JOIN comp ON node = vec_id LEFT JOIN degree ON a = vec_id
"""
}
