"""An inverted file of vectors for many queries at once: trained cells on disk, exact by bounds on whole cells.

Vectors, cut to unit length, lie on disk by the cell of their nearest centre, so a search reads the folders of the cells
it needs. Each cell knows its radius, the distance of its farthest vector from the centre. No vector of a cell is nearer to a
query than the query's distance from the centre less the radius, so after a first look into the nearest cells of each
query, cells whose bound is beyond its k-th neighbour so far are left out, and the result is exact.

A cell's vectors meet the queries that want it in blocks of at most about BLOCK vectors and as many queries; each block
gives the best k of each query, and these are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators.tables import cut

#: The most vectors the centres are trained on; cells are about the root of the rows, at most CELLS.
SAMPLE, CELLS, ROUNDS = 8192, 1024, 10
BLOCK = 4096
#: Slack for rounding, far above that of a sum of thousands of products.
EPSILON = 1e-9


def units(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, u): vectors of unit length; null, zero and unsound ones are left out."""
    own = rows.select(F.col(id_col).alias("id"), V.doubles(F.col(vector_col)).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(sound).withColumn("n", V.norm(F.col("v"))).where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("u"))


def trained(x: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Centres by k-means; a centre that loses all vectors goes to the farthest one."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        far = np.square(x).sum(1)[:, None] - 2 * x @ centres.T + np.square(centres).sum(1)
        at = far.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[far.min(1).argmax()])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.square(x).sum(1)[:, None] - 2 * x @ centres.T + np.square(centres).sum(1), 0))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


class VectorIndex:
    """An index in a folder: ``vectors`` (id, u, far) by cell, ``centres`` (cell, centre), and ``ids``, an empty table of their type."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, path: str, id_col: str = "id", vector_col: str = "v", cells: int | None = None) -> VectorIndex:
        """Train on at most SAMPLE vectors, those of the least hashes of their ids, and index all rows. All vectors have one length."""
        index = cls(rows.sparkSession, path)
        own = units(rows, id_col, vector_col)
        n = own.count()
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("u").toPandas()["u"]
        centres = trained(np.stack(sample.to_list()), cells or min(CELLS, math.ceil(math.sqrt(n)))) if len(sample) else np.zeros((0, 0))
        index.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{index.path}/centres")
        own.select("id").limit(0).write.parquet(f"{index.path}/ids")
        index._write(own, centres)
        return index

    def add(self, rows: DataFrame, id_col: str = "id", vector_col: str = "v") -> None:
        """More vectors into the cells there are. Ids that are there already are there twice then."""
        self._write(units(rows, id_col, vector_col), self.centres())

    def centres(self) -> np.ndarray:
        """At most CELLS rows."""
        found = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r.centre for r in found], dtype=float) if found else np.zeros((0, 0))

    def vectors(self) -> DataFrame:
        id_type = self.spark.read.parquet(f"{self.path}/ids").schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"id {id_type}, u array<double>, far double, cell int").parquet(f"{self.path}/vectors")

    def _write(self, own: DataFrame, centres: np.ndarray) -> None:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = distances(matrix(batch.column("u")), centres)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array(far.min(1)), pa.array(far.argmin(1).astype(np.int32))], names=["id", "u", "far", "cell"])

        id_type = own.schema["id"].dataType.simpleString()
        placed = own.mapInArrow(place, f"id {id_type}, u array<double>, far double, cell int")
        # A cell's rows go to several tasks where it has many, so no cell is written by one task alone.
        dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8)))
        dealt.write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "v", exact: bool = True, probes: int = 4, exclude_self: bool = False) -> DataFrame:
        """(query_id, id, score, rank, cells): the k vectors of the greatest cosine with each query, ties by id.

        score is the cosine from 0 to 1; cells counts those that were looked into for the query. Queries without a sound vector
        have no row. If not ``exact``, only the ``probes`` nearest cells of a query are looked into. ``exclude_self`` leaves out
        the vector whose id is the query's. Fewer rows than k come where there are no more vectors.
        """
        vectors, centres = self.vectors(), self.centres()
        cells = cut(vectors.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")))
        own = cut(units(queries, id_col, vector_col))
        id_type, q_type = vectors.schema["id"].dataType.simpleString(), own.schema["id"].dataType.simpleString()
        known = {r.cell: (r.radius, r.n) for r in cells.collect()}  # at most CELLS
        radius = np.array([known.get(i, (-np.inf, 0))[0] for i in range(len(centres))])

        def wanted(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows or not len(centres):
                        continue
                    far = distances(matrix(batch.column("u")), centres)
                    far[:, np.isinf(radius)] = np.inf
                    nearest = np.argsort(far, axis=1, kind="stable")[:, :probes]
                    if first:
                        lists = [row[np.isfinite(far[i, row])] for i, row in enumerate(nearest)]
                    else:
                        least = far - np.where(np.isinf(radius), 0, radius)
                        limit = np.array(batch.column("limit").to_pandas().fillna(np.inf))
                        open_ = (least <= limit[:, None] + EPSILON) & np.isfinite(far)
                        np.put_along_axis(open_, nearest, False, 1)
                        lists = [np.flatnonzero(row) for row in open_]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], names=["id", "u", "cells"])

            return run

        def look(wants: DataFrame) -> DataFrame:
            """The best k of each query in each block of the cells that it wants."""
            asked = cut(wants.select(F.col("id").alias("query_id"), F.col("u").alias("q"), F.explode("cells").alias("cell")))
            load = asked.groupBy("cell").agg(F.count("*").alias("nq"))
            sizes = F.broadcast(cells.join(load, "cell").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("nq") / BLOCK).cast("int").alias("parts")))
            these = vectors.join(sizes, "cell")
            left = these.select("cell", "id", "u", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            right = asked.join(sizes, "cell").select("cell", "query_id", "q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"))
            key = ["cell", "block", "part"]

            def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
                out = {"query_id": [], "id": [], "cosine": []}
                if len(x) and len(y):
                    x = x.sort_values("id")
                    ids, u = x["id"].to_numpy(), np.stack(x["u"].to_list())
                    for query, row in zip(y["query_id"], np.stack(y["q"].to_list()) @ u.T):
                        keep = np.flatnonzero(ids != query) if exclude_self else np.arange(len(ids))
                        top = keep[np.argsort(-row[keep], kind="stable")[:k]]
                        out["query_id"] += [query] * len(top)
                        out["id"] += ids[top].tolist()
                        out["cosine"] += row[top].tolist()
                return pd.DataFrame(out)

            return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, f"query_id {q_type}, id {id_type}, cosine double")

        order = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
        top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        shape = f"id {q_type}, u array<double>, cells array<int>"
        wants = cut(own.mapInArrow(wanted(True), shape))
        found = cut(top(look(wants)))
        seen = wants.select("id", F.size("cells").alias("n"))
        if exact:
            limits = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))).alias("limit"))
            more = cut(own.join(limits, "id", "left").mapInArrow(wanted(False), shape))
            found = top(found.drop("rank").unionByName(look(more)))
            seen = seen.unionAll(more.select("id", F.size("cells").alias("n")))
        counted = seen.groupBy(F.col("id").alias("query_id")).agg(F.sum("n").alias("cells"))
        return found.join(counted, "query_id").select("query_id", "id", V.clamp(F.col("cosine")).alias("score"), "rank", "cells")
