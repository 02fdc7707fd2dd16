"""Intermediate tables, row ids and connected components shared by the operators of this subpackage.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, the folder that driver and executors
share, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from ``spark.checkpoint.dir``. Only where it is unset and the master is local is a temporary folder set;
    on a cluster an unset folder is an error, as no machine-local folder would be seen by all executors.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster[...] has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application's driver ends."""
    top = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"
    files, where = _path(spark, top)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{top}/{uuid.uuid4().hex}"


def save(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df to a new table in the shared folder and read it back, which cuts its lineage.

    The application's tables go when its driver ends; drop_saved lets one go before.
    """
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at_ = path
    return out


def drop_saved(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that save gave, when nothing that is yet to run reads them."""
    for table in tables:
        files, where = _path(spark, table.saved_at_)
        files.delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Most bytes of an Arrow batch that goes to a Python worker, or one row. Its columns are held several times over: by the
#: executor, which doubles its buffers as they grow, and by the worker, which has one batch more in hand than it works on.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have BATCH_BYTES at most, unless it asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has (Spark compares them without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_rows(spark: SparkSession, df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """A saved copy of df (of ``columns``, or all) with a unique long row id, and the id's column name.

    The id has the number of the row's partition in its upper bits, its place there in the lower 33. As it is saved, it
    stays the same however often the copy is read.
    """
    rid = fresh(df.columns, "row_id")
    kept = df.columns if columns is None else columns
    bound_batches(spark)
    raw = save(spark, df.select(F.monotonically_increasing_id().alias(rid), *[F.col(f"`{c}`") for c in kept]))
    return raw, rid


def part_of(rid: str):
    """The partition that numbered the row: the upper bits of the id that number_rows gave."""
    return F.shiftright(F.col(rid), 33)


def rank_in(spark: SparkSession, df: DataFrame, key: str, rid: str) -> tuple[DataFrame, str]:
    """df with the gapless place from 0 of each row among those with its key, in order of rid, and that column's name.

    Rows are ranked within (key, numbering partition), a group no larger than one partition, and the counts of
    earlier partitions are added. The window over counts has one row per key and partition.
    """
    from pyspark.sql import Window

    names = list(df.columns)
    part, n_in, offset, rank = (names.append(x) or x for x in (fresh(names, y) for y in ("part", "n_in", "offset", "rank")))
    marked = df.withColumn(part, part_of(rid))
    counts = marked.groupBy(key, part).agg(F.count("*").alias(n_in))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, part, F.coalesce(F.sum(n_in).over(before), F.lit(0)).alias(offset))
    local = Window.partitionBy(key, part).orderBy(rid)
    ranked = marked.withColumn(rank, F.row_number().over(local).cast("long") - 1)
    return ranked.join(offsets, [key, part]).withColumn(rank, F.col(rank) + F.col(offset)).drop(part, offset), rank


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    Takes one row per edge (nodes are longs; loops and repeats are allowed) and returns (node, comp), one row per
    node of an edge between two different nodes; comp is the smallest node of the component. No part of the graph
    is collected: a round is two partial aggregations and two joins on the node, of which adaptive execution splits
    hot nodes. Each round is saved, so the plan doesn't grow with the number of rounds.

    The rounds end when the edges themselves show that they are stars: no node has both a smaller neighbour and
    another one.
    """
    pairs = save(spark, edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(pairs.select("v", "u"))
        low = save(spark, both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n"))
        if low.where("m < x and n > 1").isEmpty():
            roots = low.where("m = x").select(F.col("x").alias("node"), F.col("x").alias("comp"))
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots)
        large = both.join(low.select("x", "m"), "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        done = pairs
        pairs = save(spark, small.select("e.u", "e.v").where("u != v").distinct())
        drop_saved(spark, done, low)
