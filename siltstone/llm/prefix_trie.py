"""Trie of conversation prefixes: chained digests name the nodes, sums over subtrees come from exploded ancestors.

A conversation's prefix of d turns is named by a SHA-256 digest of the digest of its first d - 1 turns and of turn d, so equal
digests are equal prefixes. Every prefix of every conversation becomes a row, without its text; rows grouped by (depth,
digest) are the nodes, and a node is known by its smallest member.

Nodes with the same smallest member are a stretch of that conversation's path, from some depth down to its end. Sums over
subtrees take each stretch together: inside it they are running sums from its end upwards; what the whole stretch
adds to the nodes above goes to all of its ancestors, which are its conversation's prefixes that end before it. So the
exploded rows are no more than the turns, however deep the conversations are, and a node that all conversations share
is summed in part by every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.sharding import crc32_sql
from siltstone.llm.store import bound_batches, save

GROUP, HEADS = 100, 6
#: Ends of a node are joined to texts of this many neighbouring ids before they meet, as a power of two.
ENDS = 12
PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("is_end", pa.bool_())])
EMPTY = hashlib.sha256(b"").hexdigest()


def chained(before: bytes, role: str, text: str) -> bytes:
    """The digest of a prefix from that of the prefix without its last turn."""
    r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    return hashlib.sha256(b"%b%d:%b%b" % (before, len(r), r, t)).digest()


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, digest, parent (null at depth 0), chars of its last text, is_end.

    turns: conv_id, n (0 for the row that every conversation has beside its turns), role, text; as in prefix_trie.
    A conversation is streamed in order of n by one task, which holds one turn at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last: tuple | None = None

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PREFIXES.types)], schema=PREFIXES)
            rows.clear()
            return made

        for batch in batches:
            for conv, n, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if n == 0:
                    if last is not None:
                        rows.append((*last, True))
                    last = (conv, 0, hashlib.sha256(b"").digest(), None, 0)
                else:
                    rows.append((*last, False))
                    last = (conv, last[1] + 1, chained(last[2], role or "", text or ""), last[2], len(text or ""))
                if len(rows) >= 10_000:
                    yield out()
        if last is not None:
            rows.append((*last, True))
            yield out()

    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("n").cast("long").alias("n"), "role", "text")
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "n", "role", "text").mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in PREFIXES))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) from (digest, conv_id): the SHA-256 of each node's ids in decimal, ascending, joined by commas.

    Ids are joined by ranges of 2^ENDS first; a node's ranges are streamed in order to one hash, which is sequential by
    its nature: its task reads one row a range and holds one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, made = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"digest": pa.array([node], pa.binary()), "ends_sha256": [made.hexdigest()]})

        for batch in batches:
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest == node:
                    made.update(b",")
                else:
                    if node is not None:
                        yield out()
                    node, made = digest, hashlib.sha256()
                made.update(ids.encode())
        if node is not None:
            yield out()

    ranges = ends.groupBy("digest", F.shiftright("conv_id", ENDS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return ranges.repartition("digest").sortWithinPartitions("digest", "range").select("digest", "ids").mapInArrow(run, "digest binary, ends_sha256 string")


def prefix_trie(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix (role, text), the root included, of conversations.

    turns: conv_id (long), n, role, text. Each conversation has a row with n = 0 and any role and text, which stands for
    its root, and its turns in order of n > 0, ties by role and text; a null role or text is empty. Repeated rows are repeated
    turns. Rows with a null conv_id are left out. Other columns are left out too. Without rows there is no node.

    conv_id: the smallest member; depth; parent_conv_id: the parent's smallest member (root: null); n_convs: members;
    n_children; n_leaves: childless nodes of the subtree, itself included; saved_tokens: over the subtree, (n_convs - 1)
    times the code points of each node's last text; ends_sha256: of the ids of the conversations that end here.
    """
    bound_batches(spark)
    paths = save(spark, prefixes(turns.where("conv_id is not null")))
    nodes = paths.groupBy("depth", "digest", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = save(spark, nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = save(spark, nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0)))
    # Each stretch as a whole, to all of its ancestors.
    stretches = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    above = paths.select("conv_id", "depth", "digest").join(stretches, "conv_id").where("depth < top")
    hung = above.groupBy("digest").agg(F.sum("own").alias("hung_own"), F.sum("leaf").alias("hung_leaf"))
    upwards = W.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = nodes.select("digest", "parent", "conv_id", "depth", "n_convs", "n_children", F.sum("own").over(upwards).alias("own"), F.sum("leaf").over(upwards).alias("leaf"))
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = ends_digests(paths.where("is_end").select("digest", "conv_id"))
    whole = summed.join(hung, "digest", "left").join(ends, "digest", "left").join(parents, "parent", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("hung_leaf", F.lit(0))).alias("n_leaves"),
        (F.col("own") + F.coalesce("hung_own", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def heads_of(conv: Column) -> Column:
    """How many of its first turns a conversation takes from its group's first one."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(rows: DataFrame) -> DataFrame:
    """Turns for prefix_trie: of each conversation c, the first heads_of(c) turns of conversation c - c % 100, then c's own after as many.

    rows: conv_id, turn, role, text. Turns are in order of turn, ties by role and text; null turns come first. At most
    HEADS - 1 turns of each group's first conversation go to the others of its group, at most GROUP.
    """
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = own.select("conv_id", F.row_number().over(order).alias("n"), "role", "text")
    roots = own.where("n = 1").select("conv_id", F.lit(0).alias("n"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    tails = own.where(F.col("n") > heads_of(F.col("conv_id")))
    bases = own.where((F.col("conv_id") % GROUP == 0) & (F.col("n") < HEADS)).select(F.col("conv_id").alias("base"), "n", "role", "text")
    heads = roots.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), heads_of(F.col("conv_id")).alias("h")).where("h > 0").join(bases, "base").where("n <= h")
    return roots.unionByName(tails).unionByName(heads.select("conv_id", "n", "role", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that those of a group share their first turns."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = save(spark, rebuilt(rows))
    return prefix_trie(spark, turns)


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
SQL = {
    "op13_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, n, role, text FROM own JOIN c USING (conv_id) WHERE n > h
  UNION ALL SELECT c.conv_id, n, role, text FROM c JOIN own ON own.conv_id = base WHERE n <= h
), prefixed AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS key, length(text) AS chars FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY n)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), lengths AS (
  SELECT conv_id, max(depth) AS d FROM prefixed GROUP BY conv_id
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = d) AS ends
  FROM prefixed JOIN lengths USING (conv_id) GROUP BY depth, key
), kids AS (
  SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)
), below AS (
  SELECT a.key, sum(u.own) AS saved, count(*) FILTER (u.n_children = 0) AS leaves FROM counted a JOIN counted u ON u.depth >= a.depth AND left(u.key, 64 * a.depth) = a.key GROUP BY a.key
)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM counted x JOIN below USING (key) LEFT JOIN counted p ON x.depth > 0 AND p.depth = x.depth - 1 AND p.key = left(x.key, 64 * (x.depth - 1))
"""
}
