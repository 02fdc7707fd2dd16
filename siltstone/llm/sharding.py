"""Sharding by longest-processing-time scheduling: whole groups, largest first, to the least-loaded shard by a heap.

Groups of equal size are interchangeable, so the schedule needs the histogram of group sizes only. Sizes are classed
to one part in ``FINE`` (sizes under FINE are exact), which bounds the histogram by FINE classes per doubling of the
size whatever the number of groups; the driver runs the heap over classes and sends back how many groups of each
class every shard takes. A group finds its shard by its rank within its class, a document its slot by its rank within
its shard; both ranks are counted per partition first.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.store import fresh, number_rows, rank_in, save

FINE = 2048


def size_class(size: Column) -> Column:
    """size without the bits below the FINE-th part of its highest bit."""
    drop = F.greatest(F.length(F.bin(size)) - FINE.bit_length(), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Longest processing time first over classes (class, groups, total size), largest class first.

    Returns (class, shard, first, last): the ranks within the class, last excluded, that go to the shard. Each group
    of a class goes to the shard with the least load (the lowest number on ties) by a heap; the groups of a class
    have their mean size. Long runs are shortened: while a whole round of groups goes to every shard once, rounds are
    taken together.
    """
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for name, groups, total in sorted(classes, reverse=True):
        each, left = total / groups, groups
        taken = [0] * shards
        while left:
            low, high = heap[0][0], max(x for x, _ in heap)
            if left > 4 * shards and high - low <= each:  # level: every shard gets one in each round
                rounds = left // shards - 1
                heap = [(load + rounds * each, s) for load, s in heap]
                heapq.heapify(heap)
                taken = [t + rounds for t in taken]
                left -= rounds * shards
                continue
            load, s = heapq.heappop(heap)
            second = heap[0][0] if heap else load
            n = min(left, max(1, int((second - load) / each)))
            heapq.heappush(heap, (load + n * each, s))
            taken[s] += n
            left -= n
        at = 0
        for s, n in enumerate(taken):
            if n:
                out.append((name, s, at, at + n))
                at += n
    return out


def assign_shards(spark: SparkSession, docs: DataFrame, shards: int, text: str = "text", keep: list[str] | None = None, size: str = "size", shard: str = "shard", slot: str = "slot") -> tuple[DataFrame, str]:
    """A saved copy of docs (of its columns ``keep``, or all) with three more columns, and its row id's name.

    size is the text's UTF-8 bytes (null: none) plus 1. Rows with equal texts (null and empty are equal) are one
    group and share a shard; groups go to shards by ``schedule``, those of one size class in the order of their first
    rows. slot is gapless from 0 in each shard, in order of the row ids. An empty table gives an empty table. Where
    docs has a column of one of the three names already, underscores are put behind the new one's.
    """
    names = list(docs.columns)
    size, shard, slot, key = (names.append(x) or x for x in (fresh(names, y) for y in (size, shard, slot, "text_key")))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    copy, rid = number_rows(spark, docs.withColumns({size: (F.octet_length(whole) + 1).cast("long"), key: F.unhex(F.md5(whole))}), None if keep is None else [*keep, size, key])
    groups = save(spark, copy.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("total"), F.min(rid).alias("first_row")).withColumn("class", size_class(F.col("total"))))
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("total").alias("t")).collect()  # FINE rows a doubling at most
    plan = schedule([tuple(x) for x in histogram], shards)
    if not plan:
        return copy.withColumns({shard: F.lit(0), slot: F.lit(0).cast("long")}).drop(key).limit(0), rid
    table = spark.createDataFrame(plan, "class long, shard int, begin long, end long")
    ranked, rank = rank_in(spark, groups, "class", "first_row")
    placed = ranked.join(table, "class").where(F.col(rank).between(F.col("begin"), F.col("end") - 1)).select("key", "shard")
    dealt = save(spark, copy.select(F.col(rid).alias("row"), F.col(key).alias("key")).join(placed, "key").select("row", "shard"))
    slots, rank = rank_in(spark, dealt, "shard", "row")
    slots = slots.select(F.col("row").alias(rid), F.col("shard").alias(shard), F.col(rank).alias(slot))
    return copy.drop(key).join(slots, rid), rid


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents into 16 shards of nearly equal bytes, equal texts together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    dealt, _ = assign_shards(spark, rows, 16, keep=["doc_id", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes in DuckDB's SQL, byte by byte over a table made by the polynomial."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({bytes_}, lambda r, b: xor(r >> 8, {table}[CAST(xor(r, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


#: The heap group by group; classes as in size_class, whose groups count for their mean. Rows are in order of doc_id.
SQL = {
    "op8_sharding": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents
), g AS (
  SELECT t, sum(size) AS total, min(doc_id) AS first FROM d GROUP BY t
), c AS (
  SELECT t, first, total, CAST((total >> greatest(length(bin(CAST(total AS BIGINT))) - 12, 0)) << greatest(length(bin(CAST(total AS BIGINT))) - 12, 0) AS BIGINT) AS class FROM g
), m AS (
  SELECT t, first, class, sum(total) OVER (PARTITION BY class) / CAST(count(*) OVER (PARTITION BY class) AS DOUBLE) AS each, row_number() OVER (ORDER BY class DESC, first) AS i FROM c
), heap AS (
  SELECT CAST(0 AS BIGINT) AS i, list_transform(range(16), lambda x: CAST(0 AS DOUBLE)) AS loads, CAST(-1 AS BIGINT) AS shard
  UNION ALL
  SELECT i, list_transform(range(16), lambda x: loads[x + 1] + CASE WHEN x = least_ THEN each ELSE 0 END), least_ FROM (
    SELECT m.i, each, loads, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT) AS least_ FROM heap JOIN m ON m.i = heap.i + 1
  )
), turns AS (
  SELECT class, shard, row_number() OVER (PARTITION BY class ORDER BY shard) AS place FROM heap JOIN m USING (i)
), placed AS (
  SELECT t, shard FROM (SELECT t, class, row_number() OVER (PARTITION BY class ORDER BY first) AS place FROM m) JOIN turns USING (class, place)
)
SELECT doc_id, size, {crc32_sql('t')} AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN placed USING (t)
"""
}
