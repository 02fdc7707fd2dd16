r"""WARC archives: written by Spark's text writer, read back by candidates whose chain from the file's start is verified.

Writing: a record is one string, its end mark the writer's line end, so every task writes one plain archive through
Spark's own output (any file system it knows). Of records with equal payloads of ``least`` bytes or more the one with
the greatest key is a response, the others are revisits that carry no payload. Which payloads repeat is found in a scan
of its own, so payloads only move where the table of repeated digests is too large to broadcast.

Reading: the text reader cuts the files at every ``WARC/1.`` after a line end, in splits of any size (the mark doesn't
overlap itself, so no cut hangs on where a buffer ends, and no header line holds it). Each piece is a candidate. A candidate's header gives the
offset of its successor, but a payload may hold the mark, or whole records, so a candidate proves nothing by itself.
Offsets come from the lengths of pieces, summed in each split and over the splits before it. In each split a candidate
is followed to the offset at which its chain leaves the split; between splits pointer jumping, doubled each round, marks
what is reached from the file's start. Only reached candidates are records; what is rejected belongs to the payload of the
record before it and is put back there.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.store import drop_saved, new_path, save

MAGIC, LINE, GAP = "WARC/1.", "\r\n", "\r\n\r\n"
MARK = "\n" + MAGIC
LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
URN = "urn:x-key:"


def quoted(c: Column) -> Column:
    """A header's value without line ends, angle brackets and blanks, which are percent-encoded; a null is empty."""
    for found in "%\r\n <>":
        c = F.replace(c, F.lit(found), F.lit(f"%{ord(found):02X}"))
    return F.coalesce(c, F.lit(""))


def unquoted(c: Column) -> Column:
    for found in "\r\n <>%":
        c = F.replace(c, F.lit(f"%{ord(found):02X}"), F.lit(found))
    return c


def headers(*fields: tuple[str, Column | None]) -> Column:
    """``name: value`` lines; those without a value are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{LINE}{name}: "), value), F.lit("")) for name, value in fields])


def write_warc(spark: SparkSession, rows: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST, date: str = DATE) -> None:
    """One record for each row, in archives below path.

    The payload is the body's bytes (a string's UTF-8; null: none). Keys are made strings and should be unique: rows
    that repeat a key and a payload are written as often as they come, with one record id and one type. Of equal payloads of
    ``least`` bytes or more the greatest key's is a response, a null key being least of all, and the others refer to it.
    A null url leaves its header out. Empty rows make an archive without records. Other columns are left out. A record
    is one row of Spark's, so it has 2 GB at most.
    """
    payload = F.coalesce(F.col(f"`{body}`").cast("binary"), F.lit(b""))
    own = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    large = own.where(F.col("n") >= least).groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("copies"))
    repeated = save(spark, large.where("copies > 1").select("digest", "first", F.lit(True).alias("repeated")))
    told = own.join(repeated, "digest", "left").withColumn("again", F.coalesce("repeated", F.lit(False)) & ~F.col("key").eqNullSafe(F.col("first")))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), quoted(F.col(c).cast("string")), F.lit(">"))
    reply = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("n"), F.lit(GAP))
    size = F.octet_length("reply") + F.when(F.col("again"), 0).otherwise(F.col("n"))
    head = headers(
        ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), ("WARC-Record-ID", urn("key")), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.when(F.col("url").isNotNull(), quoted(F.col("url")))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(F.col("again"), urn("first"))), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", size.cast("string")),
    )
    # A binary cast to a string keeps its bytes.
    block = F.concat("reply", F.when(F.col("again"), F.lit("")).otherwise(F.col("payload").cast("string")))
    records = told.withColumn("reply", reply).select(F.concat(F.lit(f"{MAGIC}1"), head, F.lit(GAP), block).alias("value"))
    records.write.option("lineSep", GAP).text(path)
    drop_saved(spark, repeated)


def field(name: str) -> Column:
    """A header's value in ``head``; null if it isn't there."""
    found = F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A saved table of what stands between the marks: id, path, file (a hash of it), split, file_size, value, size, head, length.

    ``head`` is the header as far as it is in ``value`` (a file's first piece has the mark as well), ``length`` what it says
    of its block; null where it says nothing sound. The id ascends along a split.
    """
    raw = spark.read.option("lineSep", MARK).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"))
    raw = raw.withColumns({"id": F.monotonically_increasing_id(), "size": F.octet_length("value").cast("long"), "head": F.when(F.contains("value", F.lit(GAP)), F.substring_index("value", GAP, 1))}).withColumn("path", F.col("file")).withColumn("file", F.xxhash64("path"))
    return save(spark, raw.withColumn("length", F.when(F.col("head").rlike(rf"^({re.escape(MAGIC)})?\d+\r\n"), field("Content-Length").try_cast("long"))))


def candidates(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A saved narrow table of pieces: file, split, id, start and next, the offset of the successor (null: unsound).

    Only the first piece of a file that begins with the mark starts at 0. What else a file begins with is unsound.
    """
    along = W.partitionBy("file", "split").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    whole = F.col("size") + len(MARK)
    splits = table.groupBy("file", "split").agg(F.sum(whole).alias("n"))
    earlier = splits.select("file", "split", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    narrow = table.select("file", "split", "id", "file_size", "size", "length", F.octet_length("head").alias("n_head"), F.startswith("value", F.lit(MAGIC)).alias("marked")).withColumn("before", F.coalesce(F.sum(whole).over(along), F.lit(0)))
    at = F.col("base") + F.col("before")
    placed = narrow.join(earlier, ["file", "split"]).withColumns({"at": at, "start": F.when(at == 0, 0).otherwise(at - len(MAGIC))})
    sound = (F.col("length") >= 0) & (F.col("marked") == (F.col("at") == 0))
    return save(spark, placed.select("file", "split", "id", "file_size", "start", F.when(sound, F.col("at") + F.col("n_head") + len(GAP) + F.col("length") + len(GAP)).alias("next")))


def exits(start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The offset at which each candidate's chain leaves a split; -1 where it ends inside it.

    start: sorted offsets of a split's candidates; after: those of their successors, -1 where unsound.
    """
    out = after.copy()
    inside = np.flatnonzero((after >= 0) & (after <= (start[-1] if len(start) else -1)))
    to = np.searchsorted(start, after[inside])
    for i, j in zip(inside[::-1].tolist(), to[::-1].tolist()):
        out[i] = out[j] if start[j] == after[i] else -1
    return out


def walk(start: np.ndarray, after: np.ndarray, entry: int) -> list[int]:
    """Places of the sound candidates that a chain visits from its entry on."""
    found, at = [], entry
    while at >= 0 and (i := int(np.searchsorted(start, at))) < len(start) and start[i] == at and after[i] >= 0:
        found.append(i)
        at = int(after[i])
    return found


def reached(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(file, start) of what chains from offset 0 visit, along edges (file, start, exit): the start of each split they enter.

    Pointers jump twice as far each round, so the rounds are the logarithm of the splits of the longest file.
    """
    known = save(spark, edges)
    jumps, marks = (save(spark, x) for x in (known.where("exit >= 0"), known.where("start = 0").select("file", "start")))
    n = -1
    while n != (n := marks.count()):
        old = jumps, marks
        to = marks.join(jumps, ["file", "start"]).select("file", F.col("exit").alias("start")).join(known, ["file", "start"], "left_semi")
        marks = save(spark, marks.unionAll(to).distinct())
        far = jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("beyond"))
        jumps = save(spark, jumps.join(far, ["file", "exit"]).select("file", "start", F.col("beyond").alias("exit")))
        drop_saved(spark, *old)
    return marks


def verified(spark: SparkSession, found: DataFrame) -> DataFrame:
    """A saved table of candidates with ``owner``, the id of the reached record that each one belongs to, and ``whole``.

    A reached candidate owns itself; a rejected one belongs to the last reached one before it, if it begins within that
    one's block, and else to none (null). ``whole`` is false for a reached candidate whose successor is neither reached
    nor the end of the file: the file is cut or damaged there.
    """

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        after = rows["next"].fillna(-1).astype("int64").to_numpy()
        return rows.assign(exit=exits(rows["start"].to_numpy(), after))[after >= 0][["file", "start", "exit"]]

    left = save(spark, found.groupBy("file", "split").applyInPandas(leave, "file long, start long, exit long"))
    targets = left.where("exit >= 0").select("file", F.col("exit").alias("start")).unionAll(left.where("start = 0").select("file", "start")).distinct()
    marks = reached(spark, left.join(targets, ["file", "start"], "left_semi"))
    first = marks.select("file", F.col("start").alias("entry")).join(found.select("file", "split", F.col("start").alias("entry")), ["file", "entry"]).groupBy("file", "split").agg(F.min("entry").alias("entry"))

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        start, after, ids = rows["start"].to_numpy(), rows["next"].fillna(-1).astype("int64").to_numpy(), rows["id"].to_numpy()
        entry = rows["entry"].iloc[0]
        own = np.array([] if pd.isna(entry) else walk(start, after, int(entry)), dtype=np.int64)
        last = np.searchsorted(own, np.arange(len(rows)), "right") - 1
        here = last >= 0
        out = rows[["file", "split", "id", "start", "file_size"]].copy()
        out["reached"] = np.isin(np.arange(len(rows)), own)
        for name, values in (("owner", ids), ("until", after)):
            out[name] = pd.array([None] * len(rows), dtype="Int64")
            if here.any():
                out.loc[here, name] = values[own[last[here]]]
        return out

    marked = save(spark, found.join(first, ["file", "split"], "left").groupBy("file", "split").applyInPandas(mark, "file long, split long, id long, start long, file_size long, reached boolean, owner long, until long"))
    by_split = marked.groupBy("file", "split").agg(F.max_by("owner", F.when(F.col("owner").isNotNull(), F.col("start"))).alias("o"), F.max_by("until", F.when(F.col("owner").isNotNull(), F.col("start"))).alias("u"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    carried = by_split.select("file", "split", F.last("o", True).over(before).alias("o"), F.last("u", True).over(before).alias("u"))
    owned = marked.join(carried, ["file", "split"]).withColumns({"owner": F.coalesce("owner", "o"), "until": F.coalesce("until", "u")})
    ends = marked.where("reached").select("file", F.col("start").alias("until"), F.lit(True).alias("sound"))
    checked = owned.join(ends, ["file", "until"], "left").withColumn("whole", F.coalesce("sound", F.lit(False)) | (F.col("until") == F.col("file_size")))
    return save(spark, checked.select("file", "id", "start", "reached", F.when(F.col("reached") | (F.col("start") < F.col("until")), F.col("owner")).alias("owner"), "whole"))


def read_warc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each record: file, record_type, record_id, key, url, refers_to (a key), digest, head, reply, payload, whole.

    ``payload`` is the block, of an HTTP message what follows its header (``reply``); ``digest`` is what the header says.
    ``whole`` is false for the last record that can be reached in a cut or damaged file; its block is what there is of
    it, and what follows is left out. A file that doesn't begin with a record gives none. Compressed files are read as
    one split each. No archives, or empty ones, give an empty table.
    """
    table = pieces(spark, path)
    verdict = verified(spark, candidates(spark, table))
    # What isn't a record by itself, and the records that such pieces belong to: few, but where payloads hold archives.
    odd = verdict.where("owner is null or not reached or not whole")
    mixed = verdict.join(odd.select("owner").distinct(), "owner").select("id", "owner", "start", "whole")
    odd = save(spark, mixed.unionAll(odd.where("owner is null").select("id", "owner", "start", "whole")))
    alone = table.join(odd, "id", "left_anti").select("path", "value", F.lit(True).alias("whole"))
    parts = table.join(odd.where("owner is not null"), "id").groupBy("owner").agg(F.first("path").alias("path"), F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"), F.first("whole").alias("whole"))
    joined = parts.select("path", F.array_join(F.transform("parts", lambda x: x["value"]), MARK).alias("value"), "whole")
    rows = alone.unionAll(joined).withColumn("head", F.substring_index("value", GAP, 1))
    at, size = F.octet_length("head") + len(GAP) + 1, field("Content-Length").cast("int")
    rows = rows.withColumn("block", F.substring(F.col("value").cast("binary"), at, size))
    # Of an HTTP message, its header and what comes after.
    rows = rows.withColumn("reply", F.when(F.startswith(field("Content-Type"), F.lit("application/http")), F.substring_index(F.col("block").cast("string"), GAP, 1)))
    payload = F.when(F.col("reply").isNull(), F.col("block")).otherwise(F.substring("block", F.octet_length("reply") + len(GAP) + 1, F.lit(2**31 - 1)))
    key = lambda c: unquoted(F.regexp_extract(c, f"^<{URN}(.*)>$", 1))
    return rows.select(
        F.col("path").alias("file"), field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), key(field("WARC-Record-ID")).alias("key"), unquoted(field("WARC-Target-URI")).alias("url"),
        key(field("WARC-Refers-To")).alias("refers_to"), field("WARC-Payload-Digest").alias("digest"), "head", "reply", payload.alias("payload"), "whole",
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written as archives and read back; a revisit's size is what its HTTP header says, its digest its record's."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark)
    write_warc(spark, pages, path)
    again = F.col("record_type") == "revisit"
    told = F.regexp_extract("reply", r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).cast("long")
    return read_warc(spark, path).select(
        F.col("key").try_cast("long").alias("page_id"), F.when(again, told).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.replace("digest", F.lit("sha1:"), F.lit(""))).otherwise(F.sha1("payload")).alias("payload_digest"), "record_type", F.col("refers_to").try_cast("long").alias("refers_to"),
    )


QUERIES = {"op12_warc": op12_warc}
SQL = {
    "op12_warc": f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT body, max(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY body HAVING count(*) > 1
)
SELECT page_id, n AS payload_bytes, sha1(p.body) AS payload_digest, CASE WHEN g.body IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.body IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.body = g.body
"""
}
