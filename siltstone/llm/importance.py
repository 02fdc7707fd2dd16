"""Importance resampling towards a target distribution, in Spark SQL functions throughout.

Features of a text are its runs of one to ``n`` neighbouring words. All features are exploded, hashed into buckets by
crc32 and counted by bucket, once for the documents and once for the target texts. A bucket's gain is the scaled log of
its odds in the target; the gain table has one row a bucket, so its size is bounded by ``buckets`` and it is broadcast.
A second pass over the documents joins their exploded features with the gains and sums them by document. A Gumbel
number drawn from the document's id is added, and the documents of the highest scores are drawn: a distributed sort
puts all in order, and a document's rank is its place in its partition after the rows of earlier partitions.

Text isn't shuffled: counting sends a row for each bucket and task, the sums one row a document.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.sharding import crc32_sql
from siltstone.llm.store import fresh, save

#: What is between words after A to Z are lower-cased; words hold letters and digits of ASCII, and whatever isn't ASCII.
BETWEEN_RANGES = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
BETWEEN = "".join(chr(c) for c in range(128) if not re.match("[0-9a-z]", chr(c)))
N, BUCKETS, SEED, PERCENT, LEAST_WORDS = 3, 10_000, 42, 5, 20
#: A gain or a Gumbel number counts thousandths.
SCALE = 1000


def listed(rows: DataFrame, text: str, words: str) -> DataFrame:
    """rows with the list of each text's words, in order, in place of the text; null where it has none.

    Each step is a projection of its own, so that none is evaluated twice.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c != text]
    own = F.col(f"`{text}`")
    lower = F.when(F.length(own) == F.octet_length(own), F.lower(own)).otherwise(F.translate(own, string.ascii_uppercase, string.ascii_lowercase))
    lowered = rows.select(*kept, lower.alias(words))
    trimmed = lowered.select(*kept, F.btrim(F.col(words), F.lit(BETWEEN)).alias(words))
    return trimmed.select(*kept, F.when(F.col(words) != "", F.split(words, f"[{BETWEEN_RANGES}]+")).alias(words))


def exploded(rows: DataFrame, word_list: str, bucket: str, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """One row for each feature of each row's list of words, with the feature's bucket in place of the list.

    Each word makes n rows, for the runs that begin at it; where the text ends before, and for an empty list, the
    bucket is null.
    """
    own = F.col(word_list)
    kept = [F.col(c) for c in rows.columns if c != word_list]
    at = [f"w{i}" for i in range(n)]
    starts = F.arrays_zip(own.alias(at[0]), *[F.slice(own, i + 1, F.size(own)).alias(at[i]) for i in range(1, n)])
    begun = rows.select(*kept, F.explode_outer(starts).alias(bucket))
    runs = [reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(bucket)[a] for a in at[: i + 1]]) for i in range(n)]
    return begun.select(*kept, F.explode(F.array(*[(F.crc32(r.cast("binary")) % buckets).cast("int") for r in runs])).alias(bucket))


def bucket_counts(rows: DataFrame, text: str, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that any falls into."""
    own = listed(rows.select(F.col(f"`{text}`").alias("t")), "t", "words")
    return exploded(own, "words", "bucket", n, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(spark: SparkSession, docs: DataFrame, target: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for the buckets of documents: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).

    s and t count the bucket's features in documents and target, S and T all of them. At most ``buckets`` rows.
    """
    own = bucket_counts(docs, text, n, buckets).withColumnRenamed("n", "s")
    aim = bucket_counts(target, text, n, buckets).withColumnRenamed("n", "t")
    both = save(spark, own.join(aim, "bucket", "full_outer").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")))
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    odds = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    return both.where("s > 0").select("bucket", F.floor(SCALE * F.log(odds)).alias("gain"))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))); h is the first 8 hex digits of sha256('seed:key'). A null key is empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS,
    n: int = N, buckets: int = BUCKETS, seed: int = SEED, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of docs: its key, the columns of ``keep``, n_features, weight, score and rank, all long.

    Of the documents with ``least_words`` words or more, floor(percent * how many / 100) get ranks 1, 2, 3... by falling
    score, ties by the key (null first) and then in any order; the rest have none. A null or empty text has no feature
    and weight 0. Rows that repeat a key draw the same Gumbel number and are documents of their own; all rows with a
    null key share one number. Without a target text all target counts are 0. An empty table gives an empty table. Where
    key or keep have a new name already, underscores are put behind the new one's. ``keep`` rides along with every
    feature, so it is for narrow columns. A text is held once as a list of words, so a task's memory is bounded by its
    longest text, not by the number of its features.
    """
    kept = list(dict.fromkeys((key, *keep)))
    names = [*kept, text]
    n_features, weight, score, rank, rid, body, own, bucket, enough, place, part, offset, gain = (
        names.append(x) or x for x in (fresh(names, y) for y in ("n_features", "weight", "score", "rank", "row_id", "body", "words", "bucket", "enough", "place", "part", "offset", "gain"))
    )
    table = gains(spark, docs, target, text, n, buckets).select(F.col("bucket").alias(bucket), F.col("gain").alias(gain))
    rows = docs.select(F.monotonically_increasing_id().alias(rid), *[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body))
    rows = listed(rows, body, own).withColumn(enough, F.coalesce(F.when(F.col(own).isNotNull(), F.size(own)), F.lit(0)) >= least_words)
    features = exploded(rows, own, bucket, n, buckets).join(F.broadcast(table), bucket, "left")
    sums = features.groupBy(rid).agg(*[F.first(f"`{c}`").alias(c) for c in kept], F.first(enough).alias(enough), F.count(bucket).alias(n_features), F.coalesce(F.sum(gain), F.lit(0)).alias(weight))
    scored = sums.withColumn(score, F.col(weight) + gumbel(F.col(f"`{key}`"), seed))
    # The id that a row gets after the sort has its partition in the upper bits and its place there in the lower 33.
    ordered = save(spark, scored.orderBy(F.desc(enough), F.desc(score), F.col(f"`{key}`"), rid).withColumn(place, F.monotonically_increasing_id()).drop(rid))
    parts = ordered.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count("*").alias("n"), F.count_if(enough).alias("n_enough"))
    earlier = parts.select(part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(offset))  # a row for each partition
    n_enough = parts.agg(F.coalesce(F.sum("n_enough"), F.lit(0))).first()[0]
    nth = F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(offset) + 1
    ranked = ordered.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(earlier), part)
    return ranked.select(*[F.col(f"`{c}`") for c in kept], n_features, weight, score, F.when(F.col(enough) & (nth <= percent * n_enough // 100), nth).alias(rank))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents resampled towards the benchmark's texts: 5 of 100 documents with 20 words or more are drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c) for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("text",))))
    return resample(spark, docs, target)


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
#: Each distinct feature's crc32 is computed once.
SQL = {
    "op11_importance_resampling": rf"""
WITH texts AS (
  SELECT doc_id, true AS own, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents
  UNION ALL SELECT item_id, false, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') FROM benchmark
), listed AS (
  SELECT row_number() OVER () AS r, doc_id, own, regexp_extract_all(t, '[^{BETWEEN_RANGES}]+') AS w FROM texts
), grams AS (
  SELECT r, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM listed
), counted AS (
  SELECT r, own, g, count(*) AS n FROM grams GROUP BY ALL
), hashed AS (
  SELECT g, {crc32_sql('g')} % {BUCKETS} AS b FROM (SELECT DISTINCT g FROM counted)
), bucketed AS (
  SELECT r, own, b, sum(n) AS n FROM counted JOIN hashed USING (g) GROUP BY ALL
), sums AS (
  SELECT b, CAST(coalesce(sum(n) FILTER (own), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT own), 0) AS DOUBLE) AS t FROM bucketed GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS gain FROM sums
), weights AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM bucketed JOIN gain USING (b) WHERE own GROUP BY r
), scored AS (
  SELECT doc_id, len(w) >= {LEAST_WORDS} AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM listed LEFT JOIN weights USING (r) WHERE own
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS FIRST) AS nth, count(*) OVER (PARTITION BY enough) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND nth <= {PERCENT} * n // 100 THEN nth END AS rank FROM placed
"""
}
