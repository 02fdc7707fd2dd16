"""Conversation memory: windows of turns, entities, references and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import lexicons as L
from siltstone.functions import text as X


def newest():
    return W.partitionBy("conv_id").orderBy(F.desc("turn"))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    return turns.withColumn("nth", F.row_number().over(newest())).where(F.col("nth") <= n).drop("nth")


def token_window(turns: DataFrame, budget: int = 2000, cost: Column | None = None) -> DataFrame:
    """The newest turns whose costs fit the budget together, up to the first that doesn't."""
    cost = X.token_estimate(F.col("text")) if cost is None else cost
    spent = F.sum("cost").over(newest().rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumn("cost", cost).withColumn("spent", spent).where(F.col("spent") <= budget)


def neighbours(turns: DataFrame, mentions: DataFrame, last: int = 3) -> DataFrame:
    """Turns beside a mention (conv_id, turn), and the last few, each once."""
    near = mentions.select("conv_id", F.explode(F.array(F.col("turn") - 1, "turn", F.col("turn") + 1)).alias("turn")).distinct()
    return turns.join(near, ["conv_id", "turn"], "left_semi").unionByName(last_turns(turns, last)).dropDuplicates(["conv_id", "turn"])


def mentions(turns: DataFrame) -> DataFrame:
    """Course codes and phrases of capitalised words in turns, with where they stand and a snippet."""
    hit = lambda pattern, kind: F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), lambda t: F.struct(t.alias("entity"), F.lit(kind).alias("category")))
    out = turns.select("conv_id", "turn", "text", F.posexplode(F.concat(hit(L.COURSE_CODE, "course"), hit(L.PHRASE, "name"))).alias("pos", "m"))
    at = F.expr("instr(text, m.entity)")
    snippet = X.strip(F.substring("text", F.greatest(F.lit(1), at - 30), F.length("m.entity") + 60))
    return out.select("conv_id", "turn", "pos", "m.entity", "m.category", snippet.alias("snippet"))


def latest_entities(found: DataFrame) -> DataFrame:
    """The last mention of each entity in a conversation, letters of either case."""
    return found.groupBy("conv_id", F.lower("entity").alias("name")).agg(F.max_by(F.struct("entity", "category", "turn"), F.struct("turn", "pos")).alias("last")).select("conv_id", "name", "last.*")


def references(c: Column) -> Column:
    """Pronouns, vague words and follow-up phrases in a question, as an array."""
    tokens = F.filter(F.split(F.lower(c), r"\s+"), lambda t: t.isin([*L.PRONOUNS, *L.VAGUE_WORDS]))
    phrases = F.filter(F.array(*[F.when(F.contains(F.lower(c), F.lit(p)), F.lit(p)) for p in L.FOLLOW_UPS]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(tokens, phrases))


def follows_up(c: Column) -> Column:
    lower = F.lower(c)
    return X.any_of(lower, L.FOLLOW_UPS) | F.startswith(lower, F.lit("also "))


def resolve(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """Names in questions (conv_id, name) with the entity they mean: the same, or the longest that contains or is in it."""
    met = questions.join(entities.select("conv_id", F.col("name").alias("known"), "entity", "turn"), "conv_id")
    fits = met.where("name = known or contains(known, name) or contains(name, known)")
    best = W.partitionBy("conv_id", "name").orderBy((F.col("name") == F.col("known")).desc(), F.length("known").desc(), F.desc("turn"), "known")
    return fits.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def context(turns: DataFrame, questions: DataFrame, recent: int = 4, chars: int = 150) -> DataFrame:
    """For each question (conv_id, question): references, the latest entities, a context text and what is lacking."""
    marked = questions.withColumn("refs", references(F.col("question"))).withColumn("follows", follows_up(F.col("question")))
    latest = latest_entities(mentions(turns)).groupBy("conv_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "entity")))), 1, 2).alias("top"))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("text", 1, chars))
    history = last_turns(turns, recent).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))
    out = marked.join(latest, "conv_id", "left").join(history, "conv_id", "left")
    refers = F.size("refs") > 0
    same = (F.size("top") == 2) & (F.col("top")[0]["turn"] == F.col("top")[1]["turn"])
    return out.select(
        "conv_id", "question", "refs", F.col("context").isNotNull().alias("memory_available"), (refers | F.col("follows")).alias("context_is_relevant"),
        (refers & F.coalesce(same, F.lit(False))).alias("needs_clarification"), F.when(refers & ~F.coalesce(same, F.lit(False)), F.element_at("top", 1)["entity"]).alias("resolved"),
        F.when(refers | F.col("follows"), F.col("context")).alias("context"), F.when(refers | F.col("follows"), 0.7).otherwise(0.0).alias("relevance_score"),
    )


def pack_context(ranked: DataFrame, budget: int, most: int = 12, chars: int = 500) -> DataFrame:
    """Ranked chunks (rank from 1, text) in order until one overflows the token budget; numbered as sources."""
    cut = ranked.where(F.col("rank") <= most).withColumn("block", F.concat(F.lit("[Source "), F.col("rank"), F.lit("] "), F.substring("text", 1, chars)))
    spent = F.sum(X.token_estimate(F.col("block"))).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("spent", spent).where(F.col("spent") <= budget)
