"""Routing of questions and rule-based intents, as Column expressions over the question's text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import lexicons as L
from siltstone.functions import text as X


def categories(c: Column) -> Column:
    """The structured categories whose patterns a question matches."""
    listed = F.array(*[F.when(F.rlike(c, F.lit("(?i)(?:" + "|".join(p) + ")")), F.lit(name)) for name, p in L.STRUCTURED_PATTERNS.items()])
    return F.filter(listed, lambda x: x.isNotNull())


def entities(c: Column) -> Column:
    """All class groups, times, days, rooms, codes and instructors a question names."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(f"(?i){p}"), 0) for p in L.SCHEDULE_ENTITIES])


def analyse(questions: DataFrame, text: str = "text") -> DataFrame:
    """questions with structured_patterns, schedule_entities, keyword_hits, query_type, confidence and requires_real_time."""
    c = F.col(text)
    lower = F.lower(c)
    out = questions.withColumns({"structured_patterns": categories(c), "schedule_entities": entities(c), "keyword_hits": X.hits(lower, L.SEMANTIC_WORDS), "requires_real_time": X.any_of(lower, L.NOW_PHRASES)})
    s = (2 * F.size("structured_patterns") + F.size("schedule_entities")).cast("double")
    k = F.col("keyword_hits").cast("double")
    most = lambda x: F.least(F.lit(0.9), 0.5 + 0.1 * x)
    kind = F.when((s >= 3) & (k <= 1), "structured").when((s >= 1) & (k >= 2), "hybrid").when(k > s, "semantic").when(s > 0, "structured").otherwise("unknown")
    sure = F.when((s >= 3) & (k <= 1), most(s)).when((s >= 1) & (k >= 2), 0.6).when(k > s, most(k)).when(s > 0, 0.7).otherwise(0.3)
    return out.withColumn("query_type", kind).withColumn("confidence", sure)


def intent(c: Column) -> Column:
    """intent_type, topic, confidence and requires_context by rules: blank, greeting, feedback, then words in order."""
    q = X.strip(F.coalesce(c, F.lit("")))
    n = X.word_count(q)

    def result(kind: str, topic: str, sure: float) -> Column:
        return F.struct(F.lit(kind).alias("intent_type"), F.lit(topic).alias("topic"), F.lit(sure).alias("confidence"), F.lit(kind in L.NEEDS_CONTEXT).alias("requires_context"))

    rules = [
        (q == "", result("general_chat", "general", 1.0)),
        (F.rlike(q, F.lit(f"(?i){L.GREETING}")) & (n <= 6), result("general_chat", "general", 0.97)),
        (F.rlike(q, F.lit(f"(?i){L.FEEDBACK}")) & ~F.contains(q, F.lit("?")) & (n <= 10), result("feedback", "general", 0.95)),
        *((X.any_of(F.lower(q), words), result(kind, topic, 0.5)) for kind, topic, words in L.INTENT_WORDS),
    ]
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), result("factual_query", "general", 0.5))


def classify(questions: DataFrame, text: str = "text", model: Callable[[Column], Column] | None = None) -> DataFrame:
    """questions with their intent, by the rules or by a model (a struct of the same fields) where one is given.

    A model's answer is brought to known intents and topics, its confidence to the range from 0 to 1.
    """
    found = intent(F.col(text)) if model is None else model(F.col(text))
    out = questions.withColumn("intent_", found)
    kind = F.when(F.col("intent_.intent_type").isin(L.INTENTS), F.col("intent_.intent_type")).otherwise("factual_query")
    topic = F.when(F.col("intent_.topic").isin(L.TOPICS), F.col("intent_.topic")).otherwise("general")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("intent_.confidence", F.lit(0.5))))
    return out.select(*questions.columns, kind.alias("intent_type"), topic.alias("topic"), sure.alias("intent_confidence"), kind.isin(L.NEEDS_CONTEXT).alias("requires_context"))


def needs_real_time(text: Column, intent_type: Column, year: int) -> Column:
    signal = X.any_of(F.lower(text), L.TEMPORAL_SIGNALS) | F.contains(text, F.lit(str(year)))
    return F.when(intent_type == "schedule_query", False).otherwise(signal)


def context_limit(intent_type: Column) -> Column:
    """How many chunks an answer takes."""
    return F.when(intent_type.isin("explanation_query", "comparison_query"), 15).when(intent_type.isin("general_chat", "feedback"), 5).otherwise(10)


#: Canned answers for intents that need no search.
CANNED = {"general_chat": "Hello! How can I help you today?", "feedback": "Thank you for your feedback.", "off_topic": "I can only answer questions about the indexed documents."}


def canned_answer(intent_type: Column) -> Column:
    return reduce(lambda rest, kv: F.when(intent_type == kv[0], kv[1]).otherwise(rest), CANNED.items(), F.lit(None).cast("string"))
