"""Text functions as Column expressions: cleaning, counts, information scores, sentences, word sets."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import lexicons as L


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column, keep_latin1: bool = False) -> Column:
    """Normal white space, no control characters, no runs of marks; null becomes empty.

    U+007F to U+00FF go too, as the corpus is English, unless ``keep_latin1``.
    """
    high = r"\x7f-\x9f" if keep_latin1 else r"\x7f-\xff"
    steps = [(r"\n\s*\n\s*\n+", "\n\n"), (r" {2,}", " "), (r"\t+", " "), (rf"[\x00-\x08\x0b\x0c\x0e-\x1f{high}]", ""), (r"[.]{3,}", "..."), (r"[!]{2,}", "!"), (r"[?]{2,}", "?")]
    return strip(reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.coalesce(c, F.lit(""))))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def worded(c: Column) -> Column:
    """Whether a text has any word."""
    return F.rlike(c, F.lit(r"\S"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def hits(c: Column, terms: Iterable[str]) -> Column:
    """How many of the terms occur in the text, as substrings."""
    return total(F.when(F.contains(c, F.lit(t)), 1).otherwise(0) for t in terms)


def any_of(c: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in terms))


def upto(c: Column, most: float) -> Column:
    """The share of ``most``, 1 at most."""
    return F.least(F.lit(1.0), c / most)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def basic_weight(c: Column) -> Column:
    """Length, capitalised words, numbers, lists and domain words of a text, weighted."""
    parts = [
        0.2 * upto(F.length(c), 1000), 0.25 * upto(count(c, r"\b[A-Z][a-zA-Z]*\b"), 20), 0.15 * upto(count(c, r"\b\d+\b"), 10),
        0.15 * F.when(F.rlike(c, F.lit(L.LIST_PATTERN)), 1.0).otherwise(0.0), 0.25 * upto(hits(F.lower(c), L.SCORE_WORDS_BASIC), 10),
    ]
    return total(parts)


def basic_score(c: Column) -> Column:
    """Information score from 0 to 1; blank texts have 0.

    A factor and not a branch: what a branch computes more than once, as the text in lower case, Spark doesn't share.
    """
    return F.round(basic_weight(c) * F.when(worded(c), 1.0).otherwise(0.0), 3)


def enhanced_weight(c: Column) -> Column:
    """The same with phrases, decimals, list items and contact details."""
    contact = total(F.when(F.rlike(c, F.lit(p)), 0.2).otherwise(0.0) for p in L.CONTACT_PATTERNS)
    parts = [
        0.15 * upto(F.length(c), 1000), 0.2 * upto(count(c, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), 15), 0.15 * upto(count(c, r"\b\d+(?:\.\d+)?\b"), 8),
        0.15 * upto(count(c, L.LIST_PATTERN), 5), 0.15 * F.least(F.lit(1.0), contact), 0.2 * upto(hits(F.lower(c), L.SCORE_WORDS_ENHANCED), 8),
    ]
    return total(parts)


def enhanced_score(c: Column) -> Column:
    return F.when(strip(c) == "", 0.0).otherwise(F.round(enhanced_weight(c), 3))


def chunker_score(c: Column) -> Column:
    structure = F.when(any_of(c, ["-", "•", "1.", "2.", "\n"]), 0.2).otherwise(0.0)
    return 0.3 * upto(F.length(c), 500) + 0.3 * upto(count(c, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), 10) + 0.25 * upto(hits(F.lower(c), L.SCORE_WORDS_CHUNKER), 5) + 0.15 * structure


def rescored(score: Column, c: Column) -> Column:
    """The enhanced score where there is none yet."""
    return F.when(score == 0.0, enhanced_score(c)).otherwise(score)


def band(score: Column, high: float = 0.7, low: float = 0.4) -> Column:
    return F.when(score > high, "high").when(score >= low, "medium").otherwise("low")


def sentences(c: Column) -> Column:
    """Sentences: cut after . ! or ? and closing marks, before white space and a capital letter or digit."""
    marked = F.regexp_replace(c, r"([.!?]+[\"')\]]*)\s+(?=[A-Z0-9])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def preview(c: Column, length: int = 100) -> Column:
    return F.translate(F.substring(c, 1, length), "\n", " ")


def web_clean(c: Column, most: int = 500) -> Column:
    flat = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def html_to_text(c: Column) -> Column:
    """All text of a page: scripts, styles, comments and tags as blanks, common references decoded."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(mark))
    return strip(F.regexp_replace(bare, r"\s+", " "))
