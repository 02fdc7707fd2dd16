"""Merging of clusters against a plain fold, and answers by route."""

import random
import re

from pyspark.sql import functions as F

from siltstone.operators import dedup, route
from siltstone.plans.engine import Engine


def sentences(t):
    return [s for s in (x.strip() for x in re.sub(r"([.!?]+[\"')\]]*)\s+(?=[A-Z0-9])", "\\1\x01", t).split("\x01")) if s]


def folded(rows):
    """rows of one component: (chunk_id, text, score, file); its merged text, every sentence against every other."""
    rows = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    seen, added = sentences(rows[0][1]), []
    for r in rows[1:]:
        def new(s):
            a = set(s.lower().split())
            return len(s) >= 20 and all(p.lower() != s.lower() and len(a & set(p.lower().split())) <= 0.7 * len(a | set(p.lower().split())) for p in seen)
        fresh = [s for s in sentences(r[1]) if new(s)][:3]
        seen, added = seen + fresh, added + fresh
    return rows[0][1] + ("\n\n" + " ".join(added) if added else ""), sorted(r[0] for r in rows), rows[0][0], "MERGED(" + ", ".join(sorted({r[3] for r in rows})) + ")"


def test_clusters_merge_as_a_plain_fold_does(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    said = lambda: " ".join(" ".join(draw.choice(words) for _ in range(draw.randint(2, 9))).capitalize() + draw.choice(".!?") for _ in range(draw.randint(0, 6)))
    rows = [(c, f"{c}_{i:03}", said(), draw.choice([None, 0.5, 0.7, draw.random()]), draw.choice("xyz")) for c in range(25) for i in range(draw.choice([1, 2, 3, 12, 60]))]
    placed = spark.createDataFrame(rows, "component long, chunk_id string, text string, information_score double, source_file string").repartition(6)
    got = sorted((r.text, r.merged_from, r.primary_chunk_id, r.source_file) for r in dedup.merge_clusters(placed).collect())
    want = sorted(folded([r[1:] for r in rows if r[0] == c]) for c in range(25) if sum(r[0] == c for r in rows) > 1)
    assert got == want and dedup.merge_clusters(placed.limit(0)).collect() == []


def test_a_large_cluster_merges(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("component"), F.col("id").alias("chunk_id"), F.concat(F.lit("The same opening sentence of all. Number "), F.col("id") % 500, F.lit(" has words like a"), F.col("id") % 500, F.lit(" and b"), F.col("id") % 500, F.lit(" alone.")).alias("text"), F.lit(0.5).alias("information_score"), F.lit("f").alias("source_file"))
    merged = dedup.merge_clusters(rows).first()
    assert merged.merge_count == n and merged.primary_chunk_id == 0 and merged.text.count("Number") == 500


def test_questions_go_by_their_routes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.process_texts(spark.createDataFrame([("a", "The library opens at nine in the morning on weekdays."), ("b", "Fees are paid at the office.")], "doc_id string, text string"))
    spark.createDataFrame([("BICS 2A", "maths", "Monday", "10:00", "11:00", "Room 4"), ("BICS 2B", "law", "Monday", "08:00", "09:00", "Room 5")], "class_group string, subject string, day string, start_time string, end_time string, room string").write.parquet(str(tmp_path / "schedules"))
    asked = [(1, "hello"), (2, "What time is the BICS 2A class on Monday?"), (3, "Which room is BICS 9Z in on Monday?"), (4, "why is the library open"), (5, None), (6, "")]
    got = {r.qid: r for r in engine.answer_all(spark.createDataFrame(asked, "qid long, text string")).collect()}
    assert len(got) == 6 and got[1].approach == "canned" and got[5].error == route.FAILED + "no question"
    assert (got[2].approach, got[2].result_count, got[2].answer) == ("structured", 1, "BICS 2A has maths on Monday from 10:00 to 11:00 in Room 4")
    assert (got[3].approach, got[3].fallback, got[3].answer) == ("semantic", "semantic", None) and got[4].sources
    assert engine.answer("What time is the BICS 2A class on Monday?").first().response == got[2].answer


def test_sentences_are_cut_one_by_one_as_the_expression_cuts_them(spark):
    from siltstone.functions import text as X

    draw = random.Random(8)
    marks = ["a", "B", "7", ".", "!", "?", '"', ")", " ", "  ", "\n", "\t", "\x01", "\x85", "\u2028", "\xa0", "\xe9", "\u0130", "", "Ab."]
    texts = ["", " ", ". A", "x.\x01A", "a. B \u2028", "a \x85 "] + ["".join(draw.choice(marks) for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.sentences(F.col("t")).alias("s"), F.transform(X.sentences(F.col("t")), X.strip).alias("bare")).collect()
    assert all([*dedup.listed_sentences(r.t)] == r.s and [dedup.BARE.sub("", s) for s in r.s] == r.bare for r in rows)
    later = dedup.listed_sentences("One is here. Two is here. " + "Three is here. " * 100_000)
    assert next(later) == "One is here." and next(later) == "Two is here."


def test_common_words_bring_no_comparisons():
    seen, n = dedup.Sentences(), 4000
    told = lambda i: {f"common{k}" for k in range(20)} | {f"own{i}x{k}" for k in range(12)}
    for i in range(n):
        assert not seen.has(str(i), told(i))
        seen.add(str(i), told(i))
    assert sum(len(seen.by_word.get(w, ())) for w in seen._firsts([*told(n)])) < n / 10
    assert seen.has("", told(7)) and seen.has("", told(7) - {"own7x1"}) and not seen.has("", {f"common{k}" for k in range(20)})
