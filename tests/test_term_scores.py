import random

import numpy as np
from pyspark.sql import functions as F

from vidweave.functions import text as T
from vidweave.operators import retrieval as R
from vidweave.operators.term_scores import Scorer, best_of_runs

WORDS = ["an", "the", "then", "other", "redis", "缓存", "缓存锁", "a1", "ñandú", "x-ray", "b"]


def lines(rng, n):
    return ["".join(rng.choice([*WORDS, " ", "  ", "\t"]) for _ in range(rng.choice((1, 4, 30)))) for _ in range(n)]


def test_scores_are_those_of_substrings():
    rng = random.Random(1)
    questions = [[("an", 2), ("the", 3), ("an", 5)], [("存锁", 2), ("x-r", 9), ("b", 2)], [], [("her", 3), ("nandu", 5)]]
    texts = [x.lower() for x in lines(rng, 200)] + ["", "an" * 100, "y" * 99 + "her"]
    for most in (2, 1000):
        scorer = Scorer(questions)
        scorer.runs.most = most
        assert scorer.scores(texts).tolist() == [[sum(w for t, w in q if t in x) for q in questions] for x in texts]
    assert Scorer([[]]).scores(["a", ""]).tolist() == [[0], [0]]


def test_best_of_runs_takes_earlier_rows_of_equal_scores():
    at, best = best_of_runs(np.array([[1, 0], [3, 0], [3, 0], [2, 7], [0, 0]]), np.array([0, 4]), 3)
    assert at.tolist() == [[[1, 2, 3], [3, 0, 1]], [[4, -1, -1], [4, -1, -1]]]
    assert best[0].tolist() == [[3, 3, 2], [7, 0, 0]]


def base(spark):
    rng = random.Random(2)
    texts = [(v, k * 1000, k, k * 1000 + 1000, x) for v in range(12) for k, x in enumerate(lines(rng, rng.choice((0, 1, 3, 40))))]
    segments = spark.createDataFrame([*texts, (3, None, 99, 5, "the other redis"), (4, 7, 98, 8, None)], "video_id long, start_ms long, segment_index long, end_ms long, content string").repartition(5)
    links = spark.createDataFrame([(1, v) for v in range(10)] + [(2, v) for v in range(5, 12)] + [(3, 1), (1, 2)], "kb_id long, video_id long")
    asked = spark.createDataFrame([(q, q % 4, rng.choice(["the an 缓存", " ", None, "Other REDIS then", "mysql b"])) for q in range(150)] + [(7, 3, "an")], "question_id long, kb_id long, question string")
    videos = spark.createDataFrame([(v, f"v{v}") for v in range(12)], "video_id long, original_name string")
    return asked, links, videos, segments


def test_viewpoints_never_pair_rows_of_segments_and_questions(spark):
    """each segment was a row for each question, sorted with its text; results are those of that join, also with packs
    of questions and long videos in parts."""
    asked, links, videos, segments = base(spark)
    found = R.kb_viewpoints(asked, links, videos, segments)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    text = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.lit(R.COMPARE_DEFAULT)).otherwise(F.trim("question"))
    terms = asked.where("kb_id IN (1, 2)").select("question_id", "kb_id", T.kb_query_terms(text).alias("terms"))
    rows = segments.where(F.length(F.trim("content")) >= 6).join(links, "video_id").join(terms, "kb_id").withColumn("score", T.kb_score(F.col("content"), F.col("terms")))
    want = {}
    for r in rows.collect():
        want.setdefault((r["kb_id"], r["question_id"], r["video_id"]), []).append((-r["score"], -1 if r["start_ms"] is None else r["start_ms"], r["segment_index"]))
    got = {(r["kb_id"], r["question_id"], r["video_id"]): [(-c["score"], c["segment_index"]) for c in r["citations"]] for r in found.collect()}
    assert {k: [(x[0], x[2]) for x in sorted(v)[:3]] for k, v in want.items()} == {k: v for k, v in got.items() if v}
    assert len(got) == terms.where("kb_id = 1").count() * 10 + terms.where("kb_id = 2").count() * 7
    from vidweave.operators.term_scores import best_segments

    entries = F.transform("terms", lambda t: F.struct(F.lower(t).alias("term"), F.greatest(F.lit(2), F.length(t)).alias("weight")))
    small = best_segments(terms.withColumn("terms", entries), links, segments.where(F.length(F.trim("content")) >= 6), "content", {}, 3, pack=2, shards=3, part=2)
    assert {(r[0], r[1], r[2]): [(b["less"], b["segment_index"]) for b in r["best"]] for r in small.collect()} == {k: v for k, v in got.items() if v}


def test_comparison_makes_the_viewpoints_once(spark):
    """the viewpoints were made twice, for the votes and for the first videos."""
    asked, links, videos, segments = base(spark)
    links = links.distinct()
    once = R.kb_compare(R.kb_viewpoints(asked, links, videos, segments, first=6), {"t": ["redis"], "u": ["mysql"]})
    twice = R.kb_compare(R.kb_viewpoints(asked, links, videos, segments), {"t": ["redis"], "u": ["mysql"]})
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() > 50
    assert max(len(r["differences"]) for r in once.collect()) == 6
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
