import random

import pytest
from pyspark.sql import functions as F

from vidweave.functions.distance import edit_distance, edit_distances
from vidweave.operators import quality as Q


def plain(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def texts(seed=1, n=200):
    rng, out = random.Random(seed), []
    for _ in range(n):
        letters = rng.choice(["ab", "abcdefgh", "abcñ龥字😀x\x00"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 128, 129, 260)))) for _ in range(2))
        out.append((a, b if rng.random() < 0.7 else a[:50] + b[:3] + a[60:]))
    return out


def test_edit_distances_of_packs_of_any_size():
    a, b = zip(*texts(), strict=True)
    want = [plain(x, y) for x, y in zip(a, b, strict=True)]
    for words in (1, 7, 8192):
        assert edit_distances(list(a), list(b), words).tolist() == want
    assert edit_distances([], []).tolist() == []


def test_edit_distance_equals_spark(spark):
    rows = [*texts(2, 60), (None, "a"), ("a", None), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(edit_distance(F.col("a"), F.col("b")), F.levenshtein("a", "b")).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_fusion_report_of_long_lines(spark):
    """Spark's levenshtein, which took each line's table cell by cell and twice, is no more in the plan."""
    rng = random.Random(3)
    a, o = ("".join(rng.choice("abcdefgh ") for _ in range(2_000)) for _ in range(2))
    rows = [(1, a, o, a, True), (1, a, o, o, True), (1, "ab", "abab", "aab", True), (1, a, o, "", False), (2, None, "", None, True), (3, "x", "y", "x", False), (4, "abcd", "ab", None, True)]
    df = spark.createDataFrame(rows, "video_id long, asr string, ocr string, fused string, available boolean").coalesce(1)
    report = Q.fusion_report(df)
    assert "levenshtein" not in report._jdf.queryExecution().executedPlan().toString()
    got = {r[0]: r[1:] for r in report.collect()}
    want = df.where("available").groupBy("video_id").agg(F.avg(Q.cer(F.col("asr"), F.col("ocr"))).alias("c"), F.avg(Q.cer(F.col("fused"), F.col("ocr"))).alias("f"))
    for r in want.collect():
        assert (got[r[0]][3], got[r[0]][5]) == (pytest.approx(r[1], abs=1e-4), pytest.approx(r[2], abs=1e-4))
    assert got[1][:3] == (4, 3, 2) and got[3] == (1, 0, 0, 1.0, 0.0, 1.0, 0.0)


def test_fused_texts_of_all_modes_share_one_distance(spark):
    """F3's query: texts are cleaned once and Spark's levenshtein is no more in the plan; results are those of fuse_text."""
    rng, rows = random.Random(5), []
    lines = ["", "use claudecode", "use Code code now", "Ã©tÃ© Ã  la mer et plus", "çéèçéèçéèçéè", "spring boot 123", "99999999 1", "今天我们学习 数据库", "x" * 40, "rocket  mq and skil\x01"]
    for i in range(240):
        a = rng.choice(lines) if i % 3 else "".join(rng.choice("abc def") for _ in range(rng.choice((6, 20, 90))))
        o = rng.choice(lines) if i % 2 else "".join(x if rng.random() > 0.3 else rng.choice("xyz ") for x in a)
        rows.append((i, a if i % 17 else None, o, rng.choice((0.8, 0.88, 0.95, 0.97, 0.99, None))))
    df = spark.createDataFrame(rows, "id long, asr string, ocr string, confidence double")
    fused = Q.fuse_texts(df, list(Q.FUSION_MODES), traditional="們")
    want = df.select("id", *[Q.fuse_text(F.col("asr"), F.col("ocr"), F.col("confidence"), m, traditional="們") for m in Q.FUSION_MODES])
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, want.collect()))
    assert len({r[1:] for r in fused.collect()}) > 40
    assert "levenshtein" not in fused._jdf.queryExecution().executedPlan().toString()
