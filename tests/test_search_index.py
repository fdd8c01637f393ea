"""The stored index against plain cosines, its bounds, and its updates."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from vidweave.operators import retrieval as R
from vidweave.operators import search_index as X
from vidweave.streaming import windows as W

WORDS = [f"word{i}" for i in range(60)]


def bucket(token, dim):
    h = 0
    for c in token:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return (h & 0x7FFFFFFF) % dim


def vector(text, dim):
    return Counter(bucket(t, dim) for t in text.split())


def segments_of(seed):
    """Most segments are of video 1; some have no token, two are equal."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), i, i * 1000, " ".join(rng.choices(WORDS, k=rng.randrange(0, 9)))) for i in range(300)]
    return rows + [(400, 2, 400, 0, "word1 word2"), (401, 2, 401, 0, "word1 word2"), (402, 2, 402, 0, "!"), (403, 2, 403, 0, None)]


SEGMENTS = "id long, video_id long, segment_index long, start_ms long, content string"


def best(rows, text, videos, k, least, dim):
    q = vector(text, dim)
    found = []
    for i, v, n, start, content in rows:
        s = vector(content or "", dim)
        if v in videos and s and (content or "") != "!":
            dot = sum(c * s[b] for b, c in q.items())
            vec = round(dot / math.sqrt(sum(c * c for c in s.values())) / math.sqrt(sum(c * c for c in q.values())) + 1e-12, 6)
            if dot and vec >= least:
                found.append((-vec, start, v, n, i))
    return [(i, -vec) for vec, *_, i in sorted(found)[:k]]


def asked(spark, rows, index, k, least, dim):
    questions = [(10, "word1 word2 word3"), (11, "word4 word4 word5 word6 word7"), (12, "nothing"), (13, "?")]
    scopes = [(q, v) for q, _ in questions for v in ((1, 2) if q != 11 else (1, 2, 3, 9))]
    q, s = spark.createDataFrame(questions, "question_id long, question string"), spark.createDataFrame(scopes, "question_id long, video_id long")
    got = R.vector_search(q, s, index, k, least, dim, groups=[]).collect()
    for i, text in questions:
        own = [(r["id"], r["vec"]) for r in sorted((r for r in got if r["question_id"] == i), key=lambda r: r["rank"])]
        want = best(rows, text, [v for x, v in scopes if x == i], k, least, dim) if i != 13 else []
        assert [x for x, _ in own] == [x for x, _ in want]
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(own, want, strict=True))
    vectors = R.sparse_vectors(q, ["question_id"], "question", dim, [])
    return X.search_report(index, vectors, s, k, least, dim).first()


def test_search_equals_plain_cosines(spark, tmp_path):
    rows = segments_of(1)
    df = spark.createDataFrame(rows, SEGMENTS).repartition(3)
    index = X.build_index(df, str(tmp_path / "index"), dim=64, groups=[], shards=2, block_rows=8)
    blocks = index.collect()
    assert all(len(b["ids"]) <= 8 for b in blocks) and len([b for b in blocks if b["video_id"] == 1]) > 10
    assert sorted(i for b in blocks for i in b["ids"]) == [r[0] for r in rows if (r[4] or "!") != "!"]
    report = asked(spark, rows, index, 5, 0.08, 64)
    assert 0 < report["skipped"] < report["pairs"]
    assert asked(spark, rows, index, 3, 0.5, 64)["skipped"] > report["skipped"]  # a higher need skips more
    empty = X.build_index(df.limit(0), str(tmp_path / "none"), dim=64, groups=[])
    assert empty.count() == 0


def test_update_replaces_blocks(spark, tmp_path):
    rows = segments_of(2)
    path = str(tmp_path / "index")
    X.build_index(spark.createDataFrame(rows, SEGMENTS), path, dim=64, groups=[], shards=4, block_rows=8)
    new = [(r[0], r[1], r[2], r[3], "word9 word8") for r in rows if r[1] == 2 and r[0] % 2] + [(900, 9, 0, 0, "word4 word5")]
    changed = {r[0]: r for r in new}
    now = [changed.get(r[0], r) for r in rows] + [new[-1]]
    for _ in range(2):  # a repeat changes nothing
        index = X.update_index(spark.createDataFrame(new, SEGMENTS), path, dim=64, groups=[], shards=4, block_rows=8)
        asked(spark, now, index, 6, 0.08, 64)
        have = {r["id"]: dict(zip(r["buckets"], r["counts"], strict=True)) for r in X.entries(index).collect()}
        assert have == {r[0]: dict(vector(r[4], 64)) for r in now if (r[4] or "!") != "!"}
    stats = {r["video_id"]: tuple(r)[1:] for r in X.index_stats(index).collect()}
    assert stats[9] == (1, 2)


def test_index_stream(spark, tmp_path):
    rows, path = segments_of(3), str(tmp_path / "index")
    df = spark.createDataFrame(rows, SEGMENTS)
    df.where("id % 2 = 0").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([], SEGMENTS)
    X.build_index(df.where("id % 3 = 0").withColumn("content", F.lit("word1")), path, dim=64, groups=[], shards=2)
    stream = spark.readStream.schema(SEGMENTS).parquet(str(tmp_path / "in"))
    W.index_stream(stream, path, str(tmp_path / "check"), dim=64, groups=[], shards=2).awaitTermination()
    have = {r["id"]: dict(zip(r["buckets"], r["counts"], strict=True)) for r in X.entries(X.read_index(spark, path)).collect()}
    full = lambda r: (r[4] or "!") != "!"
    want = {r[0]: dict(vector("word1" if r[0] % 2 else r[4], 64)) for r in rows if (r[0] % 2 == 0 and full(r)) or (r[0] % 2 and r[0] % 3 == 0)}
    assert {k: v for k, v in have.items() if k in want} == want
