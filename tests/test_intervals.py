from pyspark.sql import functions as F

from vidweave.operators import intervals as I
from vidweave.operators import quality as Q
from vidweave.operators import relational as R


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge(spark):
    df = spark.createDataFrame([(1, 0, 500), (1, 560, 900), (1, 1000, 1200)], "k long, start_ms long, end_ms long")
    assert rows(I.merge_intervals(df, "k"), "start_ms", "end_ms") == [(0, 900), (1000, 1200)]


def chain(spark):
    silences = spark.createDataFrame([(1, 2000, 4000), (1, 9950, 10000)], "k long, start_ms long, end_ms long")
    durations = spark.createDataFrame([(1, 10000)], "k long, duration_ms long")
    speech = I.complement_intervals(silences, durations, "k")
    return durations, speech, I.pad_and_merge(speech, durations, "k")


def test_complement_pad_map_and_gate(spark):
    durations, speech, padded = chain(spark)
    assert rows(speech, "start_ms", "end_ms") == [(0, 2000), (4000, 9950)]
    assert rows(padded, "start_ms", "end_ms") == [(0, 2120), (3880, 10000)]
    assert rows(I.cumulative_map(padded, "k"), "mapped_start_ms") == [(0,), (2120,)]
    gate = I.gain_gate(padded, durations, "k").first()
    assert (gate["kept_ms"], gate["saved_ms"], gate["applied"]) == (8240, 1760, True)


def test_map_back(spark):
    _, _, padded = chain(spark)
    points = spark.createDataFrame([(1, i, t) for i, t in enumerate((100, 2120, 3000, 9000))] + [(2, 9, 77)], "k long, point_id long, t_ms long")
    assert rows(I.map_to_source(points, I.cumulative_map(padded, "k"), "k"), "point_id", "source_ms") == [(0, 100), (1, 2120), (2, 4760), (3, 10760), (9, 77)]


def test_locate(spark):
    segments = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 2000, 3000)], "k long, segment_index long, start_ms long, end_ms long")
    points = spark.createDataFrame([(1, 0, 500), (1, 1, 1500), (1, 2, 2500), (1, 3, -5)], "k long, point_id long, t_ms long")
    assert rows(I.locate_segment(points, segments, "k"), "point_id", "segment_index") == [(0, 0), (1, 0), (2, 1), (3, 0)]
    nested = spark.createDataFrame([(1, 0, 0, 9000), (1, 1, 2000, 3000)], "k long, segment_index long, start_ms long, end_ms long")
    assert rows(I.locate_segment(points.where("t_ms > 0"), nested, "k"), "segment_index") == [(0,), (0,), (0,)]


def test_silence_log(spark):
    lines = [(1, 1, "silence_start: 1.5"), (1, 2, "silence_start: 2.0005"), (1, 3, "silence_end: 3 | x"), (1, 4, "silence_end: 4"), (1, 5, "silence_start: 8")]
    df = spark.createDataFrame(lines, "k long, line_no long, line string")
    got = I.parse_silence_log(df, spark.createDataFrame([(1, 9000)], "k long, duration_ms long"), "k")
    assert rows(got, "start_ms", "end_ms") == [(2001, 3000), (8000, 9000)]


def test_probe_times(spark):
    at = lambda a, b: spark.range(1).select(I.sample_timestamps(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("t")).first()["t"]
    assert at(0, 2000) == [700, 1300, 1720]
    assert at(1000, 1000) == [1000]
    assert at(0, 200) == [120]


def test_quality(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("x", ""), ("", ""), (None, None)], "h string, r string")
    assert [r[0] for r in df.select(Q.cer(F.col("h"), F.col("r"))).collect()] == [0.25, 1.0, 0.0, 0.0]
    seg = spark.createDataFrame([(1, i, i * 10, "x") for i in range(10)], "video_id long, segment_index long, start_ms long, content string")
    assert rows(Q.systematic_sample(seg, 4), "segment_index") == [(0,), (2,), (5,), (7,)]
    delays = spark.createDataFrame([(a,) for a in (0, 3, 6, 12, 18, 30)], "a long").select(R.retry_delay(F.col("a")))
    assert [r[0] for r in delays.collect()] == [2, 2, 4, 16, 60, 60]


def test_quota_and_dedupe(spark):
    usage = spark.createDataFrame([(1, 10, 1, 1, 100, 1, 1)], "user_id long, used_bytes long, used_videos long, used_bases long, max_storage_bytes long, max_video_count long, max_knowledge_base_count long")
    verdict = R.quota_check(usage, spark.createDataFrame([(7, 1, 5)], "request_id long, user_id long, incoming_bytes long")).first()
    assert (verdict["allowed"], verdict["reason"]) == (False, "videos=1/1")
    videos = spark.createDataFrame([(1, 1, "AB"), (2, 1, "ab"), (3, 2, "ab")], "video_id long, user_id long, md5 string")
    assert rows(R.dedupe_assets(videos), "video_id", "asset_id", "deduplicated") == [(1, 1, False), (2, 1, True), (3, 3, False)]


def test_upload_progress(spark):
    parts = spark.createDataFrame([(1, p, 5) for p in (0, 1, 3)], "session_id long, part_number long, size_bytes long")
    got = R.upload_progress(parts, spark.createDataFrame([(1, 5)], "session_id long, total_parts long")).first()
    assert (got["missing"], got["complete"], got["uploaded_bytes"]) == ([2, 4], False, 15)
