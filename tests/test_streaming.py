from pyspark.sql import functions as F

from vidweave.operators import retrieval as R
from vidweave.streaming import windows as W


def test_rate_limit(spark):
    df = spark.createDataFrame([("a", f"2024-01-01 00:00:0{s}", s) for s in range(6)] + [("a", "2024-01-01 00:00:10", 9)], "scope string, ts string, request_id long").selectExpr("scope", "cast(ts as timestamp) ts", "request_id")
    got = W.rate_limit(df, 5, 10).orderBy("request_id").collect()
    assert [r["allowed"] for r in got] == [True] * 5 + [False, True]


def test_lockout():
    rows = W.lockout_rows("k", [(t, t, False) for t in range(4)], most=3)
    assert [(r[3], r[4]) for r in rows] == [(False, False), (False, False), (True, False), (True, True)]
    assert W.lockout_rows("k", [(0, 0, False), (601, 1, False)])[1][2] == 1
    assert W.lockout_rows("k", [(0, 0, False), (1, 1, True), (2, 2, False)])[2][2] == 1


def test_event_fold(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(("claim", "claim", "publish", "consumed"))] + [(2, 0, "claim"), (2, 1, "recover")], "key long, n long, change string")
    assert {r["key"]: (r["status"], r["applied"]) for r in W.event_state_fold(df, "key", ["n"]).collect()} == {1: ("CONSUMED", 2), 2: ("PUBLISHED", 2)}


def test_cache_ttl(spark):
    df = spark.createDataFrame([("k", m * 60, i) for i, m in enumerate((0, 20, 40, 65))], "key string, ts_s long, ask_id long")
    assert [r["hit"] for r in W.cache_hits_ttl(df).orderBy("ask_id").collect()] == [False, True, False, True]


def run_stream(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return q


def test_stream_equals_batch(spark, tmp_path):
    """Several micro-batches, a key with most rows, out of order within a batch, and events of long ago."""
    rows = [("hot", i * 7 % 100 + 100 * (i // 100), i, i % 9 == 0) for i in range(300)] + [("a", i, 1000 + i, False) for i in range(6)] + [("a", 700, 1010, False), ("b", 50, 1011, True)]
    df = spark.createDataFrame(rows, "key string, ts_s long, attempt_id long, success boolean").withColumn("ts_s", F.col("ts_s") + 1_000_000)
    for k, part in enumerate(("ts_s < 1000100", "ts_s >= 1000100 AND ts_s < 1000200", "ts_s >= 1000200")):
        df.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run_stream(W.login_lockout_stream(source), "lockout", tmp_path)
    batch = sorted(map(tuple, W.login_lockout(df).collect()))
    assert len(batch) == len(rows) and sorted(map(tuple, spark.table("lockout").collect())) == batch


def test_counting_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:0{s}", s, "x") for s in range(6)] + [("b", "2024-01-01 00:00:01", 7, "x"), ("a", "2024-01-01 00:00:02", 8, "x"), ("z", "2024-01-02 00:00:00", 9, "x")]
    df = spark.createDataFrame(rows, "scope string, ts string, request_id long, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.where("request_id < 9").coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    df.where("request_id = 9").coalesce(1).write.parquet(str(tmp_path / "in" / "p1"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run_stream(W.rate_limit_stream(source, 5, 10, delay="1 minute"), "limited", tmp_path)
    assert [(r["scope"], r["n"]) for r in spark.table("limited").collect()] == [("a", 7)]
    run_stream(W.outbox_create_stream(source, ["scope", "kind"], "ts"), "outbox", tmp_path)
    assert sorted(r["scope"] for r in spark.table("outbox").collect()) == ["a", "b", "z"]
    run_stream(W.progress(source.select("scope", "ts", "request_id"), "scope", "ts", F.lit("2024-01-01 00:10:00").cast("timestamp")), "progress", tmp_path, "update")
    assert ("a", 5) in {(r["scope"], r["request_id"]) for r in spark.table("progress").collect()}


def test_ingest_stream_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id long, content string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        W.ingest_stream(source, str(tmp_path / "index"), str(tmp_path / "cp"), lambda b: b.withColumn("n", F.length("content"))).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [0, 1, 2, 3, 4]


def test_diversify(spark):
    df = spark.createDataFrame([(1, v, r) for r, v in enumerate("AABC")], "question_id long, video_id string, rank long")
    assert [r["video_id"] for r in R.diversify(df, 3).orderBy("rank").collect()] == ["A", "B", "C"]
