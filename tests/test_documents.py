"""Exports, context repair, summaries' items and frame lines against hand-checked cases."""

import json

from pyspark.sql import functions as F

from vidweave.operators import documents as D
from vidweave.operators import exports as X
from vidweave.operators import quality as Q
from vidweave.operators import relational as R

SEGMENT = "id long, video_id long, segment_index long, start_ms long, end_ms long, content string"


def segments(spark, texts):
    """texts: (video_id, content), numbered as they come."""
    return spark.createDataFrame([(i, v, i, i * 61_000, i * 61_000 + 5000, t) for i, (v, t) in enumerate(texts)], SEGMENT)


def test_summary_items(spark):
    cases = {'{"points": [" a ", "", "b"]}': ["a", "b"], '{"points": [], "items": [], "hooks": ["c"]}': ["c"], "{bad}": ["{bad}"], '{"points": ["a", }': ['{"points": ["a", }'], '["x"]': [], "7": [], '{"points": "a"}': [], '{"items": [1, true, null, {"y": 1}]}': ["1", "true"], "": [], " \n": [], "plain text": ["plain text"], None: []}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i long, t string")
    got = {r["i"]: r["x"] for r in df.select("i", D.summary_items(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_context_repair_needs_evidence(spark):
    texts = [(1, "the redis lock"), (1, "then read is fast"), (2, "read is a verb"), (3, "热点"), (3, "key 和 令牌桶"), (3, "ready is here"), (4, "热点 key"), (4, "read is here"), (5, None), (5, ""), (6, "use ai"), (6, "编程 now"), (6, "cortex"), (7, "claude"), (7, "cortex")]
    got = {r["id"]: r["text"] for r in D.context_repair(segments(spark, texts), terms=[]).collect()}
    # one strong needle; two weak ones, one of them over a border; one weak one is too few
    assert got == {1: "then Redis fast", 5: "Redis here"}
    texts = [(1, "my sql 索引"), (1, "买 SQL 的 事务"), (1, "xxxxx out of memory"), (1, "jvm"), (2, "  spaced   text ")]
    got = {r["id"]: r["text"] for r in D.context_repair(segments(spark, texts)).collect()}
    assert got == {0: "MySQL 索引", 1: "MySQL 的 事务", 2: "xxxxx OOM", 3: "JVM", 4: "spaced text"}


def test_context_rule_over_several_borders(spark):
    rule = D.ContextRule(("a b c",), "x", "y")
    texts = [(1, "q a"), (1, "b"), (1, "c"), (1, "x"), (2, "a b"), (2, ""), (2, "c"), (2, "x")]
    got = {r["id"]: r["text"] for r in D.context_repair(segments(spark, texts), [rule], [], width=2).collect()}
    assert got == {3: "y"}  # an empty segment leaves two spaces between


def test_repair_batch_counts_each_step(spark):
    texts = [(1, "redis  is"), (1, "read is fast"), (1, "erth"), (2, "fine")]
    clean = lambda c: F.struct(F.regexp_replace(c, r"\s+", " ").alias("text"), (F.regexp_replace(c, r"\s+", " ") != c).alias("changed"))
    done, counts = D.repair_batch(segments(spark, texts), terms=[], glossary=[("erth", "Earth")], repair=clean)
    assert {r["id"]: r["content"] for r in done.collect()} == {0: "redis is", 1: "Redis fast", 2: "Earth", 3: "fine"}
    got = {r["video_id"]: tuple(r)[1:] for r in counts.collect()}
    assert got == {1: (3, 1, 1, 1, 3, True), 2: (1, 0, 0, 0, 0, False)}


def export_tables(spark):
    videos = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, None, "orphan")], "id long, user_id long, original_name string")
    texts = segments(spark, [(1, f"line {i} \"q\"") for i in range(25)] + [(2, None), (3, "nobody's"), (9, "unknown video")])
    keys = spark.createDataFrame([(1, 10, "sk-secret-1234"), (2, 20, "sk-hidden-9876")], "id long, user_id long, api_key string")
    return {"videos": videos, "transcripts": texts.withColumn("user_id", F.lit(20)), "providers.llm": keys, "providers.rerank": keys.limit(0)}


def test_tenant_export(spark, tmp_path):
    out = X.tenant_export(export_tables(spark), chunk_rows=10, width=1)
    rows = {(r["user_id"], r["part"], r["chunk"]): json.loads(r["body"]) for r in out.collect()}
    assert set(rows) == {(10, "videos", 0), (20, "videos", 0), (10, "transcripts", 0), (10, "transcripts", 1), (10, "transcripts", 2), (20, "transcripts", 0), (10, "providers.llm", 0), (20, "providers.llm", 0)}
    own = [x for c in range(3) for x in rows[10, "transcripts", c]]
    assert [x["segment_index"] for x in own] == list(range(25)) and own[3]["content"] == 'line 3 "q"'
    assert rows[20, "transcripts", 0] == [{"video_id": 2, "segment_index": 25, "start_ms": 25 * 61_000, "end_ms": 25 * 61_000 + 5000, "content": None}]
    assert rows[10, "providers.llm", 0] == [{"id": 1, "api_key_masked": "****1234"}]
    X.write_export(out, str(tmp_path / "export"), F.lit("2024-01-01T00:00:00Z"))
    text = "".join(p.read_text() for p in (tmp_path / "export" / "user_id=20").glob("*.json"))
    assert "line 3" not in text and "sk-" not in text and "2024-01-01" in text
    assert X.tenant_export({k: v.limit(0) for k, v in export_tables(spark).items()}).count() == 0


def test_local_document(spark):
    texts = [(1, f"s{i} " + "w" * (200 if i == 1 else 3)) for i in range(12)] + [(2, " "), (3, "only")]
    requests = spark.createDataFrame([(1, "one", "PPT_OUTLINE"), (1, "one", "CORE_POINTS"), (2, "two", "CORE_POINTS"), (3, "three", "BLOG_OUTLINE"), (4, "four", "CORE_POINTS"), (5, "five", "CORE_POINTS")], "video_id long, original_name string, type string")
    outlines = spark.createDataFrame([(1, "CORE_POINTS", json.dumps({"points": [f"p{i}" for i in range(9)]})), (5, "CORE_POINTS", "not json")], "video_id long, type string, content_json string")
    got = {(r["video_id"], r["type"]): r for r in X.local_documents(requests, segments(spark, texts), outlines).collect()}
    assert set(got) == {(1, "PPT_OUTLINE"), (1, "CORE_POINTS"), (2, "CORE_POINTS"), (3, "BLOG_OUTLINE"), (5, "CORE_POINTS")}
    by_segments, by_outline = got[1, "PPT_OUTLINE"], got[1, "CORE_POINTS"]
    assert by_segments["title"] == "one - 演示汇报稿" and len(by_segments["sections"]) == len(by_outline["sections"]) == 8
    assert [s["bullets"][0] for s in by_outline["sections"][1:-1]] == [f"p{i}" for i in range(6)]
    assert "p0；p1；p2；p3；p4。" in by_outline["summary"] and "p5" not in by_outline["summary"]
    assert len(by_segments["notes"]) == 10 and by_segments["notes"][2] == "[02:02-02:07] s2 www" and by_segments["notes"][1].endswith("...")
    assert len(by_segments["summary"]) <= 483 and got[5, "CORE_POINTS"]["sections"][1]["bullets"][0] == "not json"
    assert got[2, "CORE_POINTS"]["notes"] == []


def test_coverage_sums_own_durations(spark):
    videos = spark.createDataFrame([(1, "a", "READY", 90_000), (2, "b", "PROCESSING", 5000)], "video_id long, original_name string, status string, duration_ms long")
    links = spark.createDataFrame([(7, 1), (7, 2), (8, 2)], "kb_id long, video_id long")
    rows = R.kb_coverage_videos(links, videos, segments(spark, [(1, "x"), (1, "y")]))
    assert {tuple(r)[1:2] + tuple(r)[4:] for r in rows.where("kb_id = 7").collect()} == {(1, 90_000, 2, 0, 66_000), (2, 5000, 0, 0, 0)}
    got = {r["kb_id"]: tuple(r)[1:] for r in R.kb_coverage(rows).collect()}
    assert got == {7: (2, 1, 2, 95_000, "2 videos, 1 ready, 2 transcript segments"), 8: (1, 0, 0, 5000, "1 videos, 0 ready, 0 transcript segments")}


def box(attempt, position, text, score=0.95, x=500.0, y=500.0, segment=0):
    return (1, segment, attempt, position, 1000, 600, [[x - 10, y - 5], [x + 10, y - 5], [x + 10, y + 5], [x - 10, y + 5]], text, score)


BOX = "video_id long, segment_index long, attempt long, position long, width int, height int, box array<array<double>>, text string, score double"


def test_subtitle_line_filters(spark):
    best = lambda rows, **k: {r["segment_index"]: r for r in Q.select_subtitle_line(spark.createDataFrame(rows, BOX), **k).collect()}
    lost = [box(0, 0, "unsure", 0.8), box(0, 1, "high", y=200.0), box(0, 2, "left", x=100.0), box(0, 3, "right", x=900.0), box(0, 4, "x"), box(0, 5, "w" * 91), box(0, 6, "12:30 5%"), box(0, 7, "·| -"), box(0, 8, None)]
    assert best(lost) == {}
    got = best([*lost, box(0, 9, " _kept line- "), box(1, 0, "later", 0.96)])
    assert tuple(got[0])[2:] == ("later", 0.96, 0.8333, 0.5, 1)
    assert best([box(0, 0, "latin", 0.99), box(0, 1, "有字", 0.9)])[0]["text"] == "有字"  # the bonus is whole, however few
    assert best([box(0, 0, "long and longer still"), box(0, 1, "short")])[0]["text"] == "short"
    assert best([box(0, 0, "same"), box(0, 1, "tied"), box(1, 0, "more")])[0]["text"] == "same"
    assert best([box(0, 0, "latin")], prefer_cjk=True) == {}
    assert best([box(0, 0, "12345ab")]) != {} and best([box(0, 0, "1234567a")]) == {}  # share of 0.78
