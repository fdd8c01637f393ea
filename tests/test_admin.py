"""Summaries, session plans, parts, lists and totals against hand-checked cases."""

import json

from vidweave.operators import relational as R
from vidweave.operators import summaries as M

SEGMENT = "video_id long, segment_index long, start_ms long, end_ms long, content string"


def summaries(spark, videos, rows):
    v = spark.createDataFrame(videos, "video_id long, original_name string")
    return {(r["video_id"], r["type"]): r for r in M.summary_assets(v, spark.createDataFrame(rows, SEGMENT)).collect()}


def test_summary_assets(spark):
    rows = [(1, 1, 61_000, 65_000, "the  Redis lock"), (1, 0, 5000, 6000, " w" * 200), (1, 2, 70_000, 71_000, "A DAG"), (2, 0, 0, 1000, " "), (2, 1, 1000, 2000, None), (4, 0, 0, 0, "plain")]
    got = summaries(spark, [(1, "one"), (2, "two"), (3, None), (4, "four")], rows)
    assert len(got) == 20
    core = got[1, "CORE_POINTS"]
    opening = " ".join("w" * 200)
    assert core["title"] == "ASR 核心观点" and core["items"][0] == "视频：one"
    assert core["items"][1] == "字幕内容概览：" + opening[:219] + "…" and core["items"][2] == "可追溯片段：00:05-00:06 " + opening[:119] + "…"
    assert json.loads(core["content_json"]) == {"points": core["items"]} and list(json.loads(got[1, "BLOG_OUTLINE"]["content_json"])) == ["items"]
    assert [x.split("：")[0] for x in got[1, "ENGINEERING_INSIGHTS"]["items"]] == ["Redis", "Java 并发"]
    # segments without text are segments; none at all is another thing
    assert got[2, "CORE_POINTS"]["items"][1] == "字幕内容概览：" + M.NOTHING and got[2, "ENGINEERING_INSIGHTS"]["items"] == M.NO_INSIGHT
    assert got[3, "MEETING_MINUTES"]["items"][0] == "会议主题：" and len(got[3, "MEETING_MINUTES"]["items"]) == 3 and len(got[3, "ENGINEERING_INSIGHTS"]["items"]) == 3
    assert got[4, "PPT_OUTLINE"]["items"][2] == "第 2 页：核心内容 - plain"


def test_summary_of_one_letter_segments_and_cuts_at_a_space(spark):
    rows = [(1, i, 0, 0, "x") for i in range(400)] + [(2, 0, 0, 0, "y" * 220 + " z")] + [(3, 0, 0, 0, "y" * 220)]
    got = summaries(spark, [(1, ""), (2, ""), (3, "")], rows)
    text = {v: got[v, "CORE_POINTS"]["items"][1].removeprefix("字幕内容概览：") for v in (1, 2, 3)}
    assert text == {1: " ".join("x" * 400)[:219] + "…", 2: "y" * 219 + "…", 3: "y" * 220}


def test_ensure_summaries(spark):
    columns = "video_id long, type string, title string, content_json string, model string, prompt_version string"
    old = spark.createDataFrame([(1, "A", "old", "", "m", "llm-v1"), (2, "A", "old", "", None, None), (2, "C", "old", "", None, None)], columns)
    local = spark.createDataFrame([(v, t, "local", "") for v in (1, 2, 3) for t in "AB"], "video_id long, type string, title string, content_json string")
    new = spark.createDataFrame([(v, "A", "new", "", "m2") for v in (1, 2)], "video_id long, type string, title string, content_json string, model string")
    got = {(r["video_id"], r["type"]): (r["title"], r["prompt_version"]) for r in M.ensure_summaries(old, local, new).collect()}
    assert got == {(1, "A"): ("old", "llm-v1"), (1, "B"): ("local", None), (2, "A"): ("new", "llm-v1"), (2, "C"): ("old", None), (3, "A"): ("local", None), (3, "B"): ("local", None)}


def test_session_plans(spark):
    md5, mb = "A" * 32, 1 << 20
    rows = [(1, md5, mb + 1, mb, None), (2, md5, mb, mb, 2), (3, "a" * 31, mb, mb, None), (4, None, 0, 0, None), (5, md5, 0, mb, None), (6, md5, mb, 262143, None), (7, md5, 100001 * 262144, 262144, None), (8, md5, 100000 * 262144, 262144, 0), (9, md5, mb, 64 * mb + 1, None), (10, md5, mb, None, 1)]
    got = {r["session_id"]: (r["verdict"], r["total_parts"]) for r in R.plan_sessions(spark.createDataFrame(rows, "session_id long, file_md5 string, file_size long, part_size long, requested_parts long")).collect()}
    assert got == {1: ("ok", 2), 2: ("total_parts", None), 3: ("md5", None), 4: ("md5", None), 5: ("file_size", None), 6: ("part_size", None), 7: ("part_count", None), 8: ("ok", 100000), 9: ("part_size", None), 10: ("part_size", None)}


def test_check_parts(spark):
    sessions = spark.createDataFrame([(1, "UPLOADING", 25, 10, 3), (2, "DONE", 25, 10, 3)], "session_id long, status string, file_size long, part_size long, total_parts long")
    rows = [(1, 0, 10, "ab", None), (1, 1, 10, "ab", " AB "), (1, 2, 5, "ab", "cd"), (1, 2, 10, "ab", None), (1, 3, 10, "ab", None), (1, -1, 10, "ab", None), (1, 0, 0, "ab", None), (1, None, 1, "ab", None), (1, 0, 10, None, "ab"), (2, 0, 10, "ab", None), (9, 0, 1, "ab", None)]
    got = sorted((r["session_id"], r["part_number"] is None, r["part_number"] or 0, r["verdict"]) for r in R.check_parts(spark.createDataFrame(rows, "session_id long, part_number long, size_bytes long, md5 string, expected_md5 string"), sessions).collect())
    want = [(1, False, 0, "ok"), (1, False, 1, "ok"), (1, False, 2, "md5"), (1, False, 2, "size"), (1, False, 3, "range"), (1, False, -1, "range"), (1, False, 0, "empty"), (1, True, 0, "range"), (1, False, 0, "md5"), (2, False, 0, "status")]
    assert got == sorted(want)


def test_lists_and_totals(spark):
    users = spark.createDataFrame([(1, False, None, 5), (2, True, None, 5), (3, False, "gone", 9)], "user_id long, disabled boolean, deleted_at string, created_at long")
    videos = spark.createDataFrame([(1, 1, "a", 7), (2, 1, "b", None)], "video_id long, user_id long, original_name string, file_size_bytes long")
    bases = spark.createDataFrame([(5, 1), (6, 2)], "kb_id long, user_id long")
    links = spark.createDataFrame([(5, 1), (6, 1), (5, 2), (7, 1)], "kb_id long, video_id long")
    jobs = spark.createDataFrame([(1, 1, "FAILED", 3), (2, 2, "RUNNING", 3), (3, 9, "FAILED", 1)], "job_id long, video_id long, status string, updated_at long")
    assert tuple(R.resource_usage(users, videos, bases, jobs).first()) == (3, 1, 2, 7, 2, 2, 1)
    assert tuple(R.resource_usage(*[t.limit(0) for t in (users, videos, bases, jobs)]).first()) == (0,) * 7
    assert [r["user_id"] for r in R.user_list(users, 2).collect()] == [3, 2] and R.user_list(users, 0).count() == 1
    assert {(r["user_id"], r["video_id"]): r["kb_ids"] for r in R.kb_ids_by_video(bases, links).collect()} == {(1, 1): [5], (2, 1): [6], (1, 2): [5]}
    mail = users.withColumn("email", users.created_at.cast("string"))
    assert [r["job_id"] for r in R.task_list(jobs, videos, mail, " all ").collect()] == [2, 1] and [r["job_id"] for r in R.task_list(jobs, videos, mail, "running").collect()] == [2]
    events = jobs.withColumnRenamed("job_id", "event_id")
    assert [(r["event_id"], r["rank"]) for r in R.event_list(events, videos).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert [r["event_id"] for r in R.event_list(events, videos, "failed", 5).collect()] == [1]
