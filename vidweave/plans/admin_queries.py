"""Queries of summaries, bases, tasks, uploads, events and users over the given tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.operators import relational as R
from vidweave.operators import summaries as M
from vidweave.sources import tables as S
from vidweave.sources.tables import table, with_ctes

KB = ("videos", "knowledge_bases", "kb_videos")


def _local(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all videos; those of every seventh id have no segments."""
    return M.summary_assets(S.videos(spark, d), S.segments(spark, d).where("video_id % 7 <> 0"))


def g23_summary_assets(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d).select("video_id", "type", "title", F.size("items").cast("long").alias("n_items"), F.md5(F.array_join("items", "\n")).alias("items_md5"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN {x} = '' THEN {_q(M.NOTHING)} WHEN length({x}) > {n} THEN substr({x}, 1, {n - 1}) || '…' ELSE {x} END"


def _sql(template: str) -> str:
    out, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        hole, _, rest = tail.partition("}")
        kind, _, n = hole.partition(":")
        value = {"name": "original_name", "range": "times", "first": "f", "all": "a"}[kind]
        out += [_q(before), f"({_cut(value, int(n))})" if n else value]
    return " || ".join([*out, _q(rest)])


_LIST = lambda items: "[" + ", ".join(map(_sql, items)) + "]"
_SPACE = r"trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_CLOCK = lambda c: f"printf('%02d:%02d', {c} // 60000, {c} // 1000 % 60)"
_HIT = lambda words: "bool_or(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"
_FOUND = ", ".join(f"{_HIT(words)} AS w{k}" for k, (_, words) in enumerate(M.INSIGHTS))
_INSIGHTS = "list_filter([" + ", ".join(f"CASE WHEN w{k} THEN {_q(text)} END" for k, (text, _) in enumerate(M.INSIGHTS)) + "], lambda x: x IS NOT NULL)"
_KINDS = " UNION ALL ".join(
    f"SELECT video_id, '{kind}' AS type, '{title}' AS title, CASE WHEN f IS NULL THEN {_LIST(M.WITHOUT_TEXT[kind])} "
    + (f"ELSE {_LIST(M.WITH_TEXT[kind])} END" if kind in M.WITH_TEXT else f"WHEN len({_INSIGHTS}) = 0 THEN {_LIST(M.NO_INSIGHT)} ELSE {_INSIGHTS} END")
    + " AS items FROM v"
    for kind, title, _ in M.SUMMARIES
)
G23 = with_ctes("videos", "segments") + f""", s AS (SELECT *, {_SPACE} AS x FROM segments WHERE video_id % 7 <> 0),
g AS (SELECT video_id, arg_min(x, segment_index) AS f, {_CLOCK('arg_min(start_ms, segment_index)')} || '-' || {_CLOCK('arg_min(end_ms, segment_index)')} AS times, string_agg(x, ' ' ORDER BY segment_index) FILTER (WHERE x <> '') AS a, {_FOUND} FROM s GROUP BY 1),
v AS (SELECT * FROM videos LEFT JOIN g USING (video_id)), k AS ({_KINDS}) SELECT video_id, type, title, len(items) AS n_items, md5(array_to_string(items, chr(10))) AS items_md5 FROM k"""


def g22_ensure_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Every second video has an old summary, some of the present prompt version; every third gets generated ones."""
    v = S.videos(spark, d)
    k = F.col("video_id")
    row = lambda kind, title, model: ["video_id", F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit("{}").alias("content_json"), F.lit(model).alias("model")]
    old = v.where("video_id % 2 = 0").select(*row("CORE_POINTS", "old", "first"), F.when(k % 4 == 0, "llm-v1").alias("prompt_version"))
    new = v.where("video_id % 3 = 0").select(*row("CORE_POINTS", "new", "second")).union(v.where("video_id % 3 = 0").select(*row("PPT_OUTLINE", "new", "second")))
    out = M.ensure_summaries(old, _local(spark, d).drop("items"), new)
    return out.select("video_id", "type", "title", "model", "prompt_version")


G22 = with_ctes("videos") + ", k(type, local) AS (VALUES " + ", ".join(f"('{kind}', '{title}')" for kind, title, _ in M.SUMMARIES) + """), r AS (SELECT video_id, type, local, video_id % 3 = 0 AND video_id % 4 <> 0 AS fresh, type = 'CORE_POINTS' AND video_id % 2 = 0 AS old FROM videos, k)
SELECT video_id, type, CASE WHEN fresh AND type IN ('CORE_POINTS', 'PPT_OUTLINE') THEN 'new' WHEN old THEN 'old' ELSE local END AS title, CASE WHEN fresh AND type IN ('CORE_POINTS', 'PPT_OUTLINE') THEN 'second' WHEN old THEN 'first' END AS model,
CASE WHEN fresh AND type IN ('CORE_POINTS', 'PPT_OUTLINE') OR old AND video_id % 4 = 0 THEN 'llm-v1' END AS prompt_version FROM r WHERE NOT fresh OR old OR type IN ('CORE_POINTS', 'PPT_OUTLINE')"""


def g2_kb_video_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.kb_links(S.knowledge_bases(spark, d), S.kb_videos(spark, d))


G2_LINKS = with_ctes(*KB) + "SELECT b.user_id, l.kb_id, l.video_id FROM kb_videos l JOIN knowledge_bases b USING (kb_id)"


def g2_kb_ids_by_video(spark: SparkSession, d: str) -> DataFrame:
    out = R.kb_ids_by_video(S.knowledge_bases(spark, d), S.kb_videos(spark, d))
    return out.select("user_id", "video_id", F.array_join(F.col("kb_ids").cast("array<string>"), ",").alias("kb_ids"))


G2_IDS = with_ctes(*KB) + "SELECT b.user_id, l.video_id, string_agg(CAST(l.kb_id AS VARCHAR), ',' ORDER BY l.kb_id) AS kb_ids FROM kb_videos l JOIN knowledge_bases b USING (kb_id) GROUP BY ALL"


def g9_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The newest failed jobs with their customer and nation (a top-k report)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("video_id"), F.col("c_nationkey").cast("long").alias("user_id"), F.col("c_name").alias("original_name"))
    users = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.col("n_name").alias("email"))
    jobs = S.jobs(spark, d).drop("user_id").withColumnRenamed("created_at", "updated_at")
    return R.task_list(jobs, c, users, " failed ", 500)


G9 = with_ctes("jobs") + """SELECT job_id, video_id, CAST(c_nationkey AS BIGINT) AS user_id, n_name AS user_email, c_name AS original_name, status, created_at AS updated_at FROM jobs JOIN customer ON video_id = c_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE status = 'FAILED' ORDER BY created_at DESC, job_id DESC LIMIT 200"""


def _users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    deleted = F.when(k % 7 == 0, F.lit("2024-01-01").cast("date")).alias("deleted_at")
    return table(spark, d, "customer").select(k.cast("long").alias("user_id"), (k % 5 == 0).alias("disabled"), deleted, F.round(F.col("c_acctbal") * 100).cast("long").alias("created_at"))


def g10_resources(spark: SparkSession, d: str) -> DataFrame:
    return R.resource_usage(_users(spark, d), S.videos(spark, d), S.knowledge_bases(spark, d), S.jobs(spark, d))


G10 = with_ctes("videos", "knowledge_bases", "jobs") + """SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0) AS active_users, (SELECT count(*) FROM videos) AS videos,
(SELECT CAST(sum(file_size_bytes) AS BIGINT) FROM videos) AS storage_bytes, (SELECT count(*) FROM knowledge_bases) AS bases, (SELECT count(*) FROM jobs WHERE status = 'FAILED') AS failed, (SELECT count(*) FROM jobs WHERE status = 'RUNNING') AS running"""


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as upload sessions in small parts; some have a bad sum, size, part size or number of parts."""
    k = F.col("o_orderkey")
    md5 = F.when(k % 11 == 0, "no sum").otherwise(F.upper(F.md5(k.cast("string"))))
    asked = F.when(k % 3 == 0, F.lit(3)).when(k % 3 == 1, F.lit(0)).cast("long")
    return table(spark, d, "orders").select(k.cast("long").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("UPLOADING").alias("status"), md5.alias("file_md5"), (k % 150).cast("long").alias("file_size"), (k % 30 + 1).cast("long").alias("part_size"), asked.alias("requested_parts"))


def g18_session_plans(spark: SparkSession, d: str) -> DataFrame:
    return R.plan_sessions(_sessions(spark, d), 5, 25, 20).select("session_id", "verdict", "total_parts")


_PLANS = """k AS (SELECT CAST(o_orderkey AS BIGINT) AS session_id, o_orderstatus <> 'F' AS uploading, o_orderkey % 11 = 0 AS bad, o_orderkey % 150 AS size, o_orderkey % 30 + 1 AS part, CASE WHEN o_orderkey % 3 = 0 THEN 3 END AS asked, CAST(ceil(o_orderkey % 150 / (o_orderkey % 30 + 1)) AS BIGINT) AS total FROM orders),
plans AS (SELECT *, CASE WHEN bad THEN 'md5' WHEN size = 0 THEN 'file_size' WHEN part NOT BETWEEN 5 AND 25 THEN 'part_size' WHEN total NOT BETWEEN 1 AND 20 THEN 'part_count' WHEN asked <> total THEN 'total_parts' ELSE 'ok' END AS verdict FROM k)"""
G18 = f"WITH {_PLANS} SELECT session_id, verdict, CASE WHEN verdict = 'ok' THEN total END AS total_parts FROM plans"


def g18_check_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of planned sessions; a third have the right size, some a sum that is wrong."""
    sessions = R.plan_sessions(_sessions(spark, d), 5, 25, 20).where("verdict = 'ok'")
    p = R.upsert_parts(S.parts(spark, d)).join(sessions.select("session_id", "part_size"), "session_id")
    size = F.when(F.col("session_id") % 4 == 0, F.lit(0)).when(F.col("size_bytes") % 3 == 0, F.col("size_bytes")).otherwise(F.col("part_size"))
    md5 = F.md5(F.col("part_number").cast("string"))
    expected = F.when(F.col("size_bytes") % 5 == 0, " ").when(F.col("size_bytes") % 5 == 1, "other").otherwise(F.concat(F.lit(" "), F.upper(md5)))
    return R.check_parts(p.select("session_id", "part_number", size.cast("long").alias("size_bytes"), md5.alias("md5"), expected.alias("expected_md5")), sessions)


G18_PARTS = with_ctes("parts") + f""", {_PLANS}, p AS (SELECT session_id, part_number, arg_max(size_bytes, written) AS q FROM parts GROUP BY ALL),
z AS (SELECT *, CASE WHEN session_id % 4 = 0 THEN 0 WHEN q % 3 = 0 THEN q ELSE part END AS n FROM p JOIN plans USING (session_id) WHERE verdict = 'ok')
SELECT session_id, part_number, CASE WHEN NOT uploading THEN 'status' WHEN part_number >= total THEN 'range' WHEN n = 0 THEN 'empty' WHEN n <> CASE WHEN part_number = total - 1 THEN size - part * (total - 1) ELSE part END THEN 'size' WHEN q % 5 = 1 THEN 'md5' ELSE 'ok' END AS verdict FROM z"""


def g19_reusable_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Orders ask for the open order equal to them in six columns."""
    o = table(spark, d, "orders")
    keys = [(F.col("o_custkey") % 40).cast("long"), F.col("o_orderpriority"), F.col("o_orderstatus"), (F.year("o_orderdate") % 2).cast("long"), F.lit(25).cast("long"), (F.month("o_orderdate") % 3).cast("long")]
    named = [c.alias(n) for c, n in zip(keys, R.SESSION_KEYS, strict=True)]
    status = F.when(F.col("o_orderkey") % 3 == 0, "UPLOADING").when(F.col("o_orderkey") % 3 == 1, "COMPLETING").otherwise("DONE")
    sessions = o.select(*named, F.col("o_orderkey").cast("long").alias("session_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))
    return R.reusable_sessions(o.select(F.col("o_orderkey").cast("long").alias("request_id"), *named), sessions)


G19 = """WITH k AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderdate AS w, o_custkey % 40 AS a, o_orderpriority AS b, o_orderstatus AS c, year(o_orderdate) % 2 AS e, month(o_orderdate) % 3 AS f FROM orders),
s AS (SELECT a, b, c, e, f, arg_max(id, (w, id)) AS session_id FROM k WHERE id % 3 <> 2 GROUP BY ALL) SELECT id AS request_id, session_id FROM k JOIN s USING (a, b, c, e, f)"""


def g30_event_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 errors of each owner (a top-k report)."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("video_id"), F.upper("event_type").alias("status"), F.col("ts").alias("updated_at"))
    return R.event_list(e, S.videos(spark, d), " error", 1000).select("user_id", "event_id", "video_id", "rank")


G30 = with_ctes("videos") + """, e AS (SELECT v.user_id, event_id, video_id, row_number() OVER (PARTITION BY v.user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events e JOIN videos v ON v.video_id = e.user_id WHERE event_type = 'error') SELECT * FROM e WHERE rank <= 100"""


def g33_user_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 users (a top-k report)."""
    return R.user_list(_users(spark, d), 500).select("user_id", "created_at")


G33 = "SELECT CAST(c_custkey AS BIGINT) AS user_id, CAST(round(c_acctbal * 100) AS BIGINT) AS created_at FROM customer ORDER BY 2 DESC, 1 DESC LIMIT 200"

ORACLES = {"g23_summary_assets": G23, "g22_ensure_summaries": G22, "g2_kb_video_ids": G2_LINKS, "g2_kb_ids_by_video": G2_IDS, "g9_tasks": G9, "g10_resources": G10, "g18_session_plans": G18, "g18_check_parts": G18_PARTS, "g19_reusable_sessions": G19, "g30_event_list": G30, "g33_user_list": G33}
QUERIES = {k: globals()[k] for k in ORACLES}
