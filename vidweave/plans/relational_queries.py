"""Queries of the relational operators over the given tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.operators import relational as R
from vidweave.sources import tables as S
from vidweave.sources.tables import table, with_ctes

KB = ("videos", "knowledge_bases", "kb_videos")


def g1_kb_list(spark: SparkSession, d: str) -> DataFrame:
    return R.kb_list(S.knowledge_bases(spark, d), S.kb_videos(spark, d))


G1 = with_ctes(*KB) + "SELECT b.kb_id, b.user_id, count(v.video_id) AS video_count FROM knowledge_bases b LEFT JOIN kb_videos v USING (kb_id) GROUP BY ALL"


def g2_kb_videos(spark: SparkSession, d: str) -> DataFrame:
    return R.kb_videos(S.knowledge_bases(spark, d), S.kb_videos(spark, d), S.videos(spark, d))


G2 = with_ctes(*KB) + "SELECT l.kb_id, l.video_id, b.user_id FROM kb_videos l JOIN knowledge_bases b USING (kb_id) JOIN videos v USING (video_id) WHERE b.user_id = v.user_id"


def _kb_requests(spark: SparkSession, d: str) -> DataFrame:
    return S.videos(spark, d).where("video_id % 3 = 1").select("user_id", (F.col("user_id") + 1000).alias("kb_id"), "video_id")


def g3_kb_add_video(spark: SparkSession, d: str) -> DataFrame:
    return R.kb_add_videos(S.knowledge_bases(spark, d), S.kb_videos(spark, d), S.videos(spark, d), _kb_requests(spark, d))


G3 = with_ctes(*KB) + """SELECT DISTINCT r.kb_id, r.video_id FROM (SELECT user_id, user_id + 1000 AS kb_id, video_id FROM videos WHERE video_id % 3 = 1) r
JOIN knowledge_bases b ON b.user_id = r.user_id AND b.kb_id = r.kb_id WHERE NOT EXISTS (SELECT 1 FROM kb_videos l WHERE l.kb_id = r.kb_id AND l.video_id = r.video_id)"""


def g4_kb_delete(spark: SparkSession, d: str) -> DataFrame:
    bases = S.knowledge_bases(spark, d)
    requests = bases.where("kb_id % 4 = 0").select(F.when(F.col("kb_id") % 8 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"), "kb_id")
    return R.kb_delete(bases, S.kb_videos(spark, d), requests)[1]


G4 = with_ctes(*KB) + "SELECT kb_id, video_id FROM kb_videos WHERE kb_id NOT IN (SELECT kb_id FROM knowledge_bases WHERE kb_id % 8 = 0)"


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.kb_coverage_videos(S.kb_videos(spark, d), S.videos(spark, d), S.segments(spark, d))


def g5_kb_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.kb_coverage(_coverage(spark, d))


_G5 = with_ctes("videos", "kb_videos", "segments") + """, c AS (SELECT video_id, count(*) AS n, min_by(start_ms, segment_index) AS a, max_by(end_ms, segment_index) AS b FROM segments GROUP BY 1),
r AS (SELECT kb_id, video_id, original_name, status, duration_ms, coalesce(n, 0) AS transcript_count, CAST(coalesce(a, 0) AS BIGINT) AS first_start_ms, CAST(coalesce(b, 0) AS BIGINT) AS last_end_ms FROM kb_videos JOIN videos USING (video_id) LEFT JOIN c USING (video_id))"""
G5 = _G5 + """SELECT *, videos || ' videos, ' || ready || ' ready, ' || segments || ' transcript segments' AS summary FROM (
SELECT kb_id, count(*) AS videos, count(*) FILTER (WHERE status = 'READY') AS ready, CAST(sum(transcript_count) AS BIGINT) AS segments, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM r GROUP BY 1)"""


def g5_kb_coverage_videos(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)


G5_VIDEOS = _G5 + " SELECT * FROM r"


def g7_latest_job(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(S.jobs(spark, d), ["video_id"], ["created_at", "job_id"]).select("video_id", "job_id", "status")


G7 = with_ctes("jobs") + "SELECT video_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, job_id DESC) AS r FROM jobs) WHERE r = 1"


def g8_recovery_queue(spark: SparkSession, d: str) -> DataFrame:
    return R.recovery_queue(S.jobs(spark, d), 5).select("user_id", "job_id", "rank")


G8 = with_ctes("jobs") + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, job_id DESC) AS r FROM jobs) WHERE r = 1 AND status = 'FAILED')
SELECT * FROM (SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC) AS rank FROM l) WHERE rank <= 5"""


def g9_task_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 failed tasks with their customer (a top-k report)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("video_id"), "c_name")
    return S.jobs(spark, d).where("status = 'FAILED'").join(c, "video_id").orderBy(F.desc("created_at"), F.desc("job_id")).limit(200).select("job_id", "video_id", "c_name")


G9 = with_ctes("jobs") + "SELECT job_id, video_id, c_name FROM jobs JOIN customer ON video_id = c_custkey WHERE status = 'FAILED' ORDER BY created_at DESC, job_id DESC LIMIT 200"


def g10_resource_usage(spark: SparkSession, d: str) -> DataFrame:
    v = S.videos(spark, d).agg(F.count(F.lit(1)).alias("videos"), F.sum("file_size_bytes").alias("bytes"), F.countDistinct("user_id").alias("users"))
    j = S.jobs(spark, d).agg(F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"), F.count(F.when(F.col("status") == "RUNNING", 1)).alias("running"))
    b = S.knowledge_bases(spark, d).agg(F.count(F.lit(1)).alias("bases"))
    return v.crossJoin(j).crossJoin(b)  # one row each


G10 = with_ctes("videos", "knowledge_bases", "jobs") + """SELECT * FROM (SELECT count(*) AS videos, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, count(DISTINCT user_id) AS users FROM videos),
(SELECT count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'RUNNING') AS running FROM jobs), (SELECT count(*) AS bases FROM knowledge_bases)"""


def g11_provider_summary(spark: SparkSession, d: str) -> DataFrame:
    kinds = (("LLM", "supplier", "s_suppkey", "s_name"), ("EMBEDDING", "customer", "c_custkey", "c_name"), ("RERANK", "part", "p_partkey", "p_name"))
    frames = [table(spark, d, t).select(F.lit(k).alias("kind"), F.col(i).cast("long").alias("id"), F.col(n).alias("name"), F.lit("-").alias("mode")) for k, t, i, n in kinds]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


G11 = " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({i} AS BIGINT) AS id, {n} AS name, '-' AS mode FROM {t}" for k, t, i, n in (("LLM", "supplier", "s_suppkey", "s_name"), ("EMBEDDING", "customer", "c_custkey", "c_name"), ("RERANK", "part", "p_partkey", "p_name")))


def _providers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select((F.col("s_suppkey") % 10).cast("long").alias("user_id"), F.col("s_suppkey").cast("long").alias("id"), (F.col("s_suppkey") % 3 == 0).alias("active"), (F.col("s_suppkey") % 2 == 0).alias("enabled"))


_PROV = "providers AS (SELECT CAST(s_suppkey % 10 AS BIGINT) AS user_id, CAST(s_suppkey AS BIGINT) AS id, s_suppkey % 3 = 0 AS active, s_suppkey % 2 = 0 AS enabled FROM supplier)"


def g12_active_provider(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(_providers(spark, d).where("active AND enabled"), ["user_id"], ["id"]).select("user_id", "id")


G12 = f"WITH {_PROV} SELECT user_id, max(id) AS id FROM providers WHERE active AND enabled GROUP BY 1"


def g13_provider_activate(spark: SparkSession, d: str) -> DataFrame:
    p = _providers(spark, d)
    return R.provider_activate(p, p.where("user_id < 5").groupBy("user_id").agg(F.min("id").alias("id")))


G13 = f"""WITH {_PROV}, r AS (SELECT user_id, min(id) AS chosen FROM providers WHERE user_id < 5 GROUP BY 1) SELECT user_id, id,
CASE WHEN chosen IS NULL THEN active ELSE id = chosen END AS active, CASE WHEN id = chosen THEN true ELSE enabled END AS enabled FROM providers LEFT JOIN r USING (user_id)"""


def _usage(spark: SparkSession, d: str) -> DataFrame:
    limit = F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal") * 200)
    users = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), limit.cast("long").alias("max_storage_bytes"), F.lit(None).cast("long").alias("max_video_count"), F.lit(None).cast("long").alias("max_knowledge_base_count"))
    v = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("user_id"), F.floor("o_totalprice").cast("long").alias("file_size_bytes"))
    return R.user_usage(users, v, S.knowledge_bases(spark, d), 1_000_000, 12, 3)


def g14_user_quota_usage(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d)


_USAGE = with_ctes("videos", "knowledge_bases") + """, usage AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, CAST(coalesce(b, 0) AS BIGINT) AS used_bytes, coalesce(n, 0) AS used_videos, coalesce(k, 0) AS used_bases,
CAST(coalesce(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) * 200 END, 1000000) AS BIGINT) AS max_storage_bytes, CAST(12 AS BIGINT) AS max_video_count, CAST(3 AS BIGINT) AS max_knowledge_base_count FROM customer
LEFT JOIN (SELECT o_custkey, sum(floor(o_totalprice)) AS b, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id AS u, count(*) AS k FROM knowledge_bases GROUP BY 1) ON u = c_custkey) """
G14 = _USAGE + "SELECT * FROM usage"


def g15_quota_check(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("request_id"), F.col("o_custkey").cast("long").alias("user_id"), F.floor("o_totalprice").cast("long").alias("incoming_bytes"))
    return R.quota_check(_usage(spark, d), requests)


G15 = _USAGE + """SELECT request_id, user_id, reason IS NULL AS allowed, reason FROM (SELECT CAST(o_orderkey AS BIGINT) AS request_id, user_id, CASE WHEN used_videos + 1 > max_video_count THEN 'videos=' || used_videos || '/' || max_video_count
WHEN used_bytes + greatest(0, floor(o_totalprice)) > max_storage_bytes THEN 'storage=' || used_bytes || '/' || max_storage_bytes END AS reason FROM orders JOIN usage ON user_id = o_custkey)"""


def g16_dedupe_assets(spark: SparkSession, d: str) -> DataFrame:
    return R.dedupe_assets(S.videos(spark, d))


G16 = with_ctes("videos") + "SELECT video_id, user_id, min(video_id) OVER (PARTITION BY user_id, md5) AS asset_id, min(video_id) OVER (PARTITION BY user_id, md5) <> video_id AS deduplicated FROM videos"


def g17_upload_progress(spark: SparkSession, d: str) -> DataFrame:
    p = R.upsert_parts(S.parts(spark, d))
    totals = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("session_id"), (F.col("o_orderkey") % 7 + 1).cast("long").alias("total_parts"))
    out = R.upload_progress(p, totals)
    return out.select("session_id", "uploaded_bytes", F.array_join(F.transform("uploaded", lambda x: x.cast("string")), ",").alias("uploaded"), F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), "complete")


_PARTS = ", p AS (SELECT session_id, part_number, arg_max(size_bytes, written) AS size_bytes FROM parts GROUP BY ALL)"
G17 = with_ctes("parts") + _PARTS + """, t AS (SELECT CAST(o_orderkey AS BIGINT) AS session_id, CAST(o_orderkey % 7 + 1 AS BIGINT) AS total FROM orders), u AS (SELECT session_id, sum(size_bytes) AS b, list(DISTINCT part_number ORDER BY part_number) AS l FROM p GROUP BY 1),
m AS (SELECT session_id, CAST(coalesce(b, 0) AS BIGINT) AS uploaded_bytes, coalesce(l, []) AS l, list_filter(range(total), lambda i: NOT list_contains(coalesce(l, []), i)) AS m FROM t LEFT JOIN u USING (session_id))
SELECT session_id, uploaded_bytes, array_to_string(l, ',') AS uploaded, array_to_string(m, ',') AS missing, len(m) = 0 AS complete FROM m"""


def g18_validate_parts(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("session_id"), (F.col("o_orderkey") % 150 + 1).cast("long").alias("file_size"), F.lit(25).cast("long").alias("part_size"))
    return R.validate_parts(R.upsert_parts(S.parts(spark, d)), sessions)


G18 = with_ctes("parts") + _PARTS + """, s AS (SELECT CAST(o_orderkey AS BIGINT) AS session_id, o_orderkey % 150 + 1 AS file_size, CAST(ceil((o_orderkey % 150 + 1) / 25.0) AS BIGINT) AS total FROM orders)
SELECT session_id, part_number, CASE WHEN part_number < 0 OR part_number >= total THEN 'range' WHEN size_bytes <> CASE WHEN part_number = total - 1 THEN file_size - 25 * (total - 1) ELSE 25 END THEN 'size' ELSE 'ok' END AS verdict FROM p JOIN s USING (session_id)"""


def g19_reusable_session(spark: SparkSession, d: str) -> DataFrame:
    """The latest open order equal in customer, priority and ship priority, for each such key."""
    o = table(spark, d, "orders").where("o_orderstatus IN ('O', 'P')").select(F.col("o_custkey").cast("long").alias("user_id"), "o_orderpriority", F.col("o_orderkey").cast("long").alias("session_id"), "o_orderdate")
    return R.latest(o, ["user_id", "o_orderpriority"], ["o_orderdate", "session_id"]).select("user_id", "o_orderpriority", "session_id")


G19 = "SELECT CAST(o_custkey AS BIGINT) AS user_id, o_orderpriority, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS session_id FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL"


def g20_upsert_parts(spark: SparkSession, d: str) -> DataFrame:
    return R.upsert_parts(S.parts(spark, d))


G20 = with_ctes("parts") + "SELECT session_id, part_number, arg_max(size_bytes, written) AS size_bytes FROM parts GROUP BY ALL"


def g21_recent_messages(spark: SparkSession, d: str) -> DataFrame:
    return R.recent_messages(S.messages(spark, d), 3)


G21 = with_ctes("messages") + """, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY id DESC) AS rank FROM messages) WHERE rank <= 3)
SELECT video_id, id, role, last_question, rank FROM m LEFT JOIN (SELECT video_id, arg_max(content, id) AS last_question FROM m WHERE role = 'user' GROUP BY 1) USING (video_id)"""


def g22_summary_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = S.videos(spark, d)
    old = v.select("video_id", F.explode(F.array(F.lit("OUTLINE"), F.lit("POINTS"))).alias("type"), F.lit("local").alias("model"))
    new = v.where("video_id % 4 = 0").select("video_id", F.lit("POINTS").alias("type"), F.lit("cloud").alias("model"))
    absent = v.where("video_id % 5 = 0").select("video_id", F.explode(F.array(F.lit("POINTS"), F.lit("HOOKS"))).alias("type"), F.lit("late").alias("model"))
    return R.insert_if_absent(R.upsert(old, new, ["video_id", "type"]), absent, ["video_id", "type"])


G22 = with_ctes("videos") + """SELECT video_id, 'OUTLINE' AS type, 'local' AS model FROM videos UNION ALL SELECT video_id, 'POINTS', CASE WHEN video_id % 4 = 0 THEN 'cloud' ELSE 'local' END FROM videos
UNION ALL SELECT video_id, 'HOOKS', 'late' FROM videos WHERE video_id % 5 = 0"""


def g25_snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    versions = S.videos(spark, d).where("video_id % 2 = 0").select("video_id", (F.col("video_id") % 4 + 1).alias("version_no"))
    return R.snapshot_versions(S.segments(spark, d), versions).select("video_id", "version_no", "n_segments")


G25 = with_ctes("segments") + "SELECT video_id, CASE WHEN video_id % 2 = 0 THEN video_id % 4 + 2 ELSE 1 END AS version_no, count(*) AS n_segments FROM segments GROUP BY 1"


def g27_version_diff(spark: SparkSession, d: str) -> DataFrame:
    s = S.segments(spark, d)
    current = s.where("id % 11 <> 0").withColumn("content", F.when(F.col("id") % 5 == 0, F.upper("content")).otherwise(F.col("content")))
    rows = R.version_diff(s.select("video_id", "segment_index", "content"), current)
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("changed"), 1)).alias("changed_count"))


G27 = with_ctes("segments") + "SELECT video_id, count(*) AS n_rows, count(*) FILTER (WHERE id % 11 = 0 OR (id % 5 = 0 AND upper(content) <> content)) AS changed_count FROM segments GROUP BY 1"


def g28_restore_version(spark: SparkSession, d: str) -> DataFrame:
    """Videos of every third id put back to an earlier snapshot, whose texts end otherwise."""
    s = S.segments(spark, d).select("video_id", "segment_index", "content")
    snapshot = s.where("video_id % 3 = 0").withColumn("content", F.concat("content", F.lit(" (old)")))
    back = s.join(snapshot.select("video_id").distinct(), "video_id", "left_anti").unionByName(snapshot)
    return back.select("video_id", "segment_index", F.md5("content").alias("content_md5"))


G28 = with_ctes("segments") + "SELECT video_id, segment_index, md5(CASE WHEN video_id % 3 = 0 THEN content || ' (old)' ELSE content END) AS content_md5 FROM segments"


def g29_edit_segments(spark: SparkSession, d: str) -> DataFrame:
    s = S.segments(spark, d)
    edits = s.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat("content", F.lit(" (edited)"))).when(F.col("id") % 5 == 0, F.lit("  ")).otherwise(F.col("content")).alias("text"))
    return R.edit_segments(s, edits).select("id", "edited", F.md5("content").alias("content_md5"))


G29 = with_ctes("segments") + "SELECT id, id % 3 = 0 AND id % 2 = 0 AS edited, md5(CASE WHEN id % 6 = 0 THEN content || ' (edited)' ELSE content END) AS content_md5 FROM segments"


def g30_event_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.event_status_counts(table(spark, d, "events"), {"backlog": ["click", "view"], "in_flight": ["purchase"], "failed": ["error"]}, "event_type")


G30 = "SELECT count(*) FILTER (WHERE event_type IN ('click', 'view')) AS backlog, count(*) FILTER (WHERE event_type = 'purchase') AS in_flight, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events"


def g31_dispatchable(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 100 pending events that are due (a top-k report)."""
    e = table(spark, d, "events").where("event_type IN ('error', 'signup')")
    return e.where(F.col("value").isNull() | (F.col("value") < 50)).orderBy("ts", "event_id").limit(100).select("event_id", "user_id")


G31 = "SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'signup') AND (value IS NULL OR value < 50) ORDER BY ts, event_id LIMIT 100"


def g32_retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy((F.col("l_quantity").cast("long")).alias("attempts")).agg(F.count(F.lit(1)).alias("n")).select("attempts", "n", R.retry_delay(F.col("attempts")).alias("delay_s"))


G32 = "SELECT attempts, n, CAST(least(60, greatest(2, pow(2, least(6, attempts // 3)))) AS BIGINT) AS delay_s FROM (SELECT CAST(l_quantity AS BIGINT) AS attempts, count(*) AS n FROM lineitem GROUP BY 1)"


def g33_video_list(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per(S.videos(spark, d), ["user_id"], [F.desc("video_id")], 30).select("user_id", "video_id", "rank")


G33 = with_ctes("videos") + "SELECT * FROM (SELECT user_id, video_id, row_number() OVER (PARTITION BY user_id ORDER BY video_id DESC) AS rank FROM videos) WHERE rank <= 30"


def g34_tenant_scope(spark: SparkSession, d: str) -> DataFrame:
    return R.tenant_scope(S.segments(spark, d), S.videos(spark, d), 3).select("id", "video_id")


G34 = with_ctes("videos", "segments") + "SELECT id, video_id FROM segments WHERE video_id IN (SELECT video_id FROM videos WHERE user_id = 3)"


def g35_cache_scopes_to_evict(spark: SparkSession, d: str) -> DataFrame:
    return R.scopes_to_evict(S.videos(spark, d).where("video_id % 50 = 0").select("video_id"), S.kb_videos(spark, d))


G35 = with_ctes("videos", "kb_videos") + "SELECT 'video:' || video_id AS scope FROM videos WHERE video_id % 50 = 0 UNION SELECT 'kb:' || kb_id FROM kb_videos WHERE video_id % 50 = 0 UNION SELECT 'kb:default'"


def g36_soft_delete_users(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    users = c.select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_name").alias("email"), (F.col("c_custkey") % 9 == 0).alias("disabled"), F.when(F.col("c_custkey") % 9 == 0, F.lit("2024-01-01").cast("date")).alias("deleted_at"))
    return R.soft_delete_users(users, users.where("user_id % 3 = 0").select("user_id"), F.lit("2024-06-01").cast("date"))


G36 = """SELECT CAST(c_custkey AS BIGINT) AS user_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 9 <> 0 THEN 'deleted-' || c_custkey || '@invalid' ELSE c_name END AS email, c_custkey % 3 = 0 AS disabled,
CASE WHEN c_custkey % 9 = 0 THEN DATE '2024-01-01' WHEN c_custkey % 3 = 0 THEN DATE '2024-06-01' END AS deleted_at FROM customer"""

QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "g" and k[1].isdigit()}
ORACLES = {k: globals()[k.split("_")[0].upper() + ("_VIDEOS" if k.endswith("coverage_videos") else "")] for k in QUERIES}
