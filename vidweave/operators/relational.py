"""Joins, aggregates and keyed updates over the tables of users, videos, bases, jobs, uploads and versions.

Every function works on whole tables and takes the key that a single request would name as a column. Windows
end with a unique key, so ties have one order. Times ("now") are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(name) <= n)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns. max_by aggregates partially, so a hot key is no skew."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(row).select("row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in by key; new must be unique by key."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(keys), keys, "left_anti"))


def kb_list(bases: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy("kb_id").agg(F.count("video_id").alias("n"))
    return bases.join(counts, "kb_id", "left").select("kb_id", "user_id", F.coalesce("n", F.lit(0)).cast("long").alias("video_count"))


def kb_videos(bases: DataFrame, links: DataFrame, videos: DataFrame) -> DataFrame:
    """Links whose base and video have one owner."""
    return links.join(bases, "kb_id").join(videos.select("video_id", F.col("user_id").alias("_owner")), "video_id").where("user_id = _owner").select("kb_id", "video_id", "user_id")


def kb_add_videos(bases: DataFrame, links: DataFrame, videos: DataFrame, requests: DataFrame) -> DataFrame:
    """New links of requests (user_id, kb_id, video_id) whose base and video belong to the user."""
    ok = requests.join(bases, ["user_id", "kb_id"], "left_semi").join(videos, ["user_id", "video_id"], "left_semi")
    return ok.select("kb_id", "video_id").distinct().join(links, ["kb_id", "video_id"], "left_anti")


def kb_delete(bases: DataFrame, links: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bases and links after deletion of requests (user_id, kb_id) by their owners."""
    gone = bases.join(requests, ["user_id", "kb_id"], "left_semi").select("kb_id")
    return bases.join(gone, "kb_id", "left_anti"), links.join(gone, "kb_id", "left_anti")


def video_coverage(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("transcript_count"), F.min_by("start_ms", "segment_index").alias("first_start_ms"), F.max_by("end_ms", "segment_index").alias("last_end_ms"))


def kb_coverage_videos(links: DataFrame, videos: DataFrame, segments: DataFrame) -> DataFrame:
    """The videos of each base with their own duration and what their segments cover (0 without any); segments are
    reduced to a row a video before the links multiply them."""
    per_video = videos.select("video_id", "original_name", "status", "duration_ms").join(video_coverage(segments), "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return links.select("kb_id", "video_id").join(per_video, "video_id").select("kb_id", "video_id", "original_name", "status", "duration_ms", zero("transcript_count"), zero("first_start_ms"), zero("last_end_ms"))


def kb_coverage(rows: DataFrame) -> DataFrame:
    """Totals of each base, from kb_coverage_videos: duration_ms is the sum of the videos' own durations."""
    g = rows.groupBy("kb_id").agg(F.count(F.lit(1)).alias("videos"), F.count(F.when(F.col("status") == "READY", 1)).alias("ready"), F.sum("transcript_count").alias("segments"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))
    return g.withColumn("summary", F.format_string("%d videos, %d ready, %d transcript segments", "videos", "ready", "segments"))


def recovery_queue(jobs: DataFrame, n: int = 20) -> DataFrame:
    """Failed jobs that are the latest of their video, newest first, at most n a user."""
    last = latest(jobs, ["video_id"], ["created_at", "job_id"]).where("status = 'FAILED'")
    return top_per(last, ["user_id"], [F.desc("created_at"), F.desc("job_id")], n)


def user_usage(users: DataFrame, videos: DataFrame, bases: DataFrame, max_bytes: int, max_videos: int, max_bases: int) -> DataFrame:
    """users (user_id, and limits that may be null) with what they use."""
    v = videos.groupBy("user_id").agg(F.sum("file_size_bytes").alias("used_bytes"), F.count(F.lit(1)).alias("used_videos"))
    b = bases.groupBy("user_id").agg(F.count(F.lit(1)).alias("used_bases"))
    out = users.join(v, "user_id", "left").join(b, "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    limit = lambda c, default: F.coalesce(F.col(c), F.lit(default)).cast("long").alias(c)
    return out.select("user_id", zero("used_bytes"), zero("used_videos"), zero("used_bases"), limit("max_storage_bytes", max_bytes), limit("max_video_count", max_videos), limit("max_knowledge_base_count", max_bases))


def quota_check(usage: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdict of each request (request_id, user_id, incoming_bytes) against current usage, independently."""
    r = requests.join(usage, "user_id")
    over_count = F.col("used_videos") + 1 > F.col("max_video_count")
    over_bytes = F.col("used_bytes") + F.greatest(F.lit(0), "incoming_bytes") > F.col("max_storage_bytes")
    reason = F.when(over_count, F.format_string("videos=%d/%d", "used_videos", "max_video_count")).when(over_bytes, F.format_string("storage=%d/%d", "used_bytes", "max_storage_bytes"))
    return r.select("request_id", "user_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def dedupe_assets(videos: DataFrame) -> DataFrame:
    """The asset that stands for each upload: the first of its user and content. A min aggregate and a join,
    so that one content uploaded by a third of all rows does not meet in one task."""
    first = videos.groupBy("user_id", F.lower("md5").alias("_md5")).agg(F.min("video_id").alias("asset_id"))
    out = videos.join(first.withColumnRenamed("user_id", "_user"), (F.col("user_id") == F.col("_user")) & (F.lower("md5") == F.col("_md5")))
    return out.select("video_id", "user_id", "asset_id", (F.col("asset_id") != F.col("video_id")).alias("deduplicated"))


def upsert_parts(parts: DataFrame) -> DataFrame:
    """The last write of each (session, part)."""
    return parts.groupBy("session_id", "part_number").agg(F.max_by("size_bytes", "written").alias("size_bytes"))


def upload_progress(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """totals (session_id, total_parts): bytes, parts there and parts missing of each session."""
    p = parts.groupBy("session_id").agg(F.sum("size_bytes").alias("uploaded_bytes"), F.array_sort(F.collect_set("part_number")).alias("uploaded"))
    out = totals.join(p, "session_id", "left").withColumn("uploaded", F.coalesce("uploaded", F.array().cast("array<bigint>")))
    whole = F.sequence(F.lit(0).cast("long"), F.col("total_parts") - 1)
    return out.withColumn("missing", F.array_sort(F.array_except(whole, "uploaded"))).withColumn("complete", F.size("missing") == 0).withColumn("uploaded_bytes", F.coalesce("uploaded_bytes", F.lit(0)).cast("long"))


def part_plan(file_size: Column, part_size: Column) -> Column:
    return F.ceil(file_size / part_size).cast("long")


def validate_parts(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """ok, or why not, of each part; sessions: session_id, file_size, part_size."""
    p = parts.join(sessions, "session_id").withColumn("total", part_plan(F.col("file_size"), F.col("part_size")))
    expected = F.when(F.col("part_number") == F.col("total") - 1, F.col("file_size") - F.col("part_size") * (F.col("total") - 1)).otherwise(F.col("part_size"))
    verdict = F.when((F.col("part_number") < 0) | (F.col("part_number") >= F.col("total")), "range").when(F.col("size_bytes") != expected, "size").otherwise("ok")
    return p.select("session_id", "part_number", verdict.alias("verdict"))


def recent_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each video in order, and the last user question among them."""
    m = top_per(messages, ["video_id"], [F.desc("id")], n)
    asked = m.where("role = 'user'").groupBy("video_id").agg(F.max_by("content", "id").alias("last_question"))
    return m.join(asked, "video_id", "left").select("video_id", "id", "role", "last_question", "rank")


def event_status_counts(events: DataFrame, groups: dict[str, list[str]], status: str = "status") -> DataFrame:
    return events.agg(*[F.count(F.when(F.col(status).isin(of), 1)).alias(name) for name, of in groups.items()])


def retry_delay(attempts: Column) -> Column:
    """Seconds: 2 ** (attempts // 3), the exponent at most 6, between 2 and 60."""
    return F.least(F.lit(60), F.greatest(F.lit(2), F.pow(F.lit(2), F.least(F.lit(6), F.floor(attempts / 3))))).cast("long")


def tenant_scope(df: DataFrame, videos: DataFrame, user_id: int) -> DataFrame:
    return df.join(videos.where(F.col("user_id") == user_id).select("video_id"), "video_id", "left_semi")


def scopes_to_evict(changed: DataFrame, links: DataFrame) -> DataFrame:
    """Cache scopes of changed videos: the video, the default base, and every base that holds it."""
    own = changed.select(F.concat(F.lit("video:"), F.col("video_id").cast("string")).alias("scope"))
    held = links.join(changed, "video_id", "left_semi").select(F.concat(F.lit("kb:"), F.col("kb_id").cast("string")).alias("scope"))
    default = changed.select(F.lit("kb:default").alias("scope")).distinct()
    return own.union(held).union(default).distinct()


def soft_delete_users(users: DataFrame, chosen: DataFrame, as_of: Column) -> DataFrame:
    """users (user_id, email, disabled, deleted_at) after the deletion of chosen (user_id)."""
    hit = users.join(chosen.select("user_id", F.lit(True).alias("_hit")).distinct(), "user_id", "left")
    now = F.col("_hit").isNotNull() & F.col("deleted_at").isNull()
    email = F.concat(F.lit("deleted-"), F.col("user_id").cast("string"), F.lit("@invalid"))
    return hit.select("user_id", F.when(now, email).otherwise(F.col("email")).alias("email"), (F.col("disabled") | now).alias("disabled"), F.when(now, as_of).otherwise(F.col("deleted_at")).alias("deleted_at"))


def provider_activate(providers: DataFrame, requests: DataFrame) -> DataFrame:
    """Of users with a request (user_id, id), the chosen provider on and enabled, all others off."""
    r = requests.select("user_id", F.col("id").alias("_chosen"))
    p = providers.join(r, "user_id", "left")
    chosen = F.col("id") == F.col("_chosen")
    return p.select("user_id", "id", F.when(F.col("_chosen").isNull(), F.col("active")).otherwise(chosen).alias("active"), F.when(chosen, True).otherwise(F.col("enabled")).alias("enabled"))


def snapshot_versions(segments: DataFrame, versions: DataFrame) -> DataFrame:
    """A new version of each video: its number and its segments as JSON. A snapshot is one row by contract, so
    its size is that of one video."""
    item = F.struct("segment_index", "start_ms", "end_ms", "content")
    snap = segments.groupBy("video_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("snapshot_json"), F.count(F.lit(1)).alias("n_segments"))
    last = versions.groupBy("video_id").agg(F.max("version_no").alias("_last"))
    return snap.join(last, "video_id", "left").select("video_id", (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("version_no"), "n_segments", "snapshot_json")


def version_diff(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of snapshot (video_id, segment_index, content) against current ones, missing ones as empty."""
    now = current.select("video_id", "segment_index", F.col("content").alias("now"))
    out = snapshot.join(now, ["video_id", "segment_index"], "left").withColumn("now", F.coalesce("now", F.lit("")))
    return out.withColumn("changed", F.col("content") != F.col("now"))


def edit_segments(segments: DataFrame, edits: DataFrame, clean=lambda c: c) -> DataFrame:
    """segments after edits (id, text): blank and unchanged ones are passed over."""
    e = edits.select("id", clean(F.col("text")).alias("_text"))
    out = segments.join(e, "id", "left")
    hit = F.col("_text").isNotNull() & (F.trim("_text") != "") & (F.col("_text") != F.col("content"))
    return out.select("id", "video_id", "segment_index", F.when(hit, F.col("_text")).otherwise(F.col("content")).alias("content"), F.coalesce(hit, F.lit(False)).alias("edited"))


def kb_links(bases: DataFrame, links: DataFrame) -> DataFrame:
    """The links of each base under the base's owner, whoever owns the video."""
    return links.join(bases.select("kb_id", "user_id"), "kb_id").select("user_id", "kb_id", "video_id")


def kb_ids_by_video(bases: DataFrame, links: DataFrame) -> DataFrame:
    """The ascending ids of each owner's bases that hold a video. The quota bounds the bases of an owner, so the list."""
    ids = F.array_sort(F.collect_set("kb_id")).alias("kb_ids")
    return kb_links(bases, links).groupBy("user_id", "video_id").agg(ids)


def task_list(jobs: DataFrame, videos: DataFrame, users: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest jobs (job_id, video_id, status, updated_at) with their video's name and its owner's address, of one
    status or (blank, ALL) of any; 1 to 200 of them."""
    wanted = (status or "").strip().upper()
    j = jobs if wanted in ("", "ALL") else jobs.where(F.col("status") == wanted)
    out = j.join(videos.select("video_id", "user_id", "original_name"), "video_id").join(users.select("user_id", F.col("email").alias("user_email")), "user_id")
    return out.select("job_id", "video_id", "user_id", "user_email", "original_name", "status", "updated_at").orderBy(F.desc("updated_at"), F.desc("job_id")).limit(max(1, min(limit, 200)))


def resource_usage(users: DataFrame, videos: DataFrame, bases: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of totals. users: user_id, disabled, deleted_at; active ones are neither disabled nor deleted."""
    n = lambda when=None: F.count(F.lit(1) if when is None else F.when(when, 1))
    parts = [
        users.agg(n().alias("users"), n(~F.col("disabled") & F.col("deleted_at").isNull()).alias("active_users")),
        videos.agg(n().alias("videos"), F.sum("file_size_bytes").alias("storage_bytes")),
        bases.agg(n().alias("bases")),
        jobs.agg(n(F.col("status") == "FAILED").alias("failed"), n(F.col("status") == "RUNNING").alias("running")),
    ]
    names = [c for p in parts for c in p.columns]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])


#: The least and the most bytes of a part, the most parts, the statuses of an open session.
LEAST_PART, MOST_PART, MOST_PARTS = 262144, 67108864, 100000
OPEN_STATUSES = ["UPLOADING", "COMPLETING"]


def plan_sessions(requests: DataFrame, least_part: int = LEAST_PART, most_part: int = MOST_PART, most_parts: int = MOST_PARTS) -> DataFrame:
    """requests (session_id, file_md5, file_size, part_size, requested_parts) with total_parts and a verdict: ok, or the
    first of md5, file_size, part_size, part_count and total_parts that is wrong. requested_parts may be null or 0; any
    other null is wrong. Without ok there are no total_parts."""
    total = part_plan(F.col("file_size"), F.col("part_size"))
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    wrong = F.when(no(F.lower(F.trim("file_md5")).rlike("^[a-f0-9]{32}$")), "md5").when(no(F.col("file_size") > 0), "file_size").when(no(F.col("part_size").between(least_part, most_part)), "part_size")
    wrong = wrong.when(no(total.between(1, most_parts)), "part_count").when((F.col("requested_parts") > 0) & (F.col("requested_parts") != total), "total_parts").otherwise("ok")
    return requests.withColumn("verdict", wrong).withColumn("total_parts", F.when(F.col("verdict") == "ok", total))


def check_parts(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """The verdict of each part (session_id, part_number, size_bytes, md5, expected_md5) of a session (session_id,
    status, file_size, part_size, total_parts): ok, or the first of status, range, empty, size and md5 that is wrong. A
    blank or null expected_md5 is not compared."""
    p = parts.join(sessions.select("session_id", "status", "file_size", "part_size", "total_parts"), "session_id")
    last = F.col("part_number") == F.col("total_parts") - 1
    expected = F.when(last, F.col("file_size") - F.col("part_size") * (F.col("total_parts") - 1)).otherwise(F.col("part_size"))
    asked = F.lower(F.trim(F.coalesce("expected_md5", F.lit(""))))
    wrong = F.when(F.col("status") != "UPLOADING", "status").when(~F.coalesce(F.col("part_number").between(0, F.col("total_parts") - 1), F.lit(False)), "range").when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty")
    wrong = wrong.when(F.col("size_bytes") != expected, "size").when((asked != "") & ~asked.eqNullSafe(F.lower("md5")), "md5").otherwise("ok")
    return p.select("session_id", "part_number", wrong.alias("verdict"))


SESSION_KEYS = ["user_id", "file_md5", "file_name", "file_size", "part_size", "total_parts"]


def reusable_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests (request_id and SESSION_KEYS) with the open session of the same keys that was updated last."""
    usable = sessions.where(F.col("status").isin(OPEN_STATUSES)).groupBy(*SESSION_KEYS).agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"))
    return requests.join(usable, SESSION_KEYS).select("request_id", "session_id")


def event_list(events: DataFrame, videos: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Of each owner the newest events (event_id, video_id, status, updated_at), of one status or of any (blank), 1 to
    100 of them, with their rank. Spark cuts to the limit before it shuffles."""
    wanted = (status or "").strip().upper()
    e = events if not wanted else events.where(F.col("status") == wanted)
    owned = e.join(videos.select("video_id", "user_id"), "video_id")
    return top_per(owned, ["user_id"], [F.desc("updated_at"), F.desc("event_id")], max(1, min(limit, 100)))


def user_list(users: DataFrame, limit: int = 50) -> DataFrame:
    """The newest users (user_id, created_at), 1 to 200 of them."""
    return users.orderBy(F.desc("created_at"), F.desc("user_id")).limit(max(1, min(limit, 200)))
