"""Queries of the exports and of text read from frames over the given tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.operators import documents as D
from vidweave.operators import exports as X
from vidweave.operators import quality as Q
from vidweave.operators import relational as R
from vidweave.sources import tables as S
from vidweave.sources.tables import table, with_ctes


def _usage(spark: SparkSession, d: str) -> DataFrame:
    users = S.videos(spark, d).select("user_id").distinct()
    none = [F.lit(None).cast("long").alias(c) for c in ("max_storage_bytes", "max_video_count", "max_knowledge_base_count")]
    return R.user_usage(users.select("user_id", *none), S.videos(spark, d), S.knowledge_bases(spark, d), 10**9, 1000, 50)


def a10_tenant_export(spark: SparkSession, d: str) -> DataFrame:
    """All users' own data in chunks of 500 rows: the hash of each chunk's JSON. Most jobs and talks have no owner."""
    v = S.videos(spark, d)
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org"))
    supplier = table(spark, d, "supplier").select((F.col("s_suppkey") % 25).cast("long").alias("user_id"), F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("provider_name"), F.concat(F.lit("sk-"), F.col("s_name")).alias("api_key"), (F.col("s_suppkey") % 2 == 0).alias("enabled"))
    tables = {
        "user": v.select("user_id").distinct().select("user_id", F.col("user_id").alias("id"), name.alias("email")),
        "quota": _usage(spark, d),
        "videos": v.withColumnRenamed("video_id", "id"),
        "jobs": S.jobs(spark, d).withColumnRenamed("job_id", "id"),
        "transcripts": S.segments(spark, d),
        "summaries": v.select("video_id", F.lit("CORE_POINTS").alias("type"), F.col("original_name").alias("title")),
        "knowledgeBases": S.knowledge_bases(spark, d).withColumnRenamed("kb_id", "id"),
        "chatMessages": S.messages(spark, d),
        "providers.llm": supplier,
    }
    out = X.tenant_export(tables, chunk_rows=500)
    return out.select("user_id", "part", "chunk", "n_rows", F.md5("body").alias("body_md5"))


def _part(name: str, source: str, order: str, *fields: tuple[str, str]) -> str:
    """A part's rows in SQL: fields are (name, expression of the JSON value)."""
    body = " || ',' || ".join(f"'\"{n}\":' || coalesce({e}, 'null')" for n, e in fields)
    return f"SELECT user_id, '{name}' AS part, {order}, '{{' || {body} || '}}' AS body FROM {source}"


_text = lambda c: f"CAST(to_json({c}) AS VARCHAR)"
_num = lambda c: f"CAST({c} AS VARCHAR)"
_fields = lambda nums, texts=(): [*[(c, _num(c)) for c in nums], *[(c, _text(c)) for c in texts]]
_OWNED = "(SELECT user_id AS owner, video_id AS vid FROM videos) o"
A10 = (
    with_ctes("videos", "segments", "knowledge_bases", "jobs", "messages")
    + ", us AS (SELECT user_id, used_bytes, used_videos, coalesce(b, 0) AS used_bases FROM (SELECT user_id, sum(file_size_bytes) AS used_bytes, count(*) AS used_videos FROM videos GROUP BY 1) LEFT JOIN (SELECT user_id, count(*) AS b FROM knowledge_bases GROUP BY 1) USING (user_id)), r AS ("
    + " UNION ALL ".join(
        [
            _part("user", "(SELECT DISTINCT user_id FROM videos)", "user_id AS o1, 0 AS o2", ("id", _num("user_id")), ("email", _text("'u' || user_id || '@example.org'"))),
            _part("quota", "us", "user_id AS o1, 0 AS o2", *_fields(["used_bytes", "used_videos", "used_bases"]), ("max_storage_bytes", "'1000000000'"), ("max_video_count", "'1000'"), ("max_knowledge_base_count", "'50'")),
            _part("videos", "videos", "video_id AS o1, 0 AS o2", ("id", _num("video_id")), ("md5", _text("md5")), ("original_name", _text("original_name")), ("file_size_bytes", _num("file_size_bytes")), ("duration_ms", _num("duration_ms")), ("status", _text("status"))),
            _part("jobs", f"(SELECT owner AS user_id, j.job_id, j.video_id, j.status, strftime(j.created_at, '%Y-%m-%dT%H:%M:%S.000') AS created_at FROM jobs j JOIN {_OWNED} ON vid = video_id)", "job_id AS o1, 0 AS o2", ("id", _num("job_id")), ("video_id", _num("video_id")), ("status", _text("status")), ("created_at", _text("created_at"))),
            _part("transcripts", f"(SELECT owner AS user_id, s.* FROM segments s JOIN {_OWNED} ON vid = video_id)", "video_id AS o1, segment_index AS o2", *_fields(["video_id", "segment_index", "start_ms", "end_ms"], ["content"])),
            _part("summaries", "videos", "video_id AS o1, 0 AS o2", ("video_id", _num("video_id")), ("type", _text("'CORE_POINTS'")), ("title", _text("original_name"))),
            _part("knowledgeBases", "knowledge_bases", "kb_id AS o1, 0 AS o2", ("id", _num("kb_id"))),
            _part("chatMessages", f"(SELECT owner AS user_id, m.* FROM messages m JOIN {_OWNED} ON vid = video_id)", "id AS o1, 0 AS o2", ("video_id", _num("video_id")), ("role", _text("role")), ("content", _text("content"))),
            _part("providers.llm", "(SELECT s_suppkey % 25 AS user_id, s_suppkey AS id, s_name AS provider_name, '****' || right(s_name, 4) AS api_key_masked, s_suppkey % 2 = 0 AS enabled FROM supplier)", "id AS o1, 0 AS o2", ("id", _num("id")), ("provider_name", _text("provider_name")), ("api_key_masked", _text("api_key_masked")), ("enabled", _num("enabled"))),
        ]
    )
    + "), n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, part ORDER BY o1, o2, body) - 1) // 500 AS chunk FROM r)"
    + " SELECT CAST(user_id AS BIGINT) AS user_id, part, chunk, count(*) AS n_rows, md5('[' || string_agg(body, ',' ORDER BY o1, o2, body) || ']') AS body_md5 FROM n GROUP BY 1, 2, 3"
)

_TYPES = ["CORE_POINTS", "MEETING_MINUTES", "BLOG_OUTLINE", "PPT_OUTLINE"]


def g24_local_document(spark: SparkSession, d: str) -> DataFrame:
    """A document for each video, of a type by its number; every third video has an outline, some of them empty."""
    v = S.videos(spark, d)
    kind = F.get(F.array(*map(F.lit, _TYPES)), (F.col("video_id") % 4).cast("int"))
    requests = v.select("video_id", "original_name", kind.alias("type"))
    points = F.when(F.col("video_id") % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat("original_name", F.lit(" point "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    outlines = requests.where("video_id % 3 = 0").select("video_id", "type", F.to_json(F.struct(points.alias("points"))).alias("content_json"))
    doc = X.local_documents(requests, S.segments(spark, d), outlines)
    text = D.render_markdown(F.col("title"), F.col("subtitle"), F.col("summary"), F.col("sections"), F.col("notes"), actions=F.col("actions"))
    return doc.select("video_id", "title", F.size("sections").cast("long").alias("n_sections"), F.size("notes").cast("long").alias("n_notes"), F.length("summary").cast("long").alias("summary_chars"), F.md5(text).alias("markdown_md5"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NL = "chr(10)"
_bullets = lambda xs: " || ".join(f"'- ' || {x} || {_NL}" for x in xs) + f" || {_NL}"
_head = lambda h: f"'## ' || {h} || {_NL} || {_NL}"
_squeeze = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_cut = lambda x, n: f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"
_time = lambda c: f"printf('%02d:%02d', {c} // 60000, {c} // 1000 % 60)"
G24 = with_ctes("videos", "segments") + f""", sr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY segment_index, id) AS r, {_squeeze.format('content')} AS x FROM segments),
fi AS (SELECT video_id, list(content ORDER BY r) FILTER (WHERE r <= 8) AS first, list('[' || {_time('start_ms')} || '-' || {_time('end_ms')} || '] ' || {_cut('x', 180)} ORDER BY r) FILTER (WHERE r <= 10) AS notes FROM sr GROUP BY 1),
so AS (SELECT video_id, original_name, notes, CASE video_id % 4 WHEN 1 THEN '详细会议纪要' WHEN 2 THEN '结构化长文博客' WHEN 3 THEN '演示汇报稿' ELSE '核心观点报告' END AS label,
CASE WHEN video_id % 6 = 0 THEN list_transform(range(1, 8), lambda i: original_name || ' point ' || i) ELSE first END AS source FROM videos LEFT JOIN fi USING (video_id)),
su AS (SELECT *, {_squeeze.format(_q(X.SUMMARY[0]) + " || array_to_string(source[1:5], '；') || " + _q(X.SUMMARY[1]))} AS s0 FROM so WHERE len(source) > 0), sm AS (SELECT *, {_cut('s0', 480)} AS summary FROM su)
SELECT video_id, original_name || ' - ' || label AS title, 2 + least(6, len(source)) AS n_sections, coalesce(len(notes), 0) AS n_notes, length(summary) AS summary_chars,
md5('# ' || original_name || ' - ' || label || {_NL} || {_NL} || '> ' || {_q(X.SUBTITLE)} || {_NL} || {_NL} || {_head(_q('执行摘要'))} || summary || {_NL} || {_NL}
|| {_head(_q(X.AIM_HEADING))} || {_bullets([_q(X.AIM[0]) + ' || original_name || ' + _q(X.AIM[1]), _q(X.AIM[2]) + ' || label || ' + _q(X.AIM[3]), _q(X.AIM[4])])}
|| array_to_string(list_transform(range(1, least(6, len(source)) + 1), lambda i: {_head(_q(X.KEY_HEADING) + ' || i')} || {_bullets(['source[i]', _q(X.KEY[0]), _q(X.KEY[1])])}), '')
|| {_head(_q(X.END_HEADING))} || {_bullets(map(_q, X.END))} || {_head(_q('行动项'))} || {_bullets(map(_q, X.ACTIONS))}
|| CASE WHEN len(notes) > 0 THEN {_head(_q('来源片段'))} || array_to_string(list_transform(notes, lambda n: '- ' || n || {_NL}), '') || {_NL} ELSE '' END) AS markdown_md5 FROM sm"""


def f6_select_subtitle_line(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as boxes read from frames: an order is a video, its frames are seen three boxes at a time."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.max_by(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "p_name"), order).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    words = F.when(k % 5 == 0, F.concat(F.lit(" ·"), (k * 7).cast("string"), F.lit(" K%"))).when(k % 7 == 0, F.concat(F.lit("字幕 "), "p_name")).when(k % 11 == 0, F.repeat("p_name", F.lit(12))).when(k % 13 == 0, "|x_").otherwise(F.concat(F.lit("_"), "p_name", F.lit("- ")))
    x, y = F.col("l_suppkey") % 100 * 10.0, F.col("l_quantity") * 10 + 40
    point = lambda dx, dy: F.array(x + dx, y + dy)
    boxes = li.select(F.col("l_orderkey").cast("long").alias("video_id"), F.lit(0).cast("long").alias("segment_index"), F.floor((n - 1) / 3).alias("attempt"), ((n - 1) % 3).cast("long").alias("position"), F.lit(1000).alias("width"), F.lit(600).alias("height"), F.array(point(0, 0), point(40, 0), point(40, 20), point(0, 20)).alias("box"), words.alias("text"), (0.85 + F.col("l_discount")).alias("score"))
    best = Q.select_subtitle_line(boxes)
    return best.select("video_id", "attempt", F.md5("text").alias("text_md5"), F.round("score", 4).alias("score"), "center_y", "center_x")


F6 = """WITH m AS (SELECT l_orderkey, l_linenumber AS n, arg_max({'k': l_partkey, 's': l_suppkey, 'q': l_quantity, 'd': l_discount, 'p': p_name}, (l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)) AS v
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), w AS (SELECT l_orderkey AS video_id, (n - 1) // 3 AS attempt, (n - 1) % 3 AS position, (v.s % 100 * 10.0 + 20) / 1000 AS x, (v.q * 10 + 50) / 600 AS y, 0.85 + v.d AS score,
CASE WHEN v.k % 5 = 0 THEN (v.k * 7) || 'K%' WHEN v.k % 7 = 0 THEN '字幕' || replace(v.p, ' ', '') WHEN v.k % 11 = 0 THEN replace(repeat(v.p, 12), ' ', '') WHEN v.k % 13 = 0 THEN 'x' ELSE replace(v.p, ' ', '') END AS t FROM m),
g AS (SELECT *, regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') AS cjk FROM (SELECT *, trim(t, '·•|_=- ') AS t2 FROM w) WHERE score >= 0.88 AND length(t) BETWEEN 2 AND 90 AND len(regexp_extract_all(t, '[\\p{Nd}.,:/%Kk]')) / length(t) < 0.78 AND y >= 0.52 AND x BETWEEN 0.14 AND 0.86),
f AS (SELECT video_id, attempt, arg_max({'t': t, 's': score, 'y': round(y, 4), 'x': round(x, 4)}, (score + CASE WHEN cjk THEN 1.2 ELSE 0 END + y - least(length(t), 90) / 260, -position)) AS l FROM g GROUP BY 1, 2),
b AS (SELECT video_id, arg_max({'l': l, 'a': attempt}, (l.s + l.y, -attempt)) AS z FROM f GROUP BY 1)
SELECT video_id, CAST(z.a AS BIGINT) AS attempt, md5(z.l.t) AS text_md5, round(z.l.s, 4) AS score, z.l.y AS center_y, z.l.x AS center_x FROM b""".replace("\\\\", "\\")

QUERIES = {f.__name__: f for f in (a10_tenant_export, g24_local_document, f6_select_subtitle_line)}
ORACLES = {"a10_tenant_export": A10, "g24_local_document": G24, "f6_select_subtitle_line": F6}
