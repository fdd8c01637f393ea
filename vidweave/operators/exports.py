"""What leaves the tables as documents: a tenant's data in chunks, and local export documents of videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidweave.functions import text as T

from .documents import summary_items
from .relational import top_per
from .scans import Scan, prefix_scan

#: The parts of a tenant's export, the columns of each, and the two that order it.
EXPORT_PARTS: dict[str, tuple[list[str], tuple[str, str | None]]] = {
    "user": (["id", "email", "nickname", "email_verified", "created_at"], ("id", None)),
    "quota": (["used_bytes", "used_videos", "used_bases", "max_storage_bytes", "max_video_count", "max_knowledge_base_count"], ("user_id", None)),
    "videos": (["id", "md5", "original_name", "file_size_bytes", "duration_ms", "status", "created_at", "updated_at"], ("id", None)),
    "jobs": (["id", "video_id", "current_step", "status", "progress", "retry_count", "error_message", "created_at", "updated_at"], ("id", None)),
    "transcripts": (["video_id", "segment_index", "start_ms", "end_ms", "speaker", "content"], ("video_id", "segment_index")),
    "summaries": (["video_id", "type", "title", "model_name", "prompt_version", "created_at"], ("video_id", "type")),
    "knowledgeBases": (["id", "name", "description", "created_at", "updated_at"], ("id", None)),
    "chatMessages": (["video_id", "role", "content", "citation", "created_at"], ("id", None)),
    "providers": (["id", "provider_name", "base_url", "model", "api_key_masked", "enabled", "active", "last_test_status", "updated_at"], ("id", None)),
}
#: Parts that belong to a user by their video.
BY_VIDEO = ("jobs", "transcripts", "summaries", "chatMessages")


def tenant_export(tables: dict[str, DataFrame], chunk_rows: int = 1000, width: int = 1000) -> DataFrame:
    """(user_id, part, chunk, n_rows, body): each user's own rows of every part as JSON arrays, in order, cut into
    chunks of chunk_rows.

    tables: by part; "providers.<kind>" for each kind of provider, whose column api_key never leaves (its last four
    characters do). Parts by video need no user_id: they take their video's, and rows of videos that nobody owns are
    left out, as are rows without an owner. Of a part's columns those that its table has are written; a null is
    written as such. A user's rows are numbered by a blocked scan over ranges of `width` of the first order column, so
    a user that owns most rows is dealt over many tasks."""
    owners = tables["videos"].select(F.col("id").alias("_video"), F.col("user_id").alias("_owner")).where("_owner IS NOT NULL")
    rows = None
    for name, df in tables.items():
        part = name.split(".")[0]
        columns, (first, second) = EXPORT_PARTS[part]
        if part in BY_VIDEO:
            df = df.drop("user_id").join(owners, F.col("video_id") == F.col("_video")).withColumnRenamed("_owner", "user_id")
        if part == "providers" and "api_key" in df.columns:
            df = df.withColumn("api_key_masked", T.mask_secret(F.col("api_key")))
        body = F.to_json(F.struct(*[c for c in columns if c in df.columns]), {"ignoreNullFields": "false"})
        text = F.col(second).cast("string") if second else F.lit("")
        number = F.col(second).try_cast("long") if second else F.lit(0)
        cut = df.where("user_id IS NOT NULL").select(F.col("user_id").cast("long").alias("user_id"), F.lit(name).alias("part"), F.col(first).cast("long").alias("_o1"), F.coalesce(number, F.lit(0)).cast("long").alias("_o2"), text.alias("_o3"), body.alias("_body"))
        rows = cut if rows is None else rows.unionByName(cut)
    keyed = rows.withColumn("_tenant", F.concat_ws("|", F.col("user_id").cast("string"), "part"))
    order = ["_o1", "_o2", "_o3", "_body"]
    placed = prefix_scan(keyed, "_tenant", F.col("_o1"), width, order, [Scan("_n", "sum", F.lit(1))])
    chunk = F.floor(F.coalesce("_n", F.lit(0)) / chunk_rows)
    g = placed.groupBy("user_id", "part", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_l"))
    return g.select("user_id", "part", "chunk", F.size("_l").cast("long").alias("n_rows"), F.concat(F.lit("["), F.array_join("_l._body", ","), F.lit("]")).alias("body"))


def write_export(export: DataFrame, path: str, exported_at: Column) -> None:
    """The chunks as JSON lines in a folder for each user, with the time of the export."""
    export.withColumn("exported_at", exported_at).write.partitionBy("user_id").mode("overwrite").json(path)


#: The words of a local export document.
TYPE_LABELS = {"MEETING_MINUTES": "详细会议纪要", "BLOG_OUTLINE": "结构化长文博客", "PPT_OUTLINE": "演示汇报稿"}
OTHER_LABEL = "核心观点报告"
SUBTITLE = "基于时间轴字幕生成"
AIM_HEADING, KEY_HEADING, END_HEADING = "目标与背景", "关键内容 ", "结论与建议"
AIM = ("本文件根据视频《", "》的时间轴字幕自动整理。", "导出目标为", "，重点保留可追溯事实和后续行动。", "云端模型不可用时，本地生成器不会扩写字幕外事实。")
KEY = ("该内容来自当前视频已有字幕或结构化大纲。", "建议结合来源时间戳复核语境后再用于正式决策。")
END = ("优先复核高价值片段，并将确认后的结论沉淀到知识库。", "对视频未明确说明的责任人、截止时间和量化指标，需要会后补充确认。", "字幕人工修订后可重新导出，以获得更准确的交付文件。")
ACTIONS = ("复核引用片段与关键结论是否一致。", "补充视频未明确说明的责任人和截止时间。", "将确认后的结论同步到团队知识库。")
SUMMARY = ("本文件围绕视频中的主要观点、关键证据和后续行动进行结构化整理。核心内容包括：", "。正式使用前建议结合时间戳来源复核，并补充视频未明确说明的信息。")


def type_label(kind: Column) -> Column:
    out = F.lit(OTHER_LABEL)
    for name, label in TYPE_LABELS.items():
        out = F.when(kind == name, label).otherwise(out)
    return out


def local_documents(requests: DataFrame, segments: DataFrame, outlines: DataFrame) -> DataFrame:
    """An export document for each request (video_id, original_name, type) without a model: title, subtitle, summary,
    sections, actions and notes, in the form that documents.render_markdown takes.

    Key sections are the first six items of the video's outline of that type (outlines: video_id, type, content_json),
    or, without one, of its first eight segments; notes are its first ten segments with text. Only these segments leave
    their tasks. Requests of videos with neither give no row. (video_id, type) of outlines is unique."""
    label, none = type_label(F.col("type")), F.array().cast("array<string>")
    line = F.concat(F.lit("["), T.format_time(F.col("start_ms")), F.lit("-"), T.format_time(F.col("end_ms")), F.lit("] "), T.compact_text(F.col("content"), 180, "...", 180))
    in_order = lambda df, n, text: top_per(df, ["video_id"], [F.col("segment_index"), F.col("id")], n, "_r").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))).alias("l"))
    s = segments.select("video_id", "id", "segment_index", "start_ms", "end_ms", "content")
    first = in_order(s, 8, F.col("content")).select("video_id", F.col("l.t").alias("_first"))
    notes = in_order(s.where(F.trim("content") != ""), 10, line).select("video_id", F.col("l.t").alias("notes"))
    items = outlines.select("video_id", "type", summary_items(F.col("content_json")).alias("_outline"))
    r = requests.select("video_id", "original_name", "type").join(items, ["video_id", "type"], "left").join(first, "video_id", "left").join(notes, "video_id", "left")
    outline = F.coalesce("_outline", none)
    r = r.withColumn("_source", F.when(F.size(outline) > 0, outline).otherwise(F.coalesce("_first", none))).where((F.size("_source") > 0) | F.col("_first").isNotNull())
    section = lambda heading, bullets: F.struct(heading.alias("heading"), F.array(*bullets).alias("bullets"))
    lits = lambda xs: [F.lit(x) for x in xs]
    aim = section(F.lit(AIM_HEADING), [F.concat(F.lit(AIM[0]), "original_name", F.lit(AIM[1])), F.concat(F.lit(AIM[2]), label, F.lit(AIM[3])), F.lit(AIM[4])])
    keys = F.transform(F.slice("_source", 1, 6), lambda x, i: section(F.concat(F.lit(KEY_HEADING), (i + 1).cast("string")), [x, *lits(KEY)]))
    summary = T.compact_text(F.concat(F.lit(SUMMARY[0]), F.array_join(F.slice("_source", 1, 5), "；"), F.lit(SUMMARY[1])), 480, "...", 480)
    sections = F.concat(F.array(aim), keys, F.array(section(F.lit(END_HEADING), lits(END))))
    return r.select("video_id", "type", F.concat("original_name", F.lit(" - "), label).alias("title"), F.lit(SUBTITLE).alias("subtitle"), summary.alias("summary"), sections.alias("sections"), F.array(*lits(ACTIONS)).alias("actions"), F.coalesce("notes", none).alias("notes"))
