"""Summaries of videos made from their transcripts alone, and how they and generated ones share a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidweave.functions import text as T

from .relational import insert_if_absent, top_per, upsert

#: Type, title and key of the items' list of each summary.
SUMMARIES: list[tuple[str, str, str]] = [
    ("CORE_POINTS", "ASR 核心观点", "points"),
    ("MEETING_MINUTES", "会议纪要", "items"),
    ("BLOG_OUTLINE", "博客大纲", "items"),
    ("PPT_OUTLINE", "PPT 大纲", "items"),
    ("ENGINEERING_INSIGHTS", "工程洞察", "items"),
]
#: The items of each type. {name} is the video's name, {range} the first segment's times, {first:n} its
#: text and {all:n} the whole transcript, each cut to n characters.
WITH_TEXT: dict[str, list[str]] = {
    "CORE_POINTS": ["视频：{name}", "字幕内容概览：{all:220}", "可追溯片段：{range} {first:120}", "当前为 ASR 字幕驱动的结构化总结，云端 LLM 可通过页面或环境变量启用"],
    "MEETING_MINUTES": ["会议主题：{name}", "讨论摘要：{all:180}", "关键证据：{range} {first:120}", "待办事项：复看高价值时间片段，并按需接入真实 LLM 生成责任人与截止时间"],
    "BLOG_OUTLINE": ["标题：{name} 的结构化整理", "开篇：从视频字幕中抽取主要问题和场景", "主体一：{first:110}", "主体二：{all:170}", "结尾：保留时间戳引用，方便回看原视频"],
    "PPT_OUTLINE": ["封面：{name}", "第 1 页：背景与问题 - {first:100}", "第 2 页：核心内容 - {all:150}", "第 3 页：证据引用 - {range}", "第 4 页：下一步 - 接入真实 LLM 后生成演讲稿和版式"],
}
#: The items where a video has no segments.
WITHOUT_TEXT: dict[str, list[str]] = {
    "CORE_POINTS": ["视频：{name}", "本地 ASR 已执行，但没有识别到有效语音字幕", "建议上传包含清晰人声的视频后重新生成总结", "云端 LLM 未启用或不可用时，会使用本地总结器兜底"],
    "MEETING_MINUTES": ["会议主题：{name}", "讨论结论：未识别到有效语音，暂不能形成真实纪要", "待办事项：重新上传清晰人声视频后再生成会议纪要"],
    "BLOG_OUTLINE": ["标题：{name} 的结构化整理", "开篇：说明视频已解析但没有有效字幕", "主体：补充清晰语音后再展开观点、案例和结论", "结尾：当前结果来自本地模板总结器"],
    "PPT_OUTLINE": ["封面：{name}", "第 1 页：视频解析状态与空字幕原因", "第 2 页：上传、MD5 去重、ffmpeg、ASR 的处理链路", "第 3 页：下一步接入真实 LLM 后生成演讲稿"],
    "ENGINEERING_INSIGHTS": ["ASR：关注音频质量、模型大小、VAD 与空字幕兜底", "ffmpeg：关注抽音频、子进程超时、标准输出阻塞", "任务状态机：关注失败重试、幂等和状态一致性"],
}
#: An insight and the words of which a transcript must hold one.
INSIGHTS: list[tuple[str, list[str]]] = [
    ("MySQL：任务状态、MD5 唯一索引、事务和乐观锁是关键数据边界", ["mysql", "my sql", "sql", "database", "status"]),
    ("Redis：上传进度缓存、防重复提交、热点 Key 和一致性是关键性能边界", ["redis", "readies", "cache", "progress"]),
    ("AI Agent：字幕检索、时间戳引用、召回重排和防幻觉是关键质量边界", ["agent", "rag", "embedding", "vector", "answer"]),
    ("Java 并发：本地 DAG、线程池参数、拒绝策略和失败重试是关键调度边界", ["thread", "queue", "dag", "async", "retry"]),
]
#: The insights where no word is found, and the text that stands for none.
NO_INSIGHT = ["ASR：真实字幕生成、时间戳对齐和空结果兜底是基础能力", "检索：video_id + start_ms 联合索引支撑时间轴定位", "后端链路：上传、去重、抽音频、ASR、总结状态流转形成完整闭环"]
NOTHING = "未识别到可用文本"
LONGEST = 220


def _filled(template: str, name: Column, times: Column, first: Column, whole: Column) -> Column:
    """A template as a Column."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        hole, _, rest = tail.partition("}")
        kind, _, n = hole.partition(":")
        value = {"name": name, "range": times, "first": first, "all": whole}[kind]
        if n:
            text = T.compact_text(value, int(n))
            value = F.when(text == "", F.lit(NOTHING)).otherwise(text)
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))


def summary_assets(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """Five summaries of each video of videos (video_id, original_name): type, title, items and their JSON.

    Words are looked for in every segment. (A word of several would be found over a border only if it held a space;
    the one that does holds another.) Of the texts themselves only the opening is joined: as each segment adds two
    characters at least, the first ones by index are enough, and Spark cuts them before it shuffles, so a video of any
    length is small. A segment without an index comes last; null texts are blank; a null name is empty; videos that
    repeat have summaries each."""
    order = ["segment_index", "start_ms", "content"]
    s = segments.select("video_id", "segment_index", "start_ms", "end_ms", F.coalesce("content", F.lit("")).alias("content"))
    found = [F.max(T.contains_any(F.lower("content"), words)).alias(f"_w{k}") for k, (_, words) in enumerate(INSIGHTS)]
    rank = F.struct(F.col("segment_index").isNull(), *order)
    per_video = s.groupBy("video_id").agg(F.min_by(F.struct("start_ms", "end_ms", T.compact_text(F.col("content"), LONGEST + 1).alias("text")), rank).alias("_first"), *found)
    ordered = [F.col("segment_index").asc_nulls_last(), F.col("start_ms"), F.col("content")]
    opening = top_per(s.where(T.collapse(F.col("content")) != ""), ["video_id"], ordered, LONGEST // 2 + 1, "_rank")
    cut = F.struct("_rank", F.substring(T.collapse(F.col("content")), 1, LONGEST + 2).alias("text"))  # a space at the cut is trimmed
    joined = opening.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list(cut))["text"], " ").alias("_all"))
    v = videos.select("video_id", F.coalesce("original_name", F.lit("")).alias("_name")).join(per_video, "video_id", "left").join(joined, "video_id", "left")
    times = F.concat(T.format_time(F.coalesce("_first.start_ms", F.lit(0))), F.lit("-"), T.format_time(F.coalesce("_first.end_ms", F.lit(0))))
    filled = lambda t: _filled(t, F.col("_name"), times, F.coalesce("_first.text", F.lit("")), F.coalesce("_all", F.lit("")))
    hits = F.filter(F.array(*[F.when(F.col(f"_w{k}"), F.lit(text)) for k, (text, _) in enumerate(INSIGHTS)]), lambda x: x.isNotNull())
    insights = F.when(F.size(hits) > 0, hits).otherwise(F.array(*map(F.lit, NO_INSIGHT)))

    def row(kind: str, title: str, key: str) -> Column:
        some = F.array(*map(filled, WITH_TEXT[kind])) if kind in WITH_TEXT else insights
        items = F.when(F.col("_first").isNull(), F.array(*map(filled, WITHOUT_TEXT[kind]))).otherwise(some)
        return F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), items.alias("items"), F.to_json(F.struct(items.alias(key))).alias("content_json"))

    return v.select("video_id", F.inline(F.array(*[row(*k) for k in SUMMARIES])))


def ensure_summaries(existing: DataFrame, local: DataFrame, generated: DataFrame, prompt_version: str = "llm-v1") -> DataFrame:
    """The table of summaries (video_id, type, title, content_json, model, prompt_version) after new ones have come.

    Generated rows (without prompt_version) replace those of their type, but only in videos that have no row of this
    prompt version yet. Videos that take no generated rows get the local ones of the types that they lack. Keys are
    unique in each table."""
    done = existing.where(F.col("prompt_version") == prompt_version).select("video_id").distinct()
    new = generated.join(done, "video_id", "left_anti").withColumn("prompt_version", F.lit(prompt_version))
    base = local.withColumn("model", F.lit(None).cast("string")).withColumn("prompt_version", F.lit(None).cast("string"))
    filling = base.join(new.select("video_id").distinct(), "video_id", "left_anti").select(existing.columns)
    return insert_if_absent(upsert(existing, new.select(existing.columns), ["video_id", "type"]), filling, ["video_id", "type"])
