"""JSON, summary, version and repair operators over transcripts, and content checks of files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidweave.functions import text as T
from vidweave.sources.storage import stored

from .scans import Scan, prefix_scan

ASR_JSON = "struct<result: struct<language: string>, transcription: array<struct<text: string, offsets: struct<`from`: bigint, `to`: bigint>>>>"
_SPACE = " \t\n\r\x0b\x0c"
SNAPSHOT_JSON = "array<struct<segment_index: bigint, start_ms: bigint, end_ms: bigint, content: string>>"


OCR_JSON = "struct<available: boolean, error: string, samples: array<struct<segmentIndex: int, startMs: bigint, endMs: bigint, asrText: string, ocrText: string, confidence: double, available: boolean>>>"
VAD_JSON = "struct<segments: array<struct<sourceStartMs: bigint, sourceEndMs: bigint, transcriptionStartMs: bigint, transcriptionEndMs: bigint>>>"
#: The lists that a generated bundle must hold, and where each goes.
BUNDLE_LISTS = {"corePoints": "core_points", "meetingMinutes": "meeting_minutes", "blogOutline": "blog_outline", "pptOutline": "ppt_outline", "engineeringInsights": "engineering_insights"}
DOCUMENT_JSON = "struct<title: string, subtitle: string, executiveSummary: string, sections: array<struct<heading: string, bullets: array<string>>>, actionItems: array<string>, sourceNotes: array<string>>"


def parse_ocr_json(df: DataFrame, json: str = "json") -> DataFrame:
    """Samples of screen text runs (video_id, json), their texts repaired; a missing confidence is 0, a missing flag
    false. A run without samples gives no rows."""
    x = df.select("video_id", F.inline(F.from_json(json, OCR_JSON)["samples"]))
    repaired = lambda c: T.repair_encoding(F.coalesce(F.col(c), F.lit("")))["text"]
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return x.select("video_id", number("segmentIndex").alias("segment_index"), number("startMs").alias("start_ms"), number("endMs").alias("end_ms"), repaired("asrText").alias("asr"), repaired("ocrText").alias("ocr"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("available", F.lit(False)).alias("available"))


def write_vad_map(mapped: DataFrame) -> DataFrame:
    """(video_id, json) of the map rows (start_ms, end_ms, mapped_start_ms, mapped_end_ms) of each video, in order."""
    row = F.struct(F.col("start_ms").alias("sourceStartMs"), F.col("end_ms").alias("sourceEndMs"), F.col("mapped_start_ms").alias("transcriptionStartMs"), F.col("mapped_end_ms").alias("transcriptionEndMs"))
    return mapped.groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("segments"))).alias("json"))


def read_vad_map(df: DataFrame, json: str = "json") -> DataFrame:
    rows = df.select("video_id", F.inline(F.from_json(json, VAD_JSON)["segments"]))
    return rows.toDF("video_id", "start_ms", "end_ms", "mapped_start_ms", "mapped_end_ms")


def strip_fence(content: Column) -> Column:
    """What stands between the first line of an opening Markdown fence and the last fence; other texts trimmed."""
    text = F.trim(content, F.lit(" \t\n\r"))
    return F.when(text.rlike(r"(?s)^```[^\n]*\n.*```"), F.trim(F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```", 1), F.lit(" \t\n\r"))).otherwise(text)


def _texts(c: Column) -> Column:
    """The entries of a list, trimmed, without blank ones; an empty list for null."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def parse_generated_bundle(df: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of df: accepted ones have the five lists as columns; a text that is no JSON, or in
    which one of them is missing or empty, is rejected."""
    j = F.from_json(strip_fence(F.col(content)), "struct<" + ", ".join(f"{k}: array<string>" for k in BUNDLE_LISTS) + ">")
    parsed = df.withColumn("_j", j).select(*df.columns, *[_texts(F.col("_j")[k]).alias(v) for k, v in BUNDLE_LISTS.items()])
    whole = F.lit(True)
    for v in BUNDLE_LISTS.values():
        whole = whole & (F.size(v) > 0)
    return parsed.where(whole), parsed.where(~whole).select(df.columns)


def parse_export_document(df: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of df: accepted ones have title, subtitle, summary, sections (heading, bullets),
    actions and notes; sections without heading or bullets go, and a text without title, summary or sections is
    rejected."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<struct<heading: string, bullets: array<string>>>")
    sections = F.filter(F.transform(F.coalesce(F.col("_j.sections"), none), lambda s: F.struct(text(s["heading"]).alias("heading"), _texts(s["bullets"]).alias("bullets"))), lambda s: (s["heading"] != "") & (F.size(s["bullets"]) > 0))
    fields = [text(F.col("_j.title")).alias("title"), text(F.col("_j.subtitle")).alias("subtitle"), text(F.col("_j.executiveSummary")).alias("summary"), sections.alias("sections"), _texts(F.col("_j.actionItems")).alias("actions"), _texts(F.col("_j.sourceNotes")).alias("notes")]
    parsed = df.withColumn("_j", F.from_json(strip_fence(F.col(content)), DOCUMENT_JSON)).select(*df.columns, *fields)
    whole = (F.col("title") != "") & (F.col("summary") != "") & (F.size("sections") > 0)
    return parsed.where(whole), parsed.where(~whole).select(df.columns)


#: What a name seen on screen must hold, and what it then mends in the transcript (pattern, text).
SEEN_TERMS: list[tuple[list[str], list[tuple[str, str]]]] = [
    (["claudecode", "claude code"], [(r"(?i)Code\s*code", "Claude Code"), (r"(?i)Claude\s*Code", "Claude Code")]),
    (["agent"], [("A阵", "agent"), ("AZN", "agent"), ("A站", "agent")]),
    (["skill", "skil"], [(r"(?i)\bskyo\b", "skill"), (r"(?i)\bskil\b", "skill"), (r"(?i)Skills\b", "skills")]),
]


def ocr_evidence_terms(segments: DataFrame, seen: DataFrame, terms: list[tuple[list[str], list[tuple[str, str]]]] | None = None) -> DataFrame:
    """segments with the terms mended for which a text of seen (video_id, ocr) of their video holds a needle."""
    terms, low = SEEN_TERMS if terms is None else terms, F.lower(F.coalesce("ocr", F.lit("")))
    flags = seen.groupBy("video_id").agg(*[F.max(T.contains_any(low, needles)).alias(f"_f{k}") for k, (needles, _) in enumerate(terms)])
    out, text = segments.join(flags, "video_id", "left"), F.col("content")
    for k, (_, rules) in enumerate(terms):
        for pattern, term in rules:
            text = F.when(F.col(f"_f{k}"), F.regexp_replace(text, pattern, term)).otherwise(text)
        out = out.withColumn("content", text)
        text = F.col("content")
    return out.select(segments.columns)


def parse_asr_json(df: DataFrame, json: str = "json") -> DataFrame:
    """Segments of recogniser output (video_id, json): blank texts go, then the rest are numbered."""
    p = df.select("video_id", F.from_json(json, ASR_JSON).alias("j")).select("video_id", F.coalesce("j.result.language", F.lit("unknown")).alias("language"), F.posexplode("j.transcription").alias("pos", "t"))
    start = F.coalesce("t.offsets.from", F.lit(0))
    p = p.select("video_id", "language", "pos", start.alias("start_ms"), F.coalesce("t.offsets.to", start + 1).alias("end_ms"), T.normalize_text(F.col("t.text")).alias("content")).where("content <> ''")
    return p.withColumn("segment_index", (F.row_number().over(Window.partitionBy("video_id").orderBy("pos")) - 1).cast("long")).drop("pos")


def summary_items(json: Column) -> Column:
    """The first list with entries of points, items and hooks, trimmed, numbers as text. A text that is no JSON is its
    only item; JSON without these lists (a list, a number) has none."""
    whole = F.try_parse_json(json)
    member = lambda k: F.try_variant_get(whole, f"$.{k}", "array<variant>")
    plain = lambda x: ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)")
    text = lambda x: F.when(plain(x), F.trim(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")), F.lit(_SPACE))).otherwise("")
    none = F.array().cast("array<string>")
    clean = lambda k: F.filter(F.transform(F.coalesce(member(k), F.array().cast("array<variant>")), text), lambda x: x != "")
    lists = F.array(*[clean(k) for k in ("points", "items", "hooks")])
    first = F.coalesce(F.get(F.filter(lists, lambda x: F.size(x) > 0), 0), none)
    blank = json.isNull() | (F.trim(json, F.lit(_SPACE)) == "")
    return F.when(blank, none).when(whole.isNull(), F.array(json)).otherwise(first)


def parse_snapshot_json(df: DataFrame, json: str = "snapshot_json") -> DataFrame:
    return df.select("video_id", F.inline(F.from_json(json, SNAPSHOT_JSON)))


def version_list(versions: DataFrame, n: int = 20, preview: int = 90) -> DataFrame:
    """The latest n versions of each video: segments, and the first text that is not blank."""
    v = versions.withColumn("_s", F.from_json("snapshot_json", SNAPSHOT_JSON)).withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("version_no")))).where(F.col("_r") <= n)
    first = F.get(F.filter("_s", lambda s: F.trim(s["content"]) != ""), 0)["content"]
    return v.select("video_id", "version_no", F.size("_s").cast("long").alias("n_segments"), T.compact_text(first, preview, "...").alias("preview"))


def render_markdown(title: Column, subtitle: Column, summary: Column, sections: Column, notes: Column, headings: tuple[str, str] = ("执行摘要", "来源片段"), actions: Column | None = None, actions_heading: str = "行动项", footer: str = "") -> Column:
    """A document as Markdown. sections: array of struct heading, bullets; notes and actions: array of string."""
    bullets = lambda xs: F.concat(F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n"))
    items = lambda heading, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"## {heading}\n\n"), bullets(xs))).otherwise("")
    body = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), bullets(s["bullets"]))), "")
    quote = F.when(F.trim(subtitle) != "", F.concat(F.lit("> "), subtitle, F.lit("\n\n"))).otherwise("")
    to_do = F.lit("") if actions is None else items(actions_heading, actions)
    return F.concat(F.lit("# "), title, F.lit("\n\n"), quote, F.lit(f"## {headings[0]}\n\n"), summary, F.lit("\n\n"), body, to_do, items(headings[1], notes), F.lit(footer))


def validate_container(content: Column, name: Column, size: Column, most: int, extensions: tuple[str, ...] = ("mp4", "mov", "m4v", "mkv", "webm", "avi")) -> Column:
    """ok, or why a file is turned away: its size, extension or first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    magic = (F.substring(head, 9, 8) == "66747970") | head.startswith("1A45DFA3") | (head.startswith("52494646") & (F.substring(head, 17, 8) == "41564920"))
    extension = F.regexp_extract(F.lower(F.trim(name)), r"\.([^.]*)$", 1)
    return F.when(size <= 0, "empty").when(size > most, "size").when(~extension.isin(*extensions), "extension").when(~magic, "signature").otherwise("ok")


def glossary_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (pattern, replacement, updated) by key, the newest kept and enabled; unusable ones are passed over."""
    n = new.select(T.collapse(F.col("pattern")).alias("pattern"), T.collapse(F.col("replacement")).alias("replacement"), "updated")
    n = n.where("pattern <> '' AND replacement <> '' AND length(pattern) <= 255 AND length(replacement) <= 255 AND lower(pattern) <> lower(replacement)").withColumn("enabled", F.lit(True))
    return old.unionByName(n).groupBy("pattern", "replacement").agg(F.max_by("enabled", "updated").alias("enabled"), F.max("updated").alias("updated"))


@dataclass(frozen=True)
class ContextRule:
    """A pattern that is replaced in videos whose text holds one of the strong needles, or two of the weak ones."""

    strong: tuple[str, ...]
    pattern: str
    replacement: str
    weak: tuple[str, ...] = ()


#: Misheard terms, and what must be in a video's text for each to be mended.
CONTEXT_RULES: list[ContextRule] = [
    ContextRule(("redis", "redisson", "setnx"), r"(?iu)(?<![A-Za-z])read\s+is(?![A-Za-z])|(?<![A-Za-z])ready\s+is(?![A-Za-z])|瑞蒂斯|雷蒂斯", "Redis", ("缓存", "分布式锁", "热点 key", "令牌桶")),
    ContextRule(("mysql", "sql", "数据库", "唯一索引", "事务", "回表", "explain"), r"(?iu)买\s*SQL|麦\s*SQL|(?<![A-Za-z])mine\s+sql(?![A-Za-z])", "MySQL"),
    ContextRule(("mybatis", "mapper", "动态 sql", "批量入库"), r"(?iu)(?<![A-Za-z])my\s+bat\s*is(?![A-Za-z])|买\s*batis", "MyBatis"),
    ContextRule(("docker", "容器", "镜像", "compose"), r"(?iu)(?<![A-Za-z])dock\s+her(?![A-Za-z])|打客|多克|道客", "Docker"),
    ContextRule(("qdrant", "向量数据库", "vector", "embedding"), r"(?iu)(?<![A-Za-z])q\s*drant(?![A-Za-z])|向量库", "Qdrant"),
    ContextRule(("embedding", "向量", "召回", "rag"), r"(?iu)(?<![A-Za-z])im\s*bedding(?![A-Za-z])|嵌入向量", "Embedding"),
    ContextRule(("rerank", "重排", "召回", "向量"), r"(?iu)(?<![A-Za-z])re\s*rank(?![A-Za-z])|重排序", "Rerank"),
    ContextRule(("agent", "工具调用", "多轮", "问答", "rag"), r"(?iu)(?<![A-Za-z])a\s+gent(?![A-Za-z])|智能代理", "Agent"),
    ContextRule(("rag", "检索增强", "向量", "召回", "引用"), r"(?iu)检索增强生成|(?<![A-Za-z])rack(?![A-Za-z])", "RAG"),
    ContextRule(("claude", "claude code", "codex", "ai 编程"), r"(?iu)(?<![A-Za-z])cloud\s+code(?![A-Za-z])|克劳德\s*(代码|扣的|code)", "Claude Code"),
    ContextRule(("codex", "claude code", "代码", "vibecoding"), r"(?iu)(?<![A-Za-z])cortex(?![A-Za-z])|代码\s*x", "Codex"),
    ContextRule(("jvm", "堆内存", "gc", "线程", "java"), r"(?iu)(?<![A-Za-z])java\s+virtual\s+machine(?![A-Za-z])|虚拟机内存", "JVM"),
    ContextRule(("oom", "内存", "jvm", "堆"), r"(?iu)内存溢出|(?<![A-Za-z])out\s+of\s+memory(?![A-Za-z])", "OOM"),
    ContextRule(("mq", "消息", "rocketmq", "异步", "队列"), r"(?iu)消息队列|(?<![A-Za-z])message\s+queue(?![A-Za-z])", "MQ"),
]


def context_evidence(segments: DataFrame, rules: list[ContextRule], text: str = "_plain", width: int = 1000) -> DataFrame:
    """(video_id, _e0, _e1, ...): whether each rule has its evidence in the video's text, its segments' joined by
    spaces, lower case. A needle with spaces may lie across the border of segments: each is looked up in a segment and
    the ends of as many before it as the needle has spaces, as long as a needle. No video's text is put together."""
    needles = sorted({n.lower() for r in rules for n in (*r.strong, *r.weak)})
    back, longest = max((n.count(" ") for n in needles), default=0), max(map(len, needles), default=1)
    s = segments.withColumn("_hay", F.lower(F.coalesce(F.col(text), F.lit(""))))
    s = s.withColumn("_near", F.col("_hay"))
    for _ in range(back):  # what stands before, one segment further back each time
        s = prefix_scan(s, "video_id", F.col("segment_index"), width, ["segment_index", "id"], [Scan("_before", "last", F.right("_near", F.lit(longest)))])
        s = s.withColumn("_near", F.concat(F.coalesce(F.concat("_before", F.lit(" ")), F.lit("")), "_hay")).drop("_before")
    found = s.groupBy("video_id").agg(*[F.max(F.col("_near").contains(n)).alias(f"_n{k}") for k, n in enumerate(needles)])
    at = {n: F.col(f"_n{k}") for k, n in enumerate(needles)}

    def evidence(rule: ContextRule) -> Column:
        any_strong = reduce(lambda a, b: a | b, [at[n.lower()] for n in rule.strong], F.lit(False))
        return any_strong | (reduce(lambda a, b: a + b, [at[n.lower()].cast("int") for n in rule.weak], F.lit(0)) >= 2)

    return found.select("video_id", *[evidence(r).alias(f"_e{k}") for k, r in enumerate(rules)])


def context_repair(segments: DataFrame, rules: list[ContextRule] | None = None, terms: list[tuple[str, str]] | None = None, most_longer: int = 24, width: int = 1000) -> DataFrame:
    """Patches (id, video_id, text) of segments: normalised, mended by the rules that have evidence in their video,
    and normalised again. A patch changes the text, is not blank and keeps the normalised length in bounds. terms: the
    term rules of normalising."""
    rules = CONTEXT_RULES if rules is None else rules
    s = segments.select("id", "video_id", "segment_index", "content", T.normalize_transcript(F.col("content"), terms).alias("_plain"))
    s = stored(s, "context-plain")
    out = s.join(context_evidence(s, rules, width=width), "video_id")
    text = F.col("_plain")
    for k, r in enumerate(rules):
        text = F.when(F.col(f"_e{k}"), F.regexp_replace(text, r.pattern, r.replacement.replace("\\", "\\\\").replace("$", "\\$"))).otherwise(text)
        out, text = out.withColumn("_text", text), F.col("_text")
    out = out.withColumn("_text", T.normalize_transcript(text, terms))
    n, before = F.length("_text"), F.greatest(F.lit(1), F.length("_plain"))
    safe = (F.trim("_text") != "") & (F.col("_text") != F.coalesce("content", F.lit(""))) & (n <= before + most_longer) & (n >= F.greatest(F.lit(1), F.floor(before / 3)))
    return out.where(safe).select("id", "video_id", F.col("_text").alias("text"))


def repair_batch(segments: DataFrame, rules: list[ContextRule] | None = None, terms: list[tuple[str, str]] | None = None, glossary: list[tuple[str, str]] | None = None, repair: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """segments repaired in three steps (encoding and terms, context, glossary), and by video how many were scanned,
    how many each step changed, the sum, and whether the video is to be indexed again. repair: the first step, a struct
    of text and changed (default: T.repair_transcript)."""
    repaired = T.repair_transcript(F.col("content"), terms) if repair is None else repair(F.col("content"))
    one = stored(segments.withColumn("_r", repaired).select(*[c for c in segments.columns if c != "content"], F.col("_r.text").alias("content"), F.col("_r.changed").alias("_encoding")), "repair-encoding")
    patches = context_repair(one, rules, terms).select("id", F.col("text").alias("_text"))
    two = one.join(patches, "id", "left").withColumn("_context", F.col("_text").isNotNull()).withColumn("content", F.coalesce("_text", "content")).drop("_text")
    three = two.withColumn("_text", T.apply_glossary(F.col("content"), glossary or [])).withColumn("_glossary", F.col("_text") != F.col("content"))
    done = stored(three.withColumn("content", F.col("_text")).drop("_text"), "repair-done")
    n = lambda c: F.count(F.when(F.col(c), 1))
    counts = done.groupBy("video_id").agg(F.count(F.lit(1)).alias("scanned"), n("_encoding").alias("encoding"), n("_context").alias("context"), n("_glossary").alias("glossary"))
    total = F.col("encoding") + F.col("context") + F.col("glossary")
    return done.drop("_encoding", "_context", "_glossary"), counts.withColumn("repaired", total).withColumn("reindexed", total > 0)


def local_summaries(segments: DataFrame, videos: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Summaries of each type from the opening of each video's transcript. Only as many characters as the longest
    needs are joined, so a very long video stays small."""
    need = max(limits.values()) + 1
    by = Window.partitionBy("video_id").orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("_before", F.coalesce(F.sum(F.length(F.trim("content")) + 1).over(by), F.lit(0))).where(F.col("_before") <= need)
    g = s.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", F.trim("content").alias("content")))).alias("l"))
    text = T.collapse(F.array_join(F.col("l.content"), " "))
    rows = videos.select("video_id").join(g, "video_id", "left").select("video_id", F.coalesce(text, F.lit("")).alias("t"))
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.when(F.col("t") == "", "no transcript").otherwise(T.compact_text(F.col("t"), n)).alias("summary")) for k, n in limits.items()])
    return rows.select("video_id", F.inline(kinds))
