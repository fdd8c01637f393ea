"""Embedding, search, ranking and citing of transcript segments for many questions at once.

A sparse vector is one row with a map of bucket to value, or a row for each bucket. Segments are searched by a stored
index with block-max bounds (search_index)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidweave.functions import text as T
from vidweave.sources.storage import stored
from vidweave.streaming.windows import cache_hits_ttl, last_question_memory

from . import search_index
from .term_scores import best_segments


def sparse_vectors(df: DataFrame, id_cols: list[str], text_col: str, dim: int = 256, groups: list | None = None) -> DataFrame:
    """A row for each text with a token: its hashed token counts as `vector` (map of bucket to value), and the
    vector's length `norm`."""
    text = F.col(text_col)
    tokens = T.expand(text, T.tokenize(text), T.DOMAIN_TOKENS if groups is None else groups)
    # dealt by id once: counts, norms and what follows by id need no further exchange
    rows = df.select(*id_cols, text_col).repartition(*id_cols).select(*id_cols, F.explode(tokens).alias("_t"))
    counts = rows.groupBy(*id_cols, T.hash_bucket(F.col("_t"), dim).alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "value")))  # at most dim of them
    return counts.groupBy(*id_cols).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), entries.alias("vector"))


def hash_embed(df: DataFrame, id_cols: list[str], text_col: str, dim: int = 256, groups: list | None = None) -> DataFrame:
    """Rows (ids, bucket, value) of the hashed token counts, and the vector's length `norm`."""
    return sparse_vectors(df, id_cols, text_col, dim, groups).select(*id_cols, "norm", F.explode("vector").alias("bucket", "value"))


def embed(df: DataFrame, id_cols: list[str], text_col: str, provider: Callable[[list[str]], list[list[float] | None]] | None = None, dim: int = 256, groups: list | None = None) -> DataFrame:
    """Sparse vectors (ids, norm, vector) by a provider: a function that takes a list of texts and gives a dense
    vector for each, or None where it failed. Blank texts have no vector; zero components are left out; failed
    texts, or all of a batch for which it raised, fall back to the hash embedder, as all do without a provider."""
    text = df.where(F.coalesce(F.trim(text_col), F.lit("")) != "")
    if provider is None:
        return sparse_vectors(text, id_cols, text_col, dim, groups)

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series([None if v is None else [float(x) for x in v] for v in provider(texts.tolist())], dtype=object)
        except Exception:  # a provider may fail in any way: its batch then falls back
            return pd.Series([None] * len(texts), dtype=object)

    found = text.withColumn("_v", dense(F.col(text_col)))
    entries = F.filter(F.transform("_v", lambda x, i: F.struct(i.cast("int").alias("bucket"), x.alias("value"))), lambda e: e["value"] != 0)
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    remote = found.where("_v IS NOT NULL").select(*id_cols, norm.alias("norm"), F.map_from_entries(entries).alias("vector")).where("norm > 0")
    return remote.unionByName(sparse_vectors(found.where("_v IS NULL"), id_cols, text_col, dim, groups))


def dense_vector(values: Column, dim: int = 256) -> Column:
    """A map of bucket to value as an array; keys outside are passed over."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(values, i), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (scale == 0), 0.0).otherwise(dot / scale)


def vector_search(questions: DataFrame, scopes: DataFrame, index: DataFrame, k: int = 12, least: float = 0.08, dim: int = 256, groups: list | None = None) -> DataFrame:
    """The k best segments of each question within its videos, by a stored index (search_index.build_index, made with
    the same dim and groups). questions: question_id, question; scopes: question_id, video_id."""
    return search_index.search(index, sparse_vectors(questions, ["question_id"], "question", dim, groups), scopes, k, least, dim)


def clamp(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def local_rerank(vec: Column, keyword: Column, overlap: Column) -> Column:
    return clamp(0.58 * clamp(vec) + 0.27 * F.least(F.lit(1.0), keyword / 6) + 0.15 * overlap)


def token_overlap(question: Column, content: Column) -> Column:
    q, c = F.array_distinct(T.tokenize(question)), F.array_distinct(T.tokenize(content))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def merge_remote_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates (question_id, position, rerank) with scores (question_id, position, score) in place of their own,
    missing ones 0; a question without any keeps the local ones."""
    s = candidates.join(scores, ["question_id", "position"], "left")
    some = F.max(F.col("score").isNotNull()).over(Window.partitionBy("question_id"))
    return s.withColumn("rerank", F.when(some, clamp(F.col("score"))).otherwise(F.col("rerank"))).drop("score")


def diversify(ranked: DataFrame, k: int = 3, where: Column | None = None) -> DataFrame:
    """The best hit of each video in rank order, then the rest in rank order, to k; for questions where `where` does
    not hold, the first k in rank order."""
    again = F.row_number().over(Window.partitionBy("question_id", "video_id").orderBy("rank")) > 1
    again = again if where is None else again & where
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("_again", "rank"))
    return ranked.withColumn("_again", again).withColumn("rank", order.cast("long")).where(F.col("rank") <= k).drop("_again")


def citable(keyword: Column, vec: Column, rerank: Column) -> Column:
    return (keyword >= 2) | (vec >= 0.72) | (rerank >= 0.68)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def retrieve_evidence(questions: DataFrame, scopes: DataFrame, segments: DataFrame, index: DataFrame, k: int = 3, least_vec: float = 0.32, diverse: bool | None = False, dim: int = 256, groups: list | None = None, synonyms: list | None = None, found: DataFrame | None = None) -> DataFrame:
    """The evidence of each question: search of the index, keyword filter, rerank, order and cut to k. diverse: whether
    each video's best hit comes first; None: where the question asks for a comparison. found: the hits, where they are
    known. `usable` says how many hits of a question passed the filter."""
    found = stored(vector_search(questions, scopes, index, 4 * k, dim=dim, groups=groups), "found") if found is None else found
    e = found.drop("rank").join(segments.select("id", "end_ms", "content"), "id").join(questions.select("question_id", "question"), "question_id")
    keyword = T.keyword_score(F.col("content"), T.query_terms(F.col("question"), synonyms=synonyms))
    e = e.withColumn("kw", keyword).where((F.col("kw") > 0) | (F.col("vec") >= least_vec))
    e = e.withColumn("rerank", F.round(local_rerank(F.col("vec"), F.col("kw"), token_overlap(F.col("question"), F.col("content"))), 6))
    e = e.withColumn("score", F.greatest(F.col("kw"), half_up(10 * F.col("vec")), half_up(10 * F.col("rerank"))))
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank"), F.desc("score"), F.desc("vec"), "start_ms", "video_id", "segment_index")
    e = e.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("usable", F.count(F.lit(1)).over(Window.partitionBy("question_id")))
    if diverse is False:
        e = e.where(F.col("rank") <= k)
    else:
        e = diversify(e, k, None if diverse else T.question_intent(F.col("question")) == "COMPARISON")
    return e.withColumn("citable", citable(F.col("kw"), F.col("vec"), F.col("rerank")))


def confidence_level(score: Column) -> Column:
    return F.when(score.isNull() | (score <= 0), "NONE").when(score >= 4, "HIGH").when(score >= 2, "MEDIUM").otherwise("LOW")


def build_citations(evidence: DataFrame, videos: DataFrame, snippet: int = 90) -> DataFrame:
    """A labelled citation of each citable row."""
    e = evidence.where("citable").join(videos.select("video_id", "original_name"), "video_id", "left")
    name = F.coalesce("original_name", F.concat(F.lit("video#"), F.col("video_id").cast("string")))
    label = F.concat(name, F.lit(" "), T.format_time(F.col("start_ms")), F.lit("-"), T.format_time(F.col("end_ms")))
    return e.select("question_id", "rank", label.alias("label"), "score", T.compact_text(F.col("content"), snippet).alias("snippet"))


def plain_questions(asks: DataFrame) -> DataFrame:
    """asks with `blocked` (the guardrail's reason or null), `intent`, and `plain`: whether they go to retrieval."""
    q = asks.withColumn("blocked", T.guardrail(F.col("question"))).withColumn("intent", T.question_intent(F.col("question")))
    return q.withColumn("plain", F.col("blocked").isNull() & ~F.col("intent").isin("GREETING", "INTRO"))


def previous_questions(asks: DataFrame, history: DataFrame, ttl: str = "20 minutes") -> DataFrame:
    """(question_id, previous, recalled) of follow-up asks (with conversation, ts): the question before in the
    conversation if it is fresh (`memory`), else the last user message of its history (conversation, id, role,
    content; `history`). Greetings and refused asks are not remembered."""
    remembered = last_question_memory(asks.where("plain"), "conversation", "ts", "question_id", ttl).where("intent = 'FOLLOW_UP'")
    said = history.where("role = 'user'").groupBy("conversation").agg(F.max_by("content", "id").alias("_said"))
    found = remembered.join(said, "conversation", "left")
    source = F.when(F.col("previous").isNotNull(), "memory").when(F.col("_said").isNotNull(), "history").otherwise("none")
    return found.select("question_id", F.coalesce("previous", "_said").alias("previous"), source.alias("recalled"))


def answer_batch(asks: DataFrame, found: DataFrame, evidence: DataFrame, videos: DataFrame, history: DataFrame, cache_ttl_s: int = 1800, cache_width_s: int = 86_400) -> DataFrame:
    """One answer an ask (question_id, conversation, ts, question): blocked, greeted, cited from its best evidence, or
    without evidence; with the question it follows up, whether the cache would have answered it (a repeat of a
    question that is not a follow-up, in its conversation, within the time to live), and a trace of the steps. found and
    evidence: the hits of the plain asks before and after filter and ranking."""
    cites = build_citations(evidence, videos)
    best = cites.groupBy("question_id").agg(F.min_by(F.struct("label", "score", "snippet"), "rank").alias("b"), F.count(F.lit(1)).alias("n_citations"))
    counts = evidence.groupBy("question_id").agg(F.max("usable").alias("usable"), F.count(F.lit(1)).alias("top"))
    searched = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("candidates"))
    q = stored(plain_questions(asks), "asks")
    key = F.concat_ws("|", F.col("conversation").cast("string"), F.md5(F.lower(F.trim("question"))))
    cacheable = q.where("plain AND intent <> 'FOLLOW_UP'").select(key.alias("key"), F.unix_timestamp("ts").alias("ts_s"), F.col("question_id").alias("ask_id"))
    cached = cache_hits_ttl(cacheable, cache_ttl_s, cache_width_s).where("hit").select(F.col("ask_id").alias("question_id"), F.lit(True).alias("cached"))
    for more in (best, searched, counts, cached, previous_questions(q, history)):
        q = q.join(more, "question_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    mode = F.when(F.col("blocked").isNotNull(), "blocked").when(~F.col("plain"), F.lower("intent")).when(F.col("b").isNotNull(), "cited").otherwise("fallback")
    q = q.withColumn("mode", mode).withColumn("cached", F.coalesce("cached", F.lit(False)))
    is_ = lambda m: F.col("mode") == m
    answer = F.when(is_("cited"), F.concat(F.lit("Best evidence: "), F.col("b.snippet"), F.lit(" ("), F.col("b.label"), F.lit(")"))).when(is_("blocked"), F.concat(F.lit("Refused: "), F.col("blocked"))).when(is_("fallback"), F.lit("No evidence found.")).otherwise(F.lit("Ask me about your videos."))
    answer = F.when(F.col("plain") & F.col("previous").isNotNull(), F.concat(F.lit("After: "), T.compact_text(F.col("previous"), 60), F.lit(" - "), answer)).otherwise(answer)
    level = F.when(is_("cited"), confidence_level(F.col("b.score"))).otherwise("NONE")
    n_citations = F.when(is_("cited"), n("n_citations")).otherwise(0).cast("long")
    step = lambda name, *what: F.concat(F.lit(f"{name}: "), *what)
    text = lambda c: c.cast("string")
    looked = [
        step("plan", F.when(F.col("intent") == "COMPARISON", "each video first").otherwise("rank")), step("memory", F.coalesce("recalled", F.lit("not asked"))), step("search", text(n("candidates"))),
        step("filter", text(n("usable")), F.lit(" of "), text(n("candidates"))), step("cite", text(n_citations), F.lit(" of "), text(n("top"))), step("answer", F.col("mode"), F.lit(" "), level),
    ]
    first = step("guardrail", F.coalesce("blocked", F.lit("passed")))
    trace = F.when(~F.col("plain"), F.array(first, step("answer", F.col("mode")))).when(F.col("cached"), F.array(first, step("cache", F.lit("hit")))).otherwise(F.array(first, *looked))
    return q.select("question_id", "intent", "mode", "cached", "previous", level.alias("confidence"), n_citations.alias("n_citations"), F.when(is_("cited"), F.col("b.label")).alias("citation"), answer.alias("answer"), trace.alias("trace"))


def index_delta(segments: DataFrame, index: DataFrame) -> DataFrame:
    """Segments to embed: those with a token whose (id, content hash) is not in the index."""
    some = segments.where(F.size(T.tokenize(F.col("content"))) > 0)  # others have no vector
    return some.withColumn("content_hash", F.md5("content")).join(index.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


#: Themes and what in a viewpoint speaks for each, and the words of a comparison.
THEMES: dict[str, list[str]] = {
    "MySQL / 数据一致性": ["mysql", "sql", "事务", "索引", "唯一"],
    "Redis / 缓存与限流": ["redis", "缓存", "限流", "锁", "setnx"],
    "ASR / OCR 字幕质量": ["asr", "ocr", "字幕", "语音", "识别"],
    "RAG / 向量检索": ["rag", "embedding", "vector", "qdrant", "向量", "检索"],
    "Agent / 工具调用": ["agent", "工具", "引用", "问答"],
}
COMPARE_DEFAULT = "对比多个视频的核心观点差异"
VIEWPOINT, NO_VIEWPOINT, DIFFERENCE = ("《", "》主要围绕："), ("《", "》暂时没有可用于对比的字幕片段。"), ("《", "》侧重：")
SHARED, NOTHING_SHARED = "共同涉及：", "共同点需要结合更多字幕证据继续追问。"


def kb_viewpoints(questions: DataFrame, links: DataFrame, videos: DataFrame, segments: DataFrame, k: int = 3, synonyms: list | None = None, first: int = 0) -> DataFrame:
    """Per question (question_id, kb_id, question; a blank one asks for a comparison of the views) of a base of at
    least two videos, a row a video: its viewpoint from the k segments with most score by kb_score, and their
    citations. Segments meet the questions of their base in batches (term_scores). first: adds `last`, the greatest
    of the `first` smallest video_ids of the base, for kb_compare."""
    many = links.groupBy("kb_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("kb_id")
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    text = F.when(blank, F.lit(COMPARE_DEFAULT)).otherwise(F.trim("question"))
    asked = questions.join(many, "kb_id").select("question_id", "kb_id", T.kb_query_terms(text, synonyms).alias("_terms"))
    some = F.filter(F.coalesce("_terms", F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    terms = F.transform(some, lambda t: F.struct(F.lower(t).alias("term"), F.greatest(F.lit(2), F.length(t)).alias("weight")))
    time = F.concat(T.format_time(F.col("start_ms")), F.lit("-"), T.format_time(F.col("end_ms")))
    cut = lambda x, n: F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("..."))).otherwise(x)
    start = F.substring(T.collapse(F.col("content")), 1, 111)  # what both cuts need
    rows = segments.where(F.length(F.trim("content")) >= 6).select("video_id", "start_ms", "segment_index", "end_ms", "content")
    chosen = best_segments(asked.select("question_id", "kb_id", terms.alias("terms")), links, rows, "content", {"time": time, "start": start}, k).withColumnRenamed("best", "_l")
    base = links.join(videos.select("video_id", "original_name"), "video_id")
    ids = asked.select("kb_id", "question_id")
    if first:
        place = F.row_number().over(Window.partitionBy("kb_id").orderBy("video_id"))
        ids = ids.join(base.select("kb_id", "video_id", place.alias("_p")).where(F.col("_p") <= first).groupBy("kb_id").agg(F.max("video_id").alias("last")), "kb_id")
    every = ids.join(base, "kb_id").join(chosen, ["kb_id", "question_id", "video_id"], "left")
    said = F.concat(F.lit(VIEWPOINT[0]), "original_name", F.lit(VIEWPOINT[1]), F.array_join(F.transform("_l", lambda x: cut(x["start"], 72)), "；"))
    none = F.concat(F.lit(NO_VIEWPOINT[0]), "original_name", F.lit(NO_VIEWPOINT[1]))
    cite = lambda x: F.struct(F.concat(F.col("original_name"), F.lit(" "), x["time"]).alias("label"), x["segment_index"].alias("segment_index"), (-x["less"]).alias("score"), cut(x["start"], 110).alias("snippet"))
    cites = F.coalesce(F.transform("_l", cite), F.array().cast("array<struct<label: string, segment_index: bigint, score: bigint, snippet: string>>"))
    return every.select("kb_id", "question_id", "video_id", "original_name", F.when(F.col("_l").isNotNull(), said).otherwise(none).alias("viewpoint"), cites.alias("citations"), *(["last"] if first else []))


def kb_compare(viewpoints: DataFrame, themes: dict[str, list[str]] | None = None, most_themes: int = 5, most_videos: int = 6) -> DataFrame:
    """Per base and question of kb_viewpoints: videos, themes that some viewpoint speaks of (by name, at most
    most_themes), and what the first videos stress. Votes and the first videos are aggregates, so a base of any number
    of videos is never in one place. With `last` (kb_viewpoints with most_videos as `first`) the viewpoints are made and
    read once, else twice."""
    themes = THEMES if themes is None else themes
    low = F.lower("viewpoint")
    by_name = sorted(themes)
    if "last" not in viewpoints.columns:
        place = F.row_number().over(Window.partitionBy("kb_id", "question_id").orderBy("video_id"))
        least = viewpoints.select("kb_id", "question_id", "video_id", place.alias("_r")).where(F.col("_r") <= most_videos)
        viewpoints = viewpoints.join(least.groupBy("kb_id", "question_id").agg(F.max("video_id").alias("last")), ["kb_id", "question_id"])
    stress = F.concat(F.lit(DIFFERENCE[0]), "original_name", F.lit(DIFFERENCE[1]), T.compact_text(F.col("viewpoint"), 120, "...", 119))
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("video_id") <= F.col("last"), F.struct("video_id", stress.alias("t"))))), 1, most_videos)
    g = viewpoints.groupBy("kb_id", "question_id").agg(F.count(F.lit(1)).alias("n_videos"), first.alias("_d"), *[F.max(T.contains_any(low, themes[t])).alias(f"_t{i}") for i, t in enumerate(by_name)])
    shared = F.slice(F.array_compact(F.array(*[F.when(F.col(f"_t{i}"), F.lit(SHARED + t)) for i, t in enumerate(by_name)])), 1, most_themes)
    return g.select("kb_id", "question_id", "n_videos", F.when(F.size(shared) > 0, shared).otherwise(F.array(F.lit(NOTHING_SHARED))).alias("themes"), F.col("_d.t").alias("differences"))
