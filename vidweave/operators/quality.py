"""Subtitle quality: sampling, error rates, fusing of a spoken and a seen text, reports, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidweave.functions import text as T
from vidweave.functions.distance import edit_distance


def systematic_sample(segments: DataFrame, n: int) -> DataFrame:
    """Of each video's non-blank segments by start, the ranks floor(i * size / n) for i < n, or all of up to n."""
    by = Window.partitionBy("video_id").orderBy("start_ms", "segment_index")
    r = segments.where(F.trim("content") != "").withColumn("_rank", F.row_number().over(by) - 1).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("video_id")))
    # rank r is chosen if some i has floor(i * size / n) = r; the only candidate is the smallest i that reaches r
    i = F.ceil(F.col("_rank") * n / F.col("_size"))
    chosen = (i < n) & (F.floor(i * F.col("_size") / n) == F.col("_rank"))
    return r.where((F.col("_size") <= n) | chosen).drop("_rank", "_size")


def comparable(c: Column) -> Column:
    return F.lower(F.translate(F.coalesce(c, F.lit("")), "，。 \t\n\x0b\f\r", ",."))


def cer(hypothesis: Column, reference: Column) -> Column:
    """Edit distance over the reference's length, at most 1."""

    def rate(s: Column) -> Column:
        h, r = s["h"], s["r"]
        return F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(h, r) / F.length(r)))

    return T.bound(F.struct(comparable(hypothesis).alias("h"), comparable(reference).alias("r")), rate)


def _rate(h: Column, r: Column, distance: Column) -> Column:
    """cer of comparable texts by their distance, which only _open_rate ones need."""
    return F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).when(h == r, 0.0).when(F.length(h) >= 2 * F.length(r), 1.0).otherwise(F.least(F.lit(1.0), distance / F.length(r)))


def _open_rate(h: Column, r: Column) -> Column:
    """Whether a rate needs the distance: a text twice as long as the reference differs from it by the whole of it."""
    return (r != "") & (h != r) & (F.length(h) < 2 * F.length(r))


#: Fixed values by mode: confidence for a whole-line swap, least length ratio, least and most error rate.
FUSION_MODES: dict[str, tuple[float, float, float, float]] = {"CONSERVATIVE": (0.985, 0.62, 0.16, 0.72), "STRONG_VISUAL": (0.94, 0.45, 0.08, 0.88), "LOW_CONFIDENCE": (0.96, 0.42, 0.28, 0.92)}


def tech_tokens(c: Column) -> Column:
    """Product names spelled one way."""
    for found, name in (("Claude\\s*Code", "Claude Code"), ("Spring\\s*Boot", "Spring Boot"), ("Spring\\s*Cloud", "Spring Cloud"), ("Rocket\\s*MQ", "RocketMQ"), ("Rabbit\\s*MQ", "RabbitMQ"), (r"\b(?:skil|skyo)\b", "skill")):
        c = F.regexp_replace(c, "(?i)" + found, name)
    return c


def fuse_text(asr: Column, ocr: Column, confidence: Column, mode: str = "CONSERVATIVE", least_confidence: float = 0.88, traditional: str = "") -> Column:
    """The seen text where it may replace the spoken one, by the mode's limits; else the spoken text, with a product
    name of the seen one where that lowers the error rate. Both texts' encoding is repaired first, so a garbled one that
    cannot be repaired counts as empty. A spoken text with characters of `traditional` counts as
    mistaken in LOW_CONFIDENCE."""
    cleaned = F.struct(*[cleaned_line(c).alias(name) for c, name in ((asr, "a"), (ocr, "o"))])

    def decided(s: Column) -> Column:
        a, o, rate = s["t"]["a"], s["t"]["o"], s["rate"]
        merged = _merged(a, o)
        return _fused(a, o, rate, merged, (merged != a) & (cer(merged, o) < rate), confidence, mode, least_confidence, traditional)

    return T.bound(T.bound(cleaned, lambda t: F.struct(t.alias("t"), cer(t["a"], t["o"]).alias("rate"))), decided)


def cleaned_line(c: Column) -> Column:
    return tech_tokens(T.repair_encoding(c)["text"])


def _merged(a: Column, o: Column) -> Column:
    """The spoken text with a product name of the seen one."""
    return F.when(F.lower(F.replace(o, F.lit(" "), F.lit(""))).contains("claudecode"), F.regexp_replace(a, r"(?i)Code\s*code", "Claude Code")).otherwise(a)


def _fused(a: Column, o: Column, rate: Column, merged: Column, nearer: Column, confidence: Column, mode: str, least_confidence: float, traditional: str) -> Column:
    """The text that a mode chooses of the cleaned ones; a rate that does not matter may be null."""
    sure, ratio, low, high = FUSION_MODES[mode]
    n, m = F.length(a), F.length(o)
    lengths = F.least(n, m) / F.greatest(F.lit(1), F.greatest(n, m))
    letter, digit = r"[\p{L}\p{IsHan}]", r"\p{Nd}"
    useful = o.rlike(f"(?s){letter}.*?{letter}") & (~o.rlike(digit) | (F.regexp_count(o, F.lit(digit)) * 2 < F.greatest(F.lit(1), m)))
    close = (lengths >= ratio) & rate.between(low, high)
    garbled = lambda c: c.rlike(f"[{T.SUSPICIOUS_LATIN}�]|{T.CONTROL}") & T.garbled(c)  # noqa: E731  counts only where there is something to count
    if mode == "CONSERVATIVE":
        swap = (m >= 8) & ((a == "") | (~garbled(o) & ((m >= 0.72 * n) | (m >= 12)) & close))
    elif mode == "STRONG_VISUAL":
        swap = useful & ~garbled(o) & ((a == "") | garbled(a) | (((m >= 0.55 * n) | (m >= 10)) & close))
    else:
        mistaken = (F.translate(a, traditional, "") != a) if traditional else F.lit(False)
        swap = useful & ~garbled(o) & ((a == "") | garbled(a) | ((lengths >= ratio) & (rate <= high) & ((rate >= low) | mistaken)))
    return F.when((o == "") | (confidence < least_confidence), a).when((confidence >= sure) & swap, o).when(nearer, merged).otherwise(a)


def fuse_texts(pairs: DataFrame, modes: list[str], least_confidence: float = 0.88, traditional: str = "") -> DataFrame:
    """pairs (asr, ocr, confidence and others) with fuse_text by each mode as columns fused_ and the mode in small letters.
    Texts are cleaned once for all modes, and distances of whole batches are taken where a mode can depend on them."""
    own = [c for c in pairs.columns if c not in ("asr", "ocr", "confidence")]
    p = pairs.select(*own, "confidence", cleaned_line(F.col("asr")).alias("_a"), cleaned_line(F.col("ocr")).alias("_o"))
    a, o, m, h, r = (F.col(c) for c in ("_a", "_o", "_m", "_h", "_r"))
    p = p.select("*", _merged(a, o).alias("_m"), comparable(a).alias("_h"), comparable(o).alias("_r"))
    n, k = F.length(a), F.length(o)
    sure, ratio = min(FUSION_MODES[x][0] for x in modes), min(FUSION_MODES[x][1] for x in modes)
    named = m != a
    asked = (o != "") & (F.col("confidence") >= least_confidence) & (named | ((F.col("confidence") >= sure) & (F.least(n, k) >= ratio * F.greatest(n, k) - 1)))
    p = p.withColumn("_g", F.when(asked & named, comparable(m)))
    g = F.col("_g")
    p = p.withColumn("_d", edit_distance(F.when(asked & _open_rate(h, r), h), r)).withColumn("_dm", edit_distance(F.when(_open_rate(g, r), g), r))
    p = p.withColumn("_rate", F.when(asked, _rate(h, r, F.col("_d")))).withColumn("_nearer", named & (F.when(asked, _rate(g, r, F.col("_dm"))) < F.col("_rate")))
    return p.select(*own, *[_fused(a, o, F.col("_rate"), m, F.col("_nearer"), F.col("confidence"), x, least_confidence, traditional).alias(f"fused_{x.lower()}") for x in modes])


def fusion_report(samples: DataFrame) -> DataFrame:
    """samples (video_id, asr, ocr, fused, available) by video; without an available sample 1, 0, 1, 0."""
    of = lambda c: F.avg(F.when(F.col("available"), c))
    round4 = lambda c: F.floor(c * 10000 + 0.5) / 10000
    s = samples.select("video_id", "available", (F.col("fused") != F.col("asr")).alias("_replaced"), *[F.when(F.col("available"), comparable(F.col(c))).alias(f"_{c}") for c in ("asr", "ocr", "fused")])
    h, r, f = F.col("_asr"), F.col("_ocr"), F.col("_fused")
    # a line's distances in one batch: the fused text is most often the spoken or the seen one
    s = s.withColumn("_d", edit_distance(F.when(_open_rate(h, r), h), r)).withColumn("_df", edit_distance(F.when(_open_rate(f, r) & (f != h), f), r))
    s = s.withColumn("_cer", _rate(h, r, F.col("_d"))).withColumn("_fused_cer", F.when(f == h, F.col("_cer")).otherwise(_rate(f, r, F.col("_df"))))
    g = s.groupBy("video_id").agg(F.count(F.lit(1)).alias("sampled"), F.count(F.when(F.col("available"), 1)).alias("hits"), F.count(F.when(F.col("available") & F.col("_replaced"), 1)).alias("replacements"), of(F.col("_cer")).alias("c"), of(F.col("_fused_cer")).alias("f"))
    return g.select("video_id", "sampled", "hits", "replacements", round4(F.coalesce("c", F.lit(1.0))).alias("cer"), round4(1 - F.coalesce("c", F.lit(1.0))).alias("similarity"), round4(F.coalesce("f", F.lit(1.0))).alias("fused_cer"), round4(1 - F.coalesce("f", F.lit(1.0))).alias("fused_similarity"))


def apply_fusion(segments: DataFrame, replacements: DataFrame) -> DataFrame:
    """segments with the texts of replacements (video_id, segment_index, text)."""
    r = replacements.select("video_id", "segment_index", F.col("text").alias("_text"))
    return segments.join(r, ["video_id", "segment_index"], "left").withColumn("content", F.coalesce("_text", "content")).withColumn("applied", F.col("_text").isNotNull()).drop("_text")


#: What frames a text read from the screen, and what counts as numeric beside digits.
EDGE_MARKS = "·•|_=- "
NUMERIC_MARKS = ".,:/%Kk"


def select_subtitle_line(boxes: DataFrame, least_score: float = 0.88, y_min: float = 0.52, x_range: tuple[float, float] = (0.14, 0.86), most_length: int = 90, numeric_share: float = 0.78, prefer_cjk: bool = False) -> DataFrame:
    """The best line of each frame, then the best frame of each segment. boxes: video_id, segment_index, attempt (the
    frame's number), position (the box's place in its frame), width, height, box (array of points), text, score.

    A line counts if its text without white space and edge marks has 2 to most_length characters, is not mostly
    numeric, is read surely enough and lies low and central. The best one has the most score, a bonus for CJK and for
    lying low, less its length; the best frame the most score and height. Ties go to the earlier box and frame."""
    mean = lambda k: F.aggregate("box", F.lit(0.0), lambda a, p: a + F.get(p, k)) / F.size("box")
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\p{Z}]+", ""), F.lit(EDGE_MARKS))
    b = boxes.withColumn("_text", clean).withColumn("_x", mean(0) / F.greatest(F.lit(1), "width")).withColumn("_y", mean(1) / F.greatest(F.lit(1), "height"))
    cjk = F.col("_text").rlike("[\u4e00-\u9fff]")
    numeric = F.regexp_count("_text", F.lit(rf"[\p{{Nd}}{NUMERIC_MARKS}]")) / F.length("_text")
    good = (F.col("score") >= least_score) & F.length("_text").between(2, most_length) & (numeric < numeric_share) & (F.col("_y") >= y_min) & F.col("_x").between(*x_range)
    b = b.where(good & cjk if prefer_cjk else good)
    rank = F.col("score") + F.when(cjk, 1.2).otherwise(0.0) + F.col("_y") - F.least(F.length("_text"), F.lit(90)) / 260
    line = F.struct(F.col("_text").alias("text"), "score", F.round("_y", 4).alias("center_y"), F.round("_x", 4).alias("center_x"))
    frame = b.groupBy("video_id", "segment_index", "attempt").agg(F.max_by(line, F.struct(rank, -F.col("position"))).alias("l"))
    best = frame.groupBy("video_id", "segment_index").agg(F.max_by(F.struct("l.*", "attempt"), F.struct(F.col("l.score") + F.col("l.center_y"), -F.col("attempt"))).alias("l"))
    return best.select("video_id", "segment_index", "l.*")


def leading_text(segments: DataFrame, least: int = 600, preview: int = 160) -> DataFrame:
    """The first non-blank segments of each video until `least` characters, joined, with their quality."""
    by = Window.partitionBy("video_id").orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.where(F.trim("content") != "").withColumn("_before", F.coalesce(F.sum(F.length("content")).over(by), F.lit(0))).where(F.col("_before") < least)
    g = s.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "content"))).alias("l"))
    text = T.normalize_text(F.array_join(F.col("l.content"), " "))
    return g.select("video_id", F.size("l").cast("long").alias("n_segments"), text.alias("text"), T.compact_text(text, preview).alias("preview"))


def prompt_transcript(segments: DataFrame, budget: int = 8000) -> DataFrame:
    """Timed lines while their total fits the budget; nothing after the first that does not."""
    line = F.concat(F.lit("["), T.format_time(F.col("start_ms")), F.lit("-"), T.format_time(F.col("end_ms")), F.lit("] "), T.collapse(F.col("content")))
    by = Window.partitionBy("video_id").orderBy("segment_index").rowsBetween(Window.unboundedPreceding, 0)
    s = segments.where(F.trim("content") != "").withColumn("line", line).withColumn("_total", F.sum(F.length("line") + 1).over(by))
    return s.where(F.col("_total") <= budget).select("video_id", "segment_index", "line")  # totals only grow
