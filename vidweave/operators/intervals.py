"""Interval algebra over (key, start_ms, end_ms) rows: merge, complement, pad, concatenate, map and locate.

Running values over a key's intervals are blocked prefix scans (scans.prefix_scan): a key's rows are dealt by ranges of
time of `width_ms`, and a range takes over one summary row, so a key that holds most rows is in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidweave.functions import text as T
from vidweave.operators.scans import Scan, prefix_scan

#: The default range: an hour, some thousand rows of a timeline. Timelines of sparser rows take a wider one.
WIDTH_MS = 3_600_000


def _scan(df: DataFrame, key: str, width_ms: int, *scans: Scan) -> DataFrame:
    return prefix_scan(df, key, F.col("start_ms"), width_ms, ["start_ms", "end_ms"], list(scans))


def merge_intervals(df: DataFrame, key: str, gap: int = 80, width_ms: int = WIDTH_MS) -> DataFrame:
    """Intervals joined where the next starts no later than `gap` after the end so far."""
    reached = _scan(df.select(key, "start_ms", "end_ms"), key, width_ms, Scan("_reach", "max", F.col("end_ms")))
    new = F.when(F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach") + gap), 1).otherwise(0)
    islands = _scan(reached.withColumn("_new", new), key, width_ms, Scan("_island", "sum", F.col("_new"), inclusive=True))
    return islands.groupBy(key, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def complement_intervals(silences: DataFrame, durations: DataFrame, key: str, width_ms: int = WIDTH_MS) -> DataFrame:
    """The gaps between silences within [0, duration_ms], tail included. durations: key, duration_ms."""
    s = silences.join(durations, key).select(key, F.greatest(F.lit(0), "start_ms").alias("start_ms"), F.least("end_ms", "duration_ms").alias("end_ms"))
    tail = durations.select(key, F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    gaps = _scan(s.unionByName(tail), key, width_ms, Scan("_reach", "max", F.col("end_ms"))).withColumn("_from", F.coalesce("_reach", F.lit(0)))
    return gaps.where("start_ms > _from").select(key, F.col("_from").cast("long").alias("start_ms"), F.col("start_ms").alias("end_ms"))


def pad_and_merge(df: DataFrame, durations: DataFrame, key: str, pad: int = 120, least: int = 200, gap: int = 80, width_ms: int = WIDTH_MS) -> DataFrame:
    p = df.join(durations, key).select(key, F.greatest(F.lit(0), F.col("start_ms") - pad).cast("long").alias("start_ms"), F.least(F.col("end_ms") + pad, "duration_ms").alias("end_ms"))
    return merge_intervals(p.where(F.col("end_ms") - F.col("start_ms") >= least), key, gap, width_ms)


def cumulative_map(df: DataFrame, key: str, width_ms: int = WIDTH_MS) -> DataFrame:
    """Each interval's place on the timeline of all of them joined end to end."""
    length = F.col("end_ms") - F.col("start_ms")
    placed = _scan(df, key, width_ms, Scan("mapped_start_ms", "sum", length))
    return placed.withColumn("mapped_start_ms", F.coalesce("mapped_start_ms", F.lit(0)).cast("long")).withColumn("mapped_end_ms", F.col("mapped_start_ms") + length)


def gain_gate(speech: DataFrame, durations: DataFrame, key: str, least_ms: int = 1000, least_share: float = 0.08) -> DataFrame:
    """Whether cutting to speech saves enough: kept, saved, ratio and verdict of each key."""
    kept = speech.groupBy(key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("kept_ms"))
    out = durations.join(kept, key, "left").withColumn("kept_ms", F.coalesce("kept_ms", F.lit(0)).cast("long")).withColumn("saved_ms", F.col("duration_ms") - F.col("kept_ms"))
    need = F.greatest(F.lit(least_ms), F.floor(F.col("duration_ms") * least_share + 0.5))
    return out.withColumn("applied", (F.col("kept_ms") > 0) & (F.col("saved_ms") >= need)).withColumn("saved_ratio", F.round(F.col("saved_ms") / F.greatest(F.lit(1), "duration_ms"), 6))


def map_to_source(points: DataFrame, mapped: DataFrame, key: str, width_ms: int = WIDTH_MS) -> DataFrame:
    """points (key, point_id, t_ms) back on the source timeline by the first map row that ends at or after t; past
    the last row, its end and what is over; without a map, unchanged. An as-of join as a union and a scan both ways."""
    row = F.struct("start_ms", "end_ms", "mapped_start_ms", "mapped_end_ms")
    m = mapped.select(key, F.col("mapped_end_ms").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("point_id"), row.alias("_row"))
    p = points.select(key, F.col("t_ms").alias("_t"), F.lit(0).alias("_kind"), "point_id", F.lit(None).cast(m.schema["_row"].dataType).alias("_row"))
    around = [Scan("_last", "last", F.col("_row")), Scan("_next", "last", F.col("_row"), reverse=True)]
    got = prefix_scan(m.unionByName(p), key, F.col("_t"), width_ms, ["_t", "_kind", "point_id"], around).where("_kind = 0")
    inside = F.col("_next.start_ms") + F.greatest(F.lit(0), F.least(F.col("_t") - F.col("_next.mapped_start_ms"), F.col("_next.end_ms") - F.col("_next.start_ms")))
    past = F.col("_last.end_ms") + F.col("_t") - F.col("_last.mapped_end_ms")
    return got.select(key, "point_id", F.col("_t").alias("t_ms"), F.coalesce(inside, past, "_t").cast("long").alias("source_ms"))


def sample_timestamps(start: Column, end: Column, apart: int = 180) -> Column:
    """Up to three probe times of a segment, each at least `apart` from those kept before it."""
    d = end - start
    first = start + F.least(F.lit(900), F.greatest(F.lit(120), F.floor(d * 0.35)))
    probes = F.array(first, start + F.floor(d * 0.65), F.greatest(start, end - 280)).cast("array<bigint>")
    far = lambda kept, x: F.forall(kept, lambda k: F.abs(k - x) >= apart)
    kept = F.aggregate(probes, F.array().cast("array<bigint>"), lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return F.when(end <= start, F.array(start)).otherwise(kept)


def locate_segment(points: DataFrame, segments: DataFrame, key: str, bucket_ms: int = 60_000, width_ms: int = WIDTH_MS) -> DataFrame:
    """The segment of each point: the first that contains it, else the latest that starts before, else the first.

    Where no segment of a key overlaps an earlier one, the as-of scan settles it. Points of other keys meet the
    segments that touch their bucket of time, by an equi-join on key and bucket."""
    s = segments.select(key, F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("point_id"), F.struct("segment_index", "start_ms", "end_ms").alias("_row"))
    p = points.select(key, F.col("t_ms").alias("_t"), F.lit(1).alias("_kind"), "point_id", F.lit(None).cast(s.schema["_row"].dataType).alias("_row"))
    # the segment that follows a point without one before it is the key's first
    around = [Scan("_asof", "last", F.col("_row")), Scan("_first", "last", F.col("_row"), reverse=True)]
    got = prefix_scan(s.unionByName(p), key, F.col("_t"), width_ms, ["_t", "_kind", "point_id", "_row"], around).where("_kind = 1")
    latest = got.select(key, "point_id", F.col("_t").alias("t_ms"), "_asof", "_first")
    # a segment before the latest one can only matter if it is still open: only then are they joined
    over = prefix_scan(segments.select(key, "segment_index", "start_ms", "end_ms"), key, F.col("start_ms"), width_ms, ["start_ms", "segment_index"], [Scan("_reach", "max", F.col("end_ms"))])
    tangled = over.where("_reach > start_ms").select(key).distinct()
    touched = segments.join(tangled, key, "left_semi").where("end_ms > start_ms").select(key, "segment_index", "start_ms", "end_ms", F.explode(F.expr(f"sequence(floor(start_ms / {bucket_ms}), floor((end_ms - 1) / {bucket_ms}))")).alias("_bucket"))
    knots = latest.withColumn("_bucket", F.floor(F.col("t_ms") / bucket_ms)).join(touched, [key, "_bucket"]).where("start_ms <= t_ms AND t_ms < end_ms")
    held = knots.groupBy(key, "point_id").agg(F.min_by("segment_index", F.struct("start_ms", "segment_index")).alias("_held"))
    return latest.join(held, [key, "point_id"], "left").select(key, "point_id", "t_ms", F.coalesce("_held", "_asof.segment_index", "_first.segment_index").alias("segment_index"))


def resolve_history_citations(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment that each stored citation (video_id, message_id, citation with a time range) points to, as a row
    with its times and text; citations without a range, or of videos without segments, give none."""
    c = messages.withColumn("_r", T.parse_time_range(F.col("citation"))).where("_r.start_ms IS NOT NULL")
    points = c.select("video_id", F.col("message_id").alias("point_id"), F.col("_r.start_ms").alias("t_ms"))
    at = locate_segment(points, segments, "video_id").where("segment_index IS NOT NULL").select("video_id", F.col("point_id").alias("message_id"), "segment_index")
    found = at.join(segments.select("video_id", "segment_index", F.col("id").alias("segment_id"), "start_ms", "end_ms", F.col("content").alias("snippet")), ["video_id", "segment_index"])
    ends = c.select("video_id", "message_id", "citation", F.col("_r.end_ms").alias("_end"))
    out = ends.join(found, ["video_id", "message_id"])
    return out.select("message_id", "video_id", "citation", "segment_id", "start_ms", F.coalesce(F.when(F.col("end_ms") != 0, F.col("end_ms")), "_end").alias("end_ms"), F.lit(0).cast("long").alias("score"), "snippet")


def silence_events(lines: DataFrame, key: str) -> DataFrame:
    """silence_start and silence_end marks of log lines (key, line_no, line), in order, starts before ends."""
    seconds = lambda name: F.transform(F.regexp_extract_all("line", F.lit(rf"{name}:\s*(-?\d+(?:\.\d+)?)"), 1), lambda x: F.greatest(F.lit(0), F.floor(x.cast("double") * 1000 + 0.5)).cast("long"))
    starts = lines.select(key, "line_no", F.lit(0).alias("kind"), F.posexplode(seconds("silence_start")).alias("pos", "ms"))
    ends = lines.select(key, "line_no", F.lit(1).alias("kind"), F.posexplode(seconds("silence_end")).alias("pos", "ms"))
    return starts.unionByName(ends)


def parse_silence_log(lines: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Silences: each end with the start just before it; a start left open ends with the source."""
    order = Window.partitionBy(key).orderBy("line_no", "kind", "pos")
    e = silence_events(lines, key).join(durations, key)
    e = e.withColumn("_prev", F.lag(F.struct("kind", "ms")).over(order)).withColumn("_next", F.lead("kind").over(order))
    closed = e.where("kind = 1 AND _prev.kind = 0").select(key, F.col("_prev.ms").alias("start_ms"), F.col("ms").alias("end_ms"))
    left = e.where("kind = 0 AND _next IS NULL").select(key, F.col("ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return closed.unionByName(left).where("end_ms > start_ms")
