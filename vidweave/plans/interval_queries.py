"""Queries of the interval and quality operators over the given tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.operators import intervals as I
from vidweave.operators import quality as Q
from vidweave.functions import text as T
from vidweave.sources import tables as S
from vidweave.sources.tables import table, with_ctes


#: Events lie over weeks: ranges of a week.
WEEK_MS = 7 * 86_400_000


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user as intervals whose length follows their value."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.lit(1704067200000)
    return table(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), ms.alias("start_ms"), (ms + F.floor(F.coalesce("value", F.lit(0.0)) * 40000).cast("long") + 1).alias("end_ms"))


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).groupBy("user_id").agg((F.max("start_ms") + 1000000).alias("duration_ms"))


_IV = """WITH iv AS (SELECT CAST(user_id AS BIGINT) AS user_id, epoch_us(ts) // 1000 - 1704067200000 AS start_ms, epoch_us(ts) // 1000 - 1704067200000 + CAST(floor(coalesce(value, 0) * 40000) AS BIGINT) + 1 AS end_ms FROM events),
du AS (SELECT user_id, max(start_ms) + 1000000 AS duration_ms FROM iv GROUP BY 1)"""


def _merged(src: str, gap: int, out: str) -> str:
    return f"""{out}_n AS (SELECT *, CASE WHEN start_ms > max(end_ms) OVER w + {gap} OR max(end_ms) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM {src} WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}_i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM {out}_n),
{out} AS (SELECT user_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM {out}_i GROUP BY user_id, island)"""


def e1_merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_intervals(_intervals(spark, d), "user_id", 80, WEEK_MS)


E1 = f"{_IV}, {_merged('iv', 80, 'mg')} SELECT * FROM mg"


def _speech(spark: SparkSession, d: str) -> DataFrame:
    return I.complement_intervals(I.merge_intervals(_intervals(spark, d), "user_id", 80, WEEK_MS), _durations(spark, d), "user_id", WEEK_MS)


def e2_complement_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _speech(spark, d)


_CO = f"""{_IV}, {_merged('iv', 80, 'mg')}, cl AS (SELECT user_id, greatest(0, start_ms) AS start_ms, least(end_ms, duration_ms) AS end_ms FROM mg JOIN du USING (user_id) UNION ALL SELECT user_id, duration_ms, duration_ms FROM du),
cu AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM cl),
sp AS (SELECT user_id, f AS start_ms, start_ms AS end_ms FROM cu WHERE start_ms > f)"""
E2 = f"{_CO} SELECT * FROM sp"


def _padded(spark: SparkSession, d: str) -> DataFrame:
    return I.pad_and_merge(_speech(spark, d), _durations(spark, d), "user_id", width_ms=WEEK_MS)


def e3_pad_and_merge(spark: SparkSession, d: str) -> DataFrame:
    return _padded(spark, d)


_PA = f"{_CO}, pd AS (SELECT user_id, greatest(0, start_ms - 120) AS start_ms, least(end_ms + 120, duration_ms) AS end_ms FROM sp JOIN du USING (user_id)), pf AS (SELECT * FROM pd WHERE end_ms - start_ms >= 200), {_merged('pf', 80, 'pm')}"
E3 = f"{_PA} SELECT * FROM pm"


def e4_cumulative_map(spark: SparkSession, d: str) -> DataFrame:
    return I.cumulative_map(_padded(spark, d), "user_id", WEEK_MS)


_CM = f"{_PA}, cm AS (SELECT *, CAST(sum(end_ms - start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mapped_end_ms FROM pm), mp AS (SELECT user_id, start_ms, end_ms, mapped_end_ms - (end_ms - start_ms) AS mapped_start_ms, mapped_end_ms FROM cm)"
E4 = f"{_CM} SELECT * FROM mp"


def e5_vad_gain_gate(spark: SparkSession, d: str) -> DataFrame:
    return I.gain_gate(_padded(spark, d), _durations(spark, d), "user_id").select("user_id", "kept_ms", "saved_ms", "applied", "saved_ratio")


E5 = f"""{_PA} SELECT user_id, k AS kept_ms, duration_ms - k AS saved_ms, k > 0 AND duration_ms - k >= greatest(1000, floor(duration_ms * 0.08 + 0.5)) AS applied, round((duration_ms - k) / greatest(1, duration_ms), 6) AS saved_ratio
FROM (SELECT user_id, duration_ms, CAST(coalesce(sum(end_ms - start_ms), 0) AS BIGINT) AS k FROM du LEFT JOIN pm USING (user_id) GROUP BY ALL)"""


def e6_map_to_source_timeline(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "orders").select((F.col("o_custkey") % 1000).cast("long").alias("user_id"), F.col("o_orderkey").cast("long").alias("point_id"), (F.col("o_totalprice") * 9000).cast("long").alias("t_ms"))
    return I.map_to_source(points, I.cumulative_map(_padded(spark, d), "user_id", WEEK_MS), "user_id", WEEK_MS)


E6 = f"""{_CM}, p AS (SELECT CAST(o_custkey % 1000 AS BIGINT) AS user_id, CAST(o_orderkey AS BIGINT) AS point_id, CAST(floor(o_totalprice * 9000) AS BIGINT) AS t_ms FROM orders),
j AS (SELECT p.*, (SELECT arg_min((m.start_ms, m.end_ms, m.mapped_start_ms), m.mapped_end_ms) FROM mp m WHERE m.user_id = p.user_id AND m.mapped_end_ms >= p.t_ms) AS a, (SELECT arg_max((m.end_ms, m.mapped_end_ms), m.mapped_end_ms) FROM mp m WHERE m.user_id = p.user_id) AS z FROM p)
SELECT user_id, point_id, t_ms, CAST(coalesce(a[1] + greatest(0, least(t_ms - a[3], a[2] - a[1])), z[1] + t_ms - z[2], t_ms) AS BIGINT) AS source_ms FROM j"""


def e7_sample_timestamps(spark: SparkSession, d: str) -> DataFrame:
    s = S.segments(spark, d)
    end = F.col("start_ms") + F.length("content") * 13 - 300
    return s.select("id", F.explode(I.sample_timestamps(F.col("start_ms"), end)).alias("t_ms"))


E7 = with_ctes("segments") + """, p AS (SELECT id, start_ms AS s, start_ms + length(content) * 13 - 300 AS e FROM segments),
q AS (SELECT id, s, e, s + least(900, greatest(120, CAST(floor((e - s) * 0.35) AS BIGINT))) AS a, s + CAST(floor((e - s) * 0.65) AS BIGINT) AS b, greatest(s, e - 280) AS c FROM p),
k AS (SELECT *, abs(a - b) >= 180 AS has_b FROM q)
SELECT id, unnest(CASE WHEN e <= s THEN [s] ELSE list_filter([a, CASE WHEN has_b THEN b END, CASE WHEN abs(a - c) >= 180 AND (NOT has_b OR abs(b - c) >= 180) THEN c END], lambda x: x IS NOT NULL) END) AS t_ms FROM k"""


def a3_parse_silence_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as the lines of a log: clicks begin a silence, views end one, purchases do both."""
    seconds = F.format_string("%.3f", (F.unix_millis(F.col("ts").cast("timestamp")) - F.lit(1704067200000)) / 1000)
    begin, end = F.concat(F.lit("silence_start: "), seconds), F.concat(F.lit("silence_end: "), seconds)
    line = F.when(F.col("event_type") == "click", begin).when(F.col("event_type") == "view", end).when(F.col("event_type") == "purchase", F.concat(end, F.lit(" | "), begin)).otherwise("frame")
    lines = table(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("line_no"), line.alias("line"))
    return I.parse_silence_log(lines, _durations(spark, d), "user_id")


A3 = _IV + """, ev AS (SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS line_no, event_type AS t, greatest(0, epoch_us(ts) // 1000 - 1704067200000) AS ms FROM events),
e AS (SELECT user_id, line_no, 0 AS kind, ms FROM ev WHERE t IN ('click', 'purchase') UNION ALL SELECT user_id, line_no, 1, ms FROM ev WHERE t IN ('view', 'purchase')),
o AS (SELECT *, lag(kind) OVER w AS pk, lag(ms) OVER w AS pm, lead(kind) OVER w AS nk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY line_no, kind)),
r AS (SELECT user_id, pm AS start_ms, ms AS end_ms FROM o WHERE kind = 1 AND pk = 0 UNION ALL SELECT user_id, ms, duration_ms FROM o JOIN du USING (user_id) WHERE kind = 0 AND nk IS NULL)
SELECT user_id, start_ms, end_ms FROM r WHERE end_ms > start_ms"""


def d12_locate_segment(spark: SparkSession, d: str) -> DataFrame:
    points = S.videos(spark, d).select("video_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("video_id", F.col("k").cast("long").alias("point_id"), (F.col("k") * 2777 + F.col("video_id") % 1000).alias("t_ms"))
    return I.locate_segment(points, S.segments(spark, d), "video_id")


D12 = with_ctes("segments") + """, p AS (SELECT doc_id AS video_id, CAST(k AS BIGINT) AS point_id, k * 2777 + doc_id % 1000 AS t_ms FROM documents, range(5) r(k))
SELECT video_id, point_id, t_ms, coalesce((SELECT arg_min(segment_index, start_ms) FROM segments s WHERE s.video_id = p.video_id AND start_ms <= t_ms AND t_ms < end_ms), (SELECT arg_max(segment_index, start_ms) FROM segments s WHERE s.video_id = p.video_id AND start_ms <= t_ms),
(SELECT arg_min(segment_index, start_ms) FROM segments s WHERE s.video_id = p.video_id)) AS segment_index FROM p"""


def d13_resolve_history_citation(spark: SparkSession, d: str) -> DataFrame:
    """Every segment cited by its times in its label, and messages without a time."""
    s = S.segments(spark, d)
    label = F.when(F.col("segment_index") % 4 == 3, "no time").otherwise(F.concat(F.lit("doc "), T.format_time(F.col("start_ms")), F.lit("-"), T.format_time(F.col("end_ms"))))
    m = s.select("video_id", F.col("id").alias("message_id"), label.alias("citation"))
    return I.resolve_history_citations(m, s).select("message_id", "video_id", "segment_id", "start_ms", "end_ms", F.md5("snippet").alias("snippet_md5"))


D13 = with_ctes("segments") + "SELECT id AS message_id, video_id, id AS segment_id, start_ms, end_ms, md5(content) AS snippet_md5 FROM segments WHERE segment_index % 4 <> 3"


def f1_systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return Q.systematic_sample(S.segments(spark, d), 4).select("video_id", "segment_index")


F1 = with_ctes("segments") + """, r AS (SELECT video_id, segment_index, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) - 1 AS r, count(*) OVER (PARTITION BY video_id) AS n FROM segments)
SELECT video_id, segment_index FROM r WHERE n <= 4 OR r IN (0, n // 4, 2 * n // 4, 3 * n // 4)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring lines of a document, whole, as spoken and seen text."""
    s = S.segments(spark, d)
    n = s.select("video_id", (F.col("segment_index") - 1).alias("segment_index"), F.col("content").alias("ocr"))
    return s.select("video_id", "segment_index", F.col("content").alias("asr")).join(n, ["video_id", "segment_index"])


# DuckDB's distance counts bytes: the tables' lower-case letters beyond ASCII become capitals, which no lower-cased text holds
_PAIRS = with_ctes("segments") + r""", p AS (SELECT s.video_id, s.segment_index, s.content AS asr, n.content AS ocr FROM segments s JOIN segments n ON n.video_id = s.video_id AND n.segment_index = s.segment_index + 1),
c AS (SELECT *, translate(lower(regexp_replace(asr, '[ \t\n\x0B\f\r]+', '', 'g')), 'äçèéêíñóöüß', 'ABCDEFGHIJK') AS h, translate(lower(regexp_replace(ocr, '[ \t\n\x0B\f\r]+', '', 'g')), 'äçèéêíñóöüß', 'ABCDEFGHIJK') AS r FROM p),
e AS (SELECT *, CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0.0 ELSE 1.0 END ELSE least(1.0, levenshtein(h, r) / length(r)) END AS cer FROM c)"""


def f2_cer(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("video_id", "segment_index", F.round(Q.cer(F.col("asr"), F.col("ocr")), 6).alias("cer"))


F2 = _PAIRS + " SELECT video_id, segment_index, round(CAST(cer AS DOUBLE), 6) AS cer FROM e"


def f3_fuse_text(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("confidence", F.lit(0.9) + (F.col("segment_index") % 11) / 100)
    return Q.fuse_texts(p, list(Q.FUSION_MODES)).select("video_id", "segment_index", *[F.md5(f"fused_{m.lower()}").alias(m.lower()) for m in Q.FUSION_MODES])


def f4_fusion_report(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).withColumn("available", F.col("segment_index") % 3 != 0).withColumn("fused", F.when(F.col("segment_index") % 2 == 0, F.col("ocr")).otherwise(F.col("asr")))
    return Q.fusion_report(p)


F4 = _PAIRS + """, g AS (SELECT video_id, count(*) AS sampled, count(*) FILTER (WHERE segment_index % 3 <> 0) AS hits, count(*) FILTER (WHERE segment_index % 3 <> 0 AND segment_index % 2 = 0 AND ocr <> asr) AS replacements,
avg(CAST(cer AS DOUBLE)) FILTER (WHERE segment_index % 3 <> 0) AS c, avg(CASE WHEN segment_index % 2 = 0 THEN 0.0 ELSE CAST(cer AS DOUBLE) END) FILTER (WHERE segment_index % 3 <> 0) AS f FROM e GROUP BY 1)
SELECT video_id, sampled, hits, replacements, floor(coalesce(c, 1.0) * 10000 + 0.5) / 10000 AS cer, floor((1 - coalesce(c, 1.0)) * 10000 + 0.5) / 10000 AS similarity, floor(coalesce(f, 1.0) * 10000 + 0.5) / 10000 AS fused_cer, floor((1 - coalesce(f, 1.0)) * 10000 + 0.5) / 10000 AS fused_similarity FROM g"""


def f5_apply_fusion(spark: SparkSession, d: str) -> DataFrame:
    r = _pairs(spark, d).where("segment_index % 4 = 0").select("video_id", "segment_index", F.col("ocr").alias("text"))
    return Q.apply_fusion(S.segments(spark, d), r).select("id", "applied", F.md5("content").alias("content_md5"))


F5 = _PAIRS + " SELECT id, ocr IS NOT NULL AS applied, md5(coalesce(ocr, content)) AS content_md5 FROM segments s LEFT JOIN (SELECT video_id, segment_index, ocr FROM p WHERE segment_index % 4 = 0) q ON q.video_id = s.video_id AND q.segment_index = s.segment_index"


def f7_asr_quality_sample(spark: SparkSession, d: str) -> DataFrame:
    return Q.leading_text(S.segments(spark, d)).select("video_id", "n_segments", F.length("preview").cast("long").alias("preview_length"))


F7 = with_ctes("segments") + r""", b AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY video_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM segments),
g AS (SELECT video_id, count(*) AS n_segments, trim(regexp_replace(string_agg(content, ' ' ORDER BY segment_index), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM b WHERE p < 600 GROUP BY 1)
SELECT video_id, n_segments, CASE WHEN length(t) >= 12 AND len(regexp_extract_all(t, '[ÃÂåæçèéð]')) > 6 THEN 0 ELSE least(160, length(t)) END AS preview_length FROM g"""


def f8_prompt_transcript(spark: SparkSession, d: str) -> DataFrame:
    return Q.prompt_transcript(S.segments(spark, d), 1500).select("video_id", "segment_index", F.md5("line").alias("line_md5"))


F8 = with_ctes("segments") + r""", l AS (SELECT video_id, segment_index, printf('[%02d:%02d-%02d:%02d] ', start_ms // 60000, start_ms // 1000 % 60, end_ms // 60000, end_ms // 1000 % 60) || trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM segments)
SELECT video_id, segment_index, md5(line) AS line_md5 FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY video_id ORDER BY segment_index ROWS UNBOUNDED PRECEDING) AS t FROM l) WHERE t <= 1500"""

QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "aedf" and k[1:2].isdigit()}
ORACLES = {k: globals()[o] for k in QUERIES if (o := k.split("_")[0].upper()) in globals()}
