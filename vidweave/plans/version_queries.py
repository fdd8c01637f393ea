"""Queries of the versioned change sets over the given tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidweave.operators import versions as V
from vidweave.sources import tables as S
from vidweave.sources.storage import new_path
from vidweave.sources.tables import with_ctes

from .text_queries import _NORM, _RISK

#: A word part that occurs in the given texts.
GLOSSARY = [("erth", "Erth")]


def _fused(spark: SparkSession, d: str) -> str:
    """A store in which every fourth line has become its next one, in videos that are not of every fifth id."""
    s = S.segments(spark, d)
    path = new_path(spark, "transcripts")
    V.create(s, path)
    n = s.where("segment_index % 4 = 1 AND video_id % 5 <> 0").select("video_id", (F.col("segment_index") - 1).alias("segment_index"), F.col("content").alias("text"))
    V.fuse(spark, path, "fusion", n, "CONSERVATIVE", GLOSSARY, terms=[])
    return path


def _edited(spark: SparkSession, d: str) -> str:
    path = _fused(spark, d)
    k = F.col("id")
    text = F.when(k % 2 == 0, F.concat("content", F.lit("  (edited)"))).when(k % 5 == 0, F.lit("  ")).otherwise(F.col("content"))
    edits = S.segments(spark, d).where("id % 3 = 0 AND video_id % 2 = 0").select("id", text.alias("text"))
    for _ in range(2):  # the repeat changes nothing
        V.edit(spark, path, "edits", edits, GLOSSARY)
    return path


def _restored(spark: SparkSession, d: str) -> str:
    path = _edited(spark, d)
    V.restore(spark, path, "restore", S.videos(spark, d).where("video_id % 3 = 0").select("video_id", F.lit(1).alias("version_no")), terms=[])
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return V.segments(spark, V.current(spark, path)).select("id", F.md5("content").alias("content_md5"), "token_count")


def f5_fusion_change_set(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, _fused(spark, d))


def g29_edit_change_set(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, _edited(spark, d))


def g28_restore_change_set(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, _restored(spark, d))


def g25_version_log(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots of all three batches, and whether the video was stale after them."""
    state = V.current(spark, _restored(spark, d))
    stale = V.stale_videos(spark, state).withColumn("stale", F.lit(True))
    log = V.version_log(spark, state).join(stale, ["video_id", "batch"], "left")
    return log.select("video_id", "version_no", "source", "note", "n_segments", F.coalesce("stale", F.lit(False)).alias("stale"))


def _steps(name: str, source: str, column: str, gloss: bool = True) -> str:
    """Steps that end in name, source with `{name}_x`: the column normalised and put through the glossary."""
    x = f"{name}_n"
    plain = f"translate(CASE WHEN {_RISK.format(x)} THEN '' ELSE {x} END, '妳祢', '你你')"
    return f"{name}0 AS (SELECT *, {_NORM.format(column)} AS {x} FROM {source}), {name} AS (SELECT *, " + (f"regexp_replace({plain}, '(?i)erth', 'Erth', 'g')" if gloss else plain) + f" AS {name}_x FROM {name}0)"


_COUNT = lambda c: f"greatest(1, length({c}) // 2)"
_FUSED = with_ctes("segments") + f""", j AS (SELECT s.*, n.content AS other, bool_or(n.id IS NOT NULL) OVER (PARTITION BY s.video_id) OR EXISTS (SELECT 1 FROM segments o WHERE o.video_id = s.video_id AND o.segment_index % 4 = 1 AND s.video_id % 5 <> 0) AS named
FROM segments s LEFT JOIN segments n ON n.video_id = s.video_id AND n.segment_index = s.segment_index + 1 AND n.segment_index % 4 = 1 AND n.video_id % 5 <> 0),
{_steps('ra', 'j', "coalesce(other, '')")}, rb AS (SELECT * EXCLUDE (content), content AS original, ra_x <> '' AS put, CASE WHEN ra_x <> '' THEN ra_x ELSE content END AS t FROM ra),
{_steps('rc', 'rb', 't')}, fused AS (SELECT id, video_id, segment_index, original, named, put OR (rc_x <> '' AND rc_x <> t) AS hit, CASE WHEN named AND rc_x <> '' THEN rc_x ELSE t END AS content FROM rc)"""
F5 = _FUSED + f" SELECT id, md5(content) AS content_md5, {_COUNT('content')} AS token_count FROM fused"
_EDITED = _FUSED + f""", ea AS (SELECT *, id % 3 = 0 AND video_id % 2 = 0 AS asked, CASE WHEN id % 2 = 0 THEN original || '  (edited)' WHEN id % 5 = 0 THEN '  ' ELSE original END AS w FROM fused), {_steps('eb', 'ea', 'w')},
edited AS (SELECT id, video_id, segment_index, original, named, hit, asked AND eb_x <> '' AND eb_x <> content AS applied, CASE WHEN asked AND eb_x <> '' THEN eb_x ELSE content END AS content FROM eb)"""
G29 = _EDITED + f" SELECT id, md5(content) AS content_md5, {_COUNT('content')} AS token_count FROM edited"
_RESTORED = _EDITED + f""", v AS (SELECT *, named OR bool_or(applied) OVER (PARTITION BY video_id) AS has FROM edited), {_steps('rs', 'v', 'original', gloss=False)}"""
G28 = _RESTORED + f" SELECT id, md5(CASE WHEN has AND video_id % 3 = 0 THEN rs_x ELSE content END) AS content_md5, {_COUNT('CASE WHEN has AND video_id % 3 = 0 THEN original ELSE content END')} AS token_count FROM rs"
G25 = _EDITED + """, p AS (SELECT video_id, count(*) AS n_segments, bool_or(named) AS named, bool_or(named AND hit) AS hit, count(*) FILTER (WHERE applied) AS n, min(segment_index) FILTER (WHERE applied) AS i FROM edited GROUP BY 1)
SELECT video_id, CAST(1 AS BIGINT) AS version_no, 'OCR_FUSION' AS source, 'Before CONSERVATIVE' AS note, n_segments, hit AS stale FROM p WHERE named
UNION ALL SELECT video_id, 1 + named::BIGINT, 'MANUAL_EDIT', CASE WHEN n = 1 THEN 'Before editing segment #' || i ELSE 'Before editing ' || n || ' segments' END, n_segments, true FROM p WHERE n > 0
UNION ALL SELECT video_id, 1 + named::BIGINT + (n > 0)::BIGINT, 'RESTORE_BACKUP', 'Before restoring version v1', n_segments, true FROM p WHERE (named OR n > 0) AND video_id % 3 = 0"""

QUERIES = {f.__name__: f for f in (f5_fusion_change_set, g25_version_log, g28_restore_change_set, g29_edit_change_set)}
ORACLES = {k: globals()[k.split("_")[0].upper()] for k in QUERIES}
