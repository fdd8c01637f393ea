"""Transcripts that change in whole batches: edits, fused texts, restored versions, and a manifest of what is current.

A store is a folder. A batch writes the shards that it touches, a snapshot of every video that it touches, the log of
these snapshots, the list of stale videos and its outcomes to a new folder, and at last a manifest that names them. The
manifest of the highest number is the current state. So a batch shows whole or not at all, a reader keeps the state it
began with, and a batch that dies half-way leaves only files that nothing names. A batch has a name: one that the
manifest lists already changes nothing when it is run again. Of two writers that start from one state only one can
publish; the other gets an error and may run again. The folder's file system must rename atomically.

Segments are sharded by video; Spark splits the files of a large shard and deals rows by size when it writes them, so a
hot video is in many tasks. A snapshot is rows, not one text a video. The driver sees shard numbers and folder names
only: the manifest grows with shards and batches, not with rows.

Rows without a video or an id stay as they are; a change of an id or place that repeats falls on all its rows. Extra
columns of the segments are kept; token_count is set here and _shard is taken."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vidweave.functions import text as T
from vidweave.sources.storage import stored

from .documents import ocr_evidence_terms

LOG = "video_id long, version_no long, source string, note string, n_segments long, batch string"
STALE = "video_id long, batch string"
#: Where a snapshot comes from, and the longest note.
EDITED, FUSED, RESTORED = "MANUAL_EDIT", "OCR_FUSION", "RESTORE_BACKUP"
MOST_NOTE = 255


@dataclass(frozen=True)
class State:
    """What a manifest says: the folder of each shard, and of each batch."""

    path: str
    schema: str
    shards: int
    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, str] = field(default_factory=dict)


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("video_id"), F.lit(n)).cast("int").alias("_shard")


def _read(spark: SparkSession, paths: list[str], schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, state: State) -> State:
    """Writes the manifest beside its place and renames it, which fails where another one has its number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{state.path}/manifests/{name}")
    aside, final = place(f".{uuid.uuid4().hex}"), place(f"{state.number:09d}.json")
    stream = final.getFileSystem(conf).create(aside, True)
    stream.write(bytearray(json.dumps({k: v for k, v in vars(state).items() if k != "path"}).encode()))
    stream.close()
    try:
        plain = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(aside, final, plain)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        raise RuntimeError(f"manifest {state.number} of {state.path} is there already: another batch was first") from e
    return state


def current(spark: SparkSession, path: str) -> State:
    """The state that the last manifest names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    last = max(n for n in names if n[0] != "." and n.endswith(".json"))
    return State(path=path, **json.loads(spark.read.text(f"{path}/manifests/{last}", wholetext=True).first()[0]))


def _schema(state: State) -> StructType:
    return StructType.fromJson(json.loads(state.schema))


def segments(spark: SparkSession, state: State) -> DataFrame:
    return _read(spark, sorted(state.folders.values()), _schema(state))


def _of_batches(spark: SparkSession, state: State, part: str, schema: str | StructType) -> DataFrame:
    return _read(spark, [f"{folder}/{part}" for folder in state.batches.values()], schema)


def version_log(spark: SparkSession, state: State) -> DataFrame:
    """A row for each snapshot; version numbers rise by one in a video."""
    return _of_batches(spark, state, "log", LOG)


def snapshots(spark: SparkSession, state: State) -> DataFrame:
    """The segments of each version, as they were before the batch that made it."""
    return _of_batches(spark, state, "snapshot", _schema(state).add("version_no", "long"))


def stale_videos(spark: SparkSession, state: State) -> DataFrame:
    """The videos whose summaries, index entries and cached answers a batch has outdated."""
    return _of_batches(spark, state, "stale", STALE)


def outcomes(spark: SparkSession, state: State, batch: str) -> DataFrame:
    return spark.read.parquet(f"{state.batches[batch]}/outcomes")


def _write_shards(rows: DataFrame, path: str) -> dict[str, str]:
    """Rows (with _shard) by shard; the folder of each shard that has any."""
    rows.hint("rebalance", "_shard").write.partitionBy("_shard").option("compression", "zstd").parquet(path)
    there = rows.sparkSession.read.schema(rows.schema).parquet(path).select("_shard").distinct()
    return {str(r[0]): f"{path}/_shard={r[0]}" for r in there.collect()}  # at most all shards


def create(df: DataFrame, path: str, shards: int = 8) -> State:
    """A store of segments (id, video_id, segment_index, start_ms, end_ms, content)."""
    df = df.withColumn("token_count", T.token_count(F.coalesce("content", F.lit(""))))
    folders = _write_shards(df.select("*", _shard(shards)), f"{path}/data/{uuid.uuid4().hex}")
    return _publish(df.sparkSession, State(path, df.schema.json(), shards, 0, folders))


@dataclass(frozen=True)
class _Change:
    """touched: video_id and note; rows: the touched videos' segments as they will be; stale: video_id."""

    touched: DataFrame
    rows: DataFrame
    stale: DataFrame
    outcomes: DataFrame


def _apply(spark: SparkSession, path: str, batch: str, source: str, change: Callable[[State, DataFrame], _Change]) -> State:
    state = current(spark, path)
    if batch in state.batches:
        return state
    now = segments(spark, state)
    c = change(state, now)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    touched = stored(c.touched.select("video_id", F.substring("note", 1, MOST_NOTE).alias("note")), "versions-touched")
    keys = touched.select("video_id")
    hit = [str(r[0]) for r in keys.select(_shard(state.shards)).distinct().collect()]  # at most all shards
    old = _read(spark, [state.folders[s] for s in hit if s in state.folders], now.schema)
    before = old.join(keys, "video_id", "left_semi")
    last = version_log(spark, state).groupBy("video_id").agg(F.max("version_no").alias("_last"))
    counts = before.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_segments"))
    number = (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("version_no")
    log = touched.join(counts, "video_id").join(last, "video_id", "left").select("video_id", number, F.lit(source).alias("source"), "note", "n_segments", F.lit(batch).alias("batch"))
    log.write.parquet(f"{folder}/log")
    numbers = spark.read.schema(LOG).parquet(f"{folder}/log").select("video_id", "version_no")
    before.join(numbers, "video_id").select(*now.columns, "version_no").write.option("compression", "zstd").parquet(f"{folder}/snapshot")
    rest = old.join(keys, "video_id", "left_anti")
    new = _write_shards(rest.unionByName(c.rows.select(now.columns)).select("*", _shard(state.shards)), f"{folder}/segments") if hit else {}
    c.stale.select("video_id", F.lit(batch).alias("batch")).write.parquet(f"{folder}/stale")
    c.outcomes.write.parquet(f"{folder}/outcomes")
    kept = {s: f for s, f in state.folders.items() if s not in hit}
    return _publish(spark, State(path, state.schema, state.shards, state.number + 1, {**kept, **new}, {**state.batches, batch: folder}))


def _last_of(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One text for each key: the one of the highest seq, if there is such a column, then the greatest."""
    order = F.struct("seq", "text") if "seq" in df.columns else F.struct("text")
    return df.dropna(subset=keys).groupBy(*keys).agg(F.max_by("text", order).alias("text")).select(*keys, text.alias("_text"))


def edit(spark: SparkSession, path: str, batch: str, edits: DataFrame, glossary: list[tuple[str, str]] | None = None) -> State:
    """edits (id, text, and seq if an id may come twice) through the glossary. Outcome of each id: missing, blank,
    unchanged or applied; a video with an applied one gets a snapshot and is stale."""

    def change(state: State, now: DataFrame) -> _Change:
        e = stored(_last_of(edits, ["id"], T.apply_glossary(F.col("text"), glossary or [])), "versions-edits")
        applied = (F.col("_text") != "") & ~F.col("_text").eqNullSafe(F.col("content"))
        found = stored(now.select("id", "video_id", "segment_index", "content").join(e, "id").select("id", "video_id", "segment_index", applied.alias("applied")), "versions-found")
        per_id = found.groupBy("id").agg(F.max("applied").alias("applied"))
        outcome = F.when(F.col("applied").isNull(), "missing").when(F.col("_text") == "", "blank").when(F.col("applied"), "applied").otherwise("unchanged")
        n, first = F.count(F.lit(1)), F.min("segment_index").cast("string")
        note = F.when(n == 1, F.concat(F.lit("Before editing segment #"), first)).otherwise(F.concat(F.lit("Before editing "), n.cast("string"), F.lit(" segments")))
        touched = stored(found.where("applied AND video_id IS NOT NULL").groupBy("video_id").agg(note.alias("note")), "versions-edited")
        mine = now.join(touched.select("video_id"), "video_id", "left_semi").join(e, "id", "left")
        content = F.when(applied, F.col("_text")).otherwise(F.col("content"))
        rows = mine.withColumn("token_count", F.when(applied, T.token_count(F.col("_text"))).otherwise(F.col("token_count"))).withColumn("content", content)
        return _Change(touched, rows, touched, e.join(per_id, "id", "left").select("id", outcome.alias("outcome")))

    return _apply(spark, path, batch, EDITED, change)


def fuse(spark: SparkSession, path: str, batch: str, replacements: DataFrame, mode: str, glossary: list[tuple[str, str]] | None = None, seen: DataFrame | None = None, terms: list[tuple[str, str]] | None = None) -> State:
    """replacements (video_id, segment_index, text, and seq if a place may come twice) go into their places; then the
    terms that seen (video_id, ocr) gives evidence for, then the glossary, over all segments of the videos named. A
    text that is blank when clean changes nothing. Every video named gets a snapshot; those with a change are stale.
    Outcomes: by video, how many segments each step has set."""
    glossary = glossary or []

    def change(state: State, now: DataFrame) -> _Change:
        clean = T.normalize_transcript(T.apply_glossary(F.col("text"), glossary), terms)
        r = stored(_last_of(replacements, ["video_id", "segment_index"], clean), "versions-fused")
        named = r.select("video_id").distinct().withColumn("note", F.lit(f"Before {mode}"))
        mine = now.join(named.select("video_id"), "video_id", "left_semi").join(r, ["video_id", "segment_index"], "left")
        put = F.coalesce(F.col("_text") != "", F.lit(False))
        one = stored(mine.withColumn("_put", put).withColumn("content", F.when(put, F.col("_text")).otherwise(F.col("content"))).drop("_text"), "versions-put")

        def step(df: DataFrame, flag: str) -> DataFrame:
            """The texts of _next that are not blank and new take the place of content."""
            hit = F.coalesce((F.col("_next") != "") & ~F.col("_next").eqNullSafe(F.col("content")), F.lit(False))
            return df.withColumn(flag, hit).withColumn("content", F.when(F.col(flag), F.col("_next")).otherwise(F.col("content"))).drop("_next")

        two = one.withColumn("_seen", F.lit(False))
        if seen is not None:
            two = step(ocr_evidence_terms(one.withColumn("_plain", F.col("content")), seen).withColumnRenamed("content", "_next").withColumnRenamed("_plain", "content"), "_seen")
        done = stored(step(two.withColumn("_next", T.apply_glossary(F.col("content"), glossary)), "_glossed"), "versions-glossed")
        count = lambda c: F.count(F.when(F.col(c), 1))
        counts = stored(done.groupBy("video_id").agg(count("_put").alias("fused"), count("_seen").alias("evidence"), count("_glossed").alias("glossary")), "versions-counts")
        changed = F.col("_put") | F.col("_seen") | F.col("_glossed")
        rows = done.withColumn("token_count", F.when(changed, T.token_count(F.col("content"))).otherwise(F.col("token_count")))
        return _Change(named, rows, counts.where("fused + evidence + glossary > 0"), counts)

    return _apply(spark, path, batch, FUSED, change)


def restore(spark: SparkSession, path: str, batch: str, choices: DataFrame, terms: list[tuple[str, str]] | None = None) -> State:
    """The segments of each chosen version (video_id, version_no; of several of a video the highest) become the video's
    segments, their texts normalised, their token counts those of the snapshot's texts. Outcomes: restored, or missing
    for a version that is not there."""

    def change(state: State, now: DataFrame) -> _Change:
        c = stored(choices.dropna(subset=["video_id"]).groupBy("video_id").agg(F.max("version_no").cast("long").alias("version_no")), "versions-chosen")
        snap = snapshots(spark, state).join(c, ["video_id", "version_no"], "left_semi")
        note = F.concat(F.lit("Before restoring version v"), F.col("version_no").cast("string"))
        found = stored(c.join(version_log(spark, state), ["video_id", "version_no"], "left_semi").withColumn("note", note), "versions-restored")
        rows = snap.withColumn("token_count", T.token_count(F.coalesce("content", F.lit("")))).withColumn("content", T.normalize_transcript(F.col("content"), terms))
        known = c.join(found.select("video_id", F.lit(True).alias("_there")), "video_id", "left")
        return _Change(found, rows, found, known.select("video_id", "version_no", F.when(F.col("_there"), "restored").otherwise("missing").alias("outcome")))

    return _apply(spark, path, batch, RESTORED, change)
