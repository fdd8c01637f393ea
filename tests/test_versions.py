"""Change sets of transcripts: repeats, outcomes, restores, lost batches, two writers."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from vidweave.operators import versions as V

SEGMENT = "id long, video_id long, segment_index long, start_ms long, end_ms long, content string, speaker string"


@pytest.fixture
def store(spark, tmp_path):
    texts = [(1, 1, 0, "one"), (2, 1, 1, "two"), (3, 2, 0, "three"), (4, 3, 0, None), (None, 3, 1, "no id"), (6, None, 0, "no video"), (7, 4, 0, "copy"), (7, 4, 0, "copy")]
    rows = [(i, v, k, k * 1000, k * 1000 + 1000, t, "s") for i, v, k, t in texts]
    V.create(spark.createDataFrame(rows, SEGMENT), str(tmp_path), shards=3)
    return str(tmp_path)


def texts(spark, path):
    return sorted(((r["id"], r["content"], r["token_count"]) for r in V.segments(spark, V.current(spark, path)).collect()), key=str)


def log(spark, path):
    return {(r["video_id"], r["version_no"]): (r["source"], r["note"], r["n_segments"]) for r in V.version_log(spark, V.current(spark, path)).collect()}


def edits(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, seq long")


def test_edits_make_one_change_set(spark, store):
    before = texts(spark, store)
    batch = edits(spark, [(1, "old", 1), (1, " uno ", 2), (2, "dos", 1), (3, "three", 1), (4, "  ", 1), (6, "stray", 1), (7, "pair", 1), (99, "x", 1), (None, "x", 1)])
    V.edit(spark, store, "a", batch, [("dos", "DOS")])
    after = dict((i, (t, n)) for i, t, n in texts(spark, store))
    assert after[1] == ("uno", 1) and after[2] == ("DOS", 1) and after[3] == ("three", 2) and after[4] == (None, 1) and after[6][0] == "no video" and after[7] == ("pair", 2)
    assert len(texts(spark, store)) == len(before)
    state = V.current(spark, store)
    got = {r["id"]: r["outcome"] for r in V.outcomes(spark, state, "a").collect()}
    assert got == {1: "applied", 2: "applied", 3: "unchanged", 4: "blank", 6: "applied", 7: "applied", 99: "missing"}
    assert log(spark, store) == {(1, 1): ("MANUAL_EDIT", "Before editing 2 segments", 2), (4, 1): ("MANUAL_EDIT", "Before editing 2 segments", 2)}
    assert {r["video_id"] for r in V.stale_videos(spark, state).collect()} == {1, 4}
    # again: nothing changes, nothing is written
    assert V.edit(spark, store, "a", batch) == state == V.current(spark, store)
    V.restore(spark, store, "back", spark.createDataFrame([(1, 1), (4, 1), (2, 1), (9, 3)], "video_id long, version_no long"), terms=[])
    assert texts(spark, store) == before
    assert log(spark, store)[1, 2] == ("RESTORE_BACKUP", "Before restoring version v1", 2)
    assert {r["video_id"]: r["outcome"] for r in V.outcomes(spark, V.current(spark, store), "back").collect()} == {1: "restored", 4: "restored", 2: "missing", 9: "missing"}
    V.restore(spark, store, "forth", spark.createDataFrame([(1, 2)], "video_id long, version_no long"), terms=[])
    assert dict((i, t) for i, t, _ in texts(spark, store))[1] == "uno"
    assert V.segments(spark, V.current(spark, store)).where("speaker = 's'").count() == len(before)


def test_fusion_counts_and_evidence(spark, store):
    r = spark.createDataFrame([(1, 0, "seen  words"), (1, 1, " "), (3, 0, "filled"), (8, 0, "nobody")], "video_id long, segment_index long, text string")
    seen = spark.createDataFrame([(2, "agent"), (1, "the skill list")], "video_id long, ocr string")
    V.edit(spark, store, "skil", edits(spark, [(2, "skil two", 1)]))
    V.fuse(spark, store, "f", r, "STRONG_VISUAL", [("words", "WORDS")], seen, terms=[])
    after = dict((i, t) for i, t, _ in texts(spark, store))
    assert after[1] == "seen WORDS" and after[2] == "skill two" and after[4] == "filled" and after[3] == "three"
    got = {x["video_id"]: tuple(x)[1:] for x in V.outcomes(spark, V.current(spark, store), "f").collect()}
    assert got == {1: (1, 1, 0), 3: (1, 0, 0)}
    assert {k: v[:2] for k, v in log(spark, store).items()} == {(1, 1): ("MANUAL_EDIT", "Before editing segment #1"), (1, 2): ("OCR_FUSION", "Before STRONG_VISUAL"), (3, 1): ("OCR_FUSION", "Before STRONG_VISUAL")}


def test_a_lost_batch_changes_nothing(spark, store):
    before, state = texts(spark, store), V.current(spark, store)
    bad = edits(spark, [(1, "x", 1)]).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        V.edit(spark, store, "a", bad)
    assert V.current(spark, store) == state and texts(spark, store) == before
    V.edit(spark, store, "a", edits(spark, [(1, "x", 1)]))
    assert dict((i, t) for i, t, _ in texts(spark, store))[1] == "x"


def test_two_writers(spark, store):
    first = V.current(spark, store)
    V.edit(spark, store, "a", edits(spark, [(1, "x", 1)]))
    with pytest.raises(RuntimeError, match="was first"):
        V._publish(spark, dataclasses.replace(first, number=1))
    # a reader keeps the state it began with
    assert {r["content"] for r in V.segments(spark, first).where("id = 1").collect()} == {"one"}


def test_empty_store_and_empty_batch(spark, tmp_path):
    path = str(tmp_path / "none")
    V.create(spark.createDataFrame([], SEGMENT), path)
    V.edit(spark, path, "a", edits(spark, [(1, "x", 1)]))
    V.restore(spark, path, "b", spark.createDataFrame([], "video_id long, version_no long"))
    assert texts(spark, path) == [] and log(spark, path) == {} and set(V.current(spark, path).batches) == {"a", "b"}
