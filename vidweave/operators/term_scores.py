"""Scores of many texts for many questions at once by the terms that a text holds, and the best texts of each video.

A term counts if it is a substring of a text. A term of letters, digits and CJK characters lies within one run of them,
so each distinct run is compared with the terms once and remembered as a set of bits; a text's set is the union of its
runs' sets, and the scores of a batch of texts are one product of matrices."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RUN = re.compile("[a-z0-9一-龥]+")


class _Runs(dict):
    """The terms, as bits, that a run holds. The first `most` runs are remembered, among them the frequent ones."""

    def __init__(self, terms: dict[str, int], most: int = 30_000):
        super().__init__()
        self.most, self.root, self.longest = most, {}, max(map(len, terms), default=0)
        for t, bit in terms.items():  # a tree of characters; a term's bit is under "" at its end
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = bit

    def __missing__(self, run: str) -> int:
        found, root = 0, self.root
        for i in range(len(run)):
            node = root
            for c in run[i : i + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                if "" in node:
                    found |= node[""]
        if len(self) < self.most and len(run) <= 64:
            self[run] = found
        return found


class Scorer:
    """questions: for each the (term, weight) pairs; terms in small letters, a repeated one weighs again."""

    def __init__(self, questions: list[list[tuple[str, int]]]):
        number: dict[str, int] = {}
        for q in questions:
            for t, _ in q:
                number.setdefault(t, len(number))
        self.weights = np.zeros((len(number), len(questions)))
        for i, q in enumerate(questions):
            for t, w in q:
                self.weights[number[t], i] += w
        plain = {t for t in number if _RUN.fullmatch(t)}
        self.runs = _Runs({t: 1 << i for t, i in number.items() if t in plain})
        self.others = [(t, 1 << i) for t, i in number.items() if t not in plain]
        self.n_bytes = (len(number) + 7) // 8

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row for each text (in small letters), a column for each question."""
        get = self.runs.__getitem__
        held = [reduce(or_, map(get, set(_RUN.findall(t))), 0) for t in texts]
        for term, bit in self.others:
            held = [h | bit if term in t else h for h, t in zip(held, texts, strict=True)]
        bits = np.frombuffer(b"".join([h.to_bytes(self.n_bytes, "little") for h in held]), np.uint8).reshape(len(texts), self.n_bytes)
        return (np.unpackbits(bits, axis=1, count=len(self.weights), bitorder="little").astype(np.float64) @ self.weights).astype(np.int64)


#: Scorers of the packs that this worker met last, as they know many runs.
_known: dict[tuple, Scorer] = {}


def _scorer(questions: list[list[dict]]) -> Scorer:
    key = tuple(tuple((t["term"], t["weight"]) for t in q) for q in questions)
    found = _known.pop(key, None) or Scorer([list(q) for q in key])
    _known[key] = found
    if len(_known) > 24:
        _known.pop(next(iter(_known)))
    return found


def best_of_runs(scores: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of rows (from each of starts to the next), column and rank up to k: the row with the next most score
    (the earlier of equal ones; -1 if there is none) and that score."""
    n = len(scores)
    packed = scores * n + (n - 1 - np.arange(n))[:, None]
    at = np.full((len(starts), scores.shape[1], k), -1)
    best = np.zeros_like(at)
    column = np.arange(scores.shape[1])[None, :]
    for j in range(k):
        top = np.maximum.reduceat(packed, starts, axis=0)
        row = n - 1 - top % n
        at[:, :, j] = np.where(top >= 0, row, -1)
        best[:, :, j] = top // n
        i, q = np.nonzero(top >= 0)
        packed[row[i, q], np.broadcast_to(column, row.shape)[i, q]] = -1
    return at, best


def best_segments(asked: DataFrame, links: DataFrame, segments: DataFrame, text: str, payload: dict[str, Column], k: int, pack: int = 64, shards: int = 64, part: int = 4096) -> DataFrame:
    """(kb_id, question_id, video_id, best) with the k segments of most score of each video of a question's base: an array
    of structs with the negative score, start_ms, segment_index and payload, in this order. asked: question_id, kb_id and
    terms (term in small letters, weight); segments: video_id, start_ms, segment_index, text and what the payload takes.

    Questions go in packs of a base. A pack is copied to its shards, each of which meets its share of the segments
    behind the pack, ordered by video and time; a task holds a pack and a batch of segments. A long video lies in
    several shards, `part` segment numbers each, and their best are merged."""
    keys = ["kb_id", "_pack"]
    place = F.row_number().over(Window.partitionBy("kb_id").orderBy("question_id")) - 1
    q = asked.withColumn("_pack", F.floor(place / pack).cast("int"))
    packs = q.groupBy(*keys).agg(F.collect_list(F.struct("question_id", "terms")).alias("_q"))
    met = links.join(packs.select(*keys), "kb_id").select("video_id", *keys)
    shard = F.pmod(F.xxhash64("video_id", F.floor(F.col("segment_index") / part)), F.lit(shards)).cast("int")
    rows = segments.join(met.hint("shuffle_hash"), "video_id").withColumn("_shard", shard).withColumn("_last", F.lit(True))
    copies = packs.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_last", F.lit(False))
    both = rows.unionByName(copies, allowMissingColumns=True).repartition(*keys, "_shard")
    both = both.sortWithinPartitions(*keys, "_shard", "_last", "video_id", "start_ms", "segment_index")
    sent = both.select("kb_id", "video_id", "start_ms", "segment_index", F.lower(text).alias("_low"), *[c.alias(name) for name, c in payload.items()], "_q")
    kind = {f.name: f.dataType.simpleString() for f in [*sent.schema, *asked.schema]}
    fields = ["start_ms", "segment_index", *payload]
    schema = f"kb_id {kind['kb_id']}, question_id {kind['question_id']}, video_id {kind['video_id']}, best array<struct<less:bigint,{','.join(f'{c}:{kind[c]}' for c in fields)}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, asks = None, None
        for batch in batches:
            heads = np.flatnonzero(batch["_q"].is_valid().to_numpy(zero_copy_only=False)).tolist()
            for start, end in zip([-1, *heads], [*heads, len(batch)], strict=True):
                if start >= 0:
                    asks = batch["_q"].slice(start, 1).flatten()
                    scorer = _scorer(asks.field("terms").to_pylist())
                if end > start + 1:
                    yield from found(batch.slice(start + 1, end - start - 1), scorer, asks.field("question_id"))

    def found(rows: pa.RecordBatch, scorer: Scorer, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        video = rows["video_id"]
        starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(video.slice(1), video.slice(0, len(video) - 1)).to_numpy(zero_copy_only=False)))
        at, best = best_of_runs(scorer.scores(rows["_low"].to_pylist()), starts, k)
        step = max(1, 20_000 // at.shape[1])
        for i in range(0, len(starts), step):
            some, score, n = at[i : i + step], best[i : i + step], len(starts[i : i + step])
            there = some >= 0
            taken = pa.array(some[there])
            offsets = np.append(0, np.cumsum(there.sum(2).reshape(-1))).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(-score[there]), *[rows[c].take(taken) for c in fields]], ["less", *fields])
            runs = pa.array(np.repeat(starts[i : i + step], at.shape[1]))
            yield pa.RecordBatch.from_arrays([rows["kb_id"].take(runs), ids.take(pa.array(np.tile(np.arange(at.shape[1]), n))), video.take(runs), pa.ListArray.from_arrays(pa.array(offsets), values)], ["kb_id", "question_id", "video_id", "best"])

    parts = sent.mapInArrow(run, schema)
    return parts.groupBy("kb_id", "question_id", "video_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
