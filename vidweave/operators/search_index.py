"""A stored index of segment vectors with block-max bounds, and search that skips blocks.

The index is a Parquet table in shards by video. A row is a block: up to `block_rows` neighbouring segments of a video,
as an inverted list by bucket (the segments that hold it, and how often), with the length of each segment's vector and,
for each bucket, the greatest share that it has in a vector of the block. A question's score in a block is at most the
sum of its values times these, so a block whose bound is below what the question needs (the least score, or the k-th
best score that the task has found for it) is skipped without a look at its lists.

Building streams the segments of a range of (video, segment) through a task and holds one block at a time, so a hot
video is in many tasks. Search joins blocks with batches of questions on the video; Spark may split hot videos. New or
changed segments replace those of their ids: only the shards they fall into are written again, at once.

Segments without a token have no vector and are not in the index, nor are those without an id or a video. Rows that repeat an id are entries of their own when
an index is built; when it is updated, they replace all of the id."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidweave.functions import text as T
from vidweave.sources.storage import stored

BLOCK = "video_id long, ids array<long>, segment_index array<long>, start_ms array<long>, norms array<double>, buckets array<int>, ends array<int>, rows array<int>, counts array<int>, tops array<double>, shard int"
_ENTRY = "video_id long, id long, segment_index long, start_ms long, buckets array<int>, counts array<int>"
_HIT = "question_id long, id long, video_id long, segment_index long, start_ms long, dot double, scale double, pairs long, skipped long"
_KINDS = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


class Buckets(dict):
    """The bucket of each token met: the 31-based string hash, positive, by the number of buckets. Bounded."""

    def __init__(self, dim: int, most: int = 500_000) -> None:
        super().__init__()
        self._dim, self._most = dim, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self._most:
            self.clear()
        h = 0
        for c in token:
            h = (31 * h + ord(c)) & 0xFFFFFFFF
        self[token] = b = (h & 0x7FFFFFFF) % self._dim
        return b


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, joined, and the length of each list (a null is an empty one)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


class Entries:
    """Segments with their vectors: head has a row for each (video, shard, id, segment_index, start_ms); row, bucket
    and count are the entries of all vectors, sorted by row."""

    def __init__(self, head: np.ndarray, row: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> None:
        self.head, self.row, self.bucket, self.count = head, row, bucket, count

    def part(self, a: int, b: int) -> Entries:
        i, j = np.searchsorted(self.row, [a, b])
        return Entries(self.head[a:b], self.row[i:j] - a, self.bucket[i:j], self.count[i:j])

    def joined(self, other: Entries) -> Entries:
        both = lambda x, y: np.concatenate([x, y])
        return Entries(both(self.head, other.head), both(self.row, other.row + len(self.head)), both(self.bucket, other.bucket), both(self.count, other.count))

    def block(self) -> tuple:
        """A row of BLOCK."""
        order = np.lexsort((self.row, self.bucket))
        row, bucket, count = self.row[order], self.bucket[order], self.count[order]
        norms = np.sqrt(np.bincount(row, count.astype(np.float64) ** 2, len(self.head)))
        buckets, first = np.unique(bucket, return_index=True)
        h = self.head
        return int(h[0, 0]), h[:, 2], h[:, 3], h[:, 4], norms, buckets, np.append(first[1:], len(row)), row, count, np.maximum.reduceat(count / norms[row], first), int(h[0, 1])


def read_entries(batch: pa.RecordBatch, bucket_of: Buckets, dim: int) -> Entries:
    """A batch of rows (video_id, shard, id, segment_index, start_ms, tokens, buckets, counts) without those that have
    no token."""
    head = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], 1).astype(np.int64)
    tokens = batch.column(5)
    words, lengths = tokens.flatten().to_pylist(), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.repeat(np.arange(len(head)), lengths) * dim + np.fromiter(map(bucket_of.__getitem__, words), np.int64, len(words))
    key, n = np.unique(places, return_counts=True)
    (known, of), (counts, _) = flat(batch.column(6)), flat(batch.column(7))
    key, n = np.concatenate([key, np.repeat(np.arange(len(head)), of) * dim + known]).astype(np.int64), np.concatenate([n, counts]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    row, bucket, count = key[order] // dim, key[order] % dim, n[order]
    some, row = np.unique(row, return_inverse=True)
    return Entries(head[some], row.reshape(-1), bucket, count)


def _blocks(rows: DataFrame, dim: int, groups: list | None, block_rows: int) -> DataFrame:
    """Blocks of rows (video_id, id, segment_index, start_ms, shard, content, and buckets and counts where content is
    null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, none = Buckets(dim), np.zeros(0, np.int64)
        held = Entries(np.zeros((0, 5), np.int64), none, none, none)

        def cut(entries: Entries, last: bool) -> tuple[list[tuple], Entries]:
            n = len(entries.head)
            turns = [0, *(np.flatnonzero((entries.head[1:, :2] != entries.head[:-1, :2]).any(1)) + 1).tolist(), n]
            out, open_ = [], n
            for a, b in pairwise(turns):
                for at in range(a, b, block_rows):
                    end = min(at + block_rows, b)
                    if end < n or last:
                        out.append(entries.part(at, end).block())
                    else:
                        open_ = at  # may go on in the next batch
            return out, entries.part(open_, n)

        for batch in batches:
            held = held.joined(read_entries(batch, bucket_of, dim))
            out, held = cut(held, False)
            yield _batch(BLOCK, out)
        if len(held.head):
            yield _batch(BLOCK, cut(held, True)[0])

    order = ["shard", "video_id", "segment_index", "id"]
    text = F.col("content")
    tokens = F.when(text.isNotNull(), T.expand(text, T.tokenize(text), T.DOMAIN_TOKENS if groups is None else groups))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)  # before texts become tokens
    return dealt.select("video_id", "shard", "id", "segment_index", "start_ms", tokens.alias("tokens"), "buckets", "counts").mapInArrow(run, BLOCK)


def _shard(shards: int):
    return F.pmod(F.xxhash64("video_id"), F.lit(shards)).cast("int").alias("shard")


def _rows(segments: DataFrame, shards: int) -> DataFrame:
    none = F.lit(None).cast("array<int>")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return segments.where("video_id IS NOT NULL AND id IS NOT NULL AND content IS NOT NULL").select("video_id", "id", number("segment_index"), number("start_ms"), "content", none.alias("buckets"), none.alias("counts"), _shard(shards))


def build_index(segments: DataFrame, path: str, dim: int = 256, groups: list | None = None, shards: int = 8, block_rows: int = 32) -> DataFrame:
    """The index of segments (id, video_id, segment_index, start_ms, content), written to path and read back."""
    _blocks(_rows(segments, shards), dim, groups, block_rows).write.partitionBy("shard").option("compression", "zstd").mode("overwrite").parquet(path)
    return read_index(segments.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def entries(index: DataFrame) -> DataFrame:
    """A row for each segment of the index, with its vector: buckets and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                vectors: list[tuple[list, list]] = [([], []) for _ in b["ids"]]
                at = 0
                for bucket, end in zip(b["buckets"], b["ends"], strict=True):
                    for row, count in zip(b["rows"][at:end], b["counts"][at:end], strict=True):
                        vectors[row][0].append(bucket)
                        vectors[row][1].append(count)
                    at = end
                yield _batch(_ENTRY, [(b["video_id"], *x, *v) for *x, v in zip(b["ids"], b["segment_index"], b["start_ms"], vectors, strict=True)])

    return index.mapInArrow(run, _ENTRY)


def update_index(segments: DataFrame, path: str, dim: int = 256, groups: list | None = None, shards: int = 8, block_rows: int = 32) -> DataFrame:
    """Puts new and changed segments into the index at path: they replace the entries of their ids. Shards without one
    are left as they are; a repeat of the same segments changes nothing. A segment keeps its video."""
    spark = segments.sparkSession
    fresh = stored(_rows(segments, shards), "index-segments")
    index = read_index(spark, path)
    touched = index.join(fresh.select("shard").distinct(), "shard", "left_semi")
    old = entries(touched).join(fresh.select("id").distinct(), "id", "left_anti")
    none = F.lit(None).cast("string").alias("content")
    kept = old.select("video_id", "id", "segment_index", "start_ms", none, "buckets", "counts", _shard(shards))
    # written aside first: the shards that are read are the ones replaced
    blocks = stored(_blocks(kept.unionByName(fresh), dim, groups, block_rows), "index-blocks")
    blocks.write.partitionBy("shard").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    return read_index(spark, path)


def index_stats(index: DataFrame) -> DataFrame:
    """Segments and tokens in the index, by video."""
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    return index.groupBy("video_id").agg(F.sum(F.size("ids")).cast("long").alias("indexed"), F.sum(n).alias("n_tokens"))


_QUESTIONS = ("questions", "question_norms", "question_ends", "question_buckets", "question_values")


def _asked(vectors: DataFrame, scopes: DataFrame, batch: int) -> DataFrame:
    """(video_id, and the arrays of _QUESTIONS): the questions of each video in batches of about `batch`."""
    s = scopes.select("question_id", "video_id").distinct()
    n = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("video_id")) / batch)
    rows = s.withColumn("_batch", F.pmod(F.xxhash64("question_id"), n)).join(vectors, "question_id")
    q = rows.groupBy("video_id", "_batch").agg(F.collect_list(F.struct("question_id", "norm", F.map_keys("vector").alias("b"), F.map_values("vector").alias("v"))).alias("q"))
    return q.select("video_id", *[c.alias(name) for c, name in zip((F.col("q.question_id"), F.col("q.norm"), F.transform("q", lambda x: F.size(x["b"])), F.flatten("q.b"), F.flatten("q.v")), _QUESTIONS, strict=True)])


def hits(index: DataFrame, vectors: DataFrame, scopes: DataFrame, k: int, least: float, dim: int = 256, batch: int = 64) -> DataFrame:
    """The segments that can be among the k best of each question, and in rows without a segment how many pairs of a
    question and a block there were and how many of them were skipped. vectors: question_id, norm, vector (a map)."""
    margin = 2e-6  # scores are compared after rounding to six places
    names = [f.split()[0] for f in BLOCK.split(", ")[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}  # the k best scores of a question so far
        for arrow in batches:
            lists = {name: flat(arrow.column(name)) for name in (*names[1:], *_QUESTIONS)}
            ends = {name: np.cumsum(n) for name, (_, n) in lists.items()}
            of = lambda name, i: lists[name][0][ends[name][i] - lists[name][1][i] : ends[name][i]]  # noqa: E731, B023
            out, pairs, skipped = [], 0, 0
            for i, video in enumerate(arrow.column("video_id").to_pylist()):
                questions, norms, buckets = of("questions", i).tolist(), of("question_norms", i), of("buckets", i)
                q = np.zeros((len(questions), dim))
                q[np.repeat(np.arange(len(questions)), of("question_ends", i)), of("question_buckets", i)] = of("question_values", i)
                q = q[:, buckets]
                need = np.array([max(least, found[x][0]) if x in found else least for x in questions]) - margin
                live = np.flatnonzero(q @ of("tops", i) / norms >= need)
                pairs, skipped = pairs + len(questions), skipped + len(questions) - len(live)
                if not len(live):
                    continue
                ids = of("ids", i)
                table = np.zeros((len(buckets), len(ids)))
                table[np.repeat(np.arange(len(buckets)), np.diff(of("ends", i), prepend=0)), of("rows", i)] = of("counts", i)
                dots, scale = q[live] @ table, norms[live][:, None] * of("norms", i)  # whole numbers, so exact
                score = dots / scale
                for row in np.flatnonzero((score >= need[live][:, None]).any(1)):
                    good = np.flatnonzero(score[row] >= need[live[row]])
                    question = questions[live[row]]
                    best = np.sort(np.concatenate([found.get(question, np.full(k, -np.inf)), score[row, good]]))[-k:]
                    found[question] = best
                    good = good[score[row, good] >= best[0] - margin]
                    out.append((np.full(len(good), question), ids[good], np.full(len(good), video), of("segment_index", i)[good], of("start_ms", i)[good], dots[row, good], scale[row, good]))
            if len(found) > 100_000:
                found.clear()
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 7
            empty = pa.nulls(len(columns[0]), pa.int64())
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2
            fields = [f.split()[0] for f in _HIT.split(", ")]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], empty, empty], names=fields)
            yield _batch(_HIT, [(*[None] * 7, pairs, skipped)])

    both = index.drop("shard").join(_asked(vectors, scopes, batch), "video_id")
    both = both.repartition("video_id", F.get("ids", 0))  # blocks of a hot video, too, and what a join read in one piece
    return both.mapInArrow(run, _HIT)


def search(index: DataFrame, vectors: DataFrame, scopes: DataFrame, k: int = 12, least: float = 0.08, dim: int = 256) -> DataFrame:
    """The k best segments of each question within its videos: ids, vec (cosine to six places) and rank."""
    found = hits(index, vectors, scopes, k, least, dim).where("id IS NOT NULL")
    scored = found.select("question_id", "id", "video_id", "segment_index", "start_ms", F.round(F.col("dot") / F.col("scale"), 6).alias("vec")).where(F.col("vec") >= least)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("vec"), "start_ms", "video_id", "segment_index"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def search_report(index: DataFrame, vectors: DataFrame, scopes: DataFrame, k: int = 12, least: float = 0.08, dim: int = 256) -> DataFrame:
    """One row: pairs of a question and a block in its scope, and how many of them the bounds skipped."""
    return hits(index, vectors, scopes, k, least, dim).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
