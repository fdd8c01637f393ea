"""Packing by power-of-two decomposition: no padding, and no sequence that crosses documents.

A document's ids and its end id are cut into pieces whose lengths are powers of two: as many of the capacity as fit,
then one for each set bit of what is left, longest first. Each piece is a sequence of its own, so its length is a
power of two and needs no padding. Sequences of equal length go to one bucket: they are written to one folder of the
table, with their ids as little-endian unsigned 32-bit integers, and are numbered in batches of `batch_tokens` tokens,
so that a training loop reads batches of one shape.

A task reads texts, encodes them and writes pieces: nothing is shuffled, whatever the sources or lengths are. A
sequence's number is made of its bucket, the number of the task's partition and its place there, so numbers are unique
without a count over the table; each task leaves at most one batch a bucket that is not full. Memory is bounded by one
batch of texts and its ids. The pieces are written once to the shared folder; a lost executor costs its tasks only.

Defined results: a null text counts as empty; an empty text is one piece of the end id alone. A null id stays null;
rows that repeat an id are documents of their own. An empty table gives an empty result. Columns other than the two
named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, slices
from .piece_memo import library_memo

_SEQUENCES = "doc_id long, start long, length long, doc_tokens long, slot long, part int, ids binary, bucket int"


def decompose(totals: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Which document each piece is of, and its length, in document order, longest first. capacity: a power of two."""
    of = np.arange(len(totals))
    bits = 1 << np.arange(capacity.bit_length() - 1)[::-1]
    at, bit = np.nonzero(totals[:, None] & bits)
    owner = np.concatenate([np.repeat(of, totals // capacity), at])
    length = np.concatenate([np.full(len(owner) - len(at), capacity), bits[bit]])
    order = np.argsort(owner, kind="stable")
    return owner[order], length[order]


def binary_column(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of ids as binary values over one buffer."""
    ends = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])


def write_sequences(df: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 1024, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes all documents and writes their pieces, a folder for each bucket; returns the table as read back."""
    if capacity & (capacity - 1) or not 1 <= capacity < 1 << 31:
        raise ValueError("the capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part = library_memo(tokenizer_file, "\n", pack=64), TaskContext.get().partitionId()
        used = np.zeros(32, np.int64)  # places given out by bucket
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(map(len, texts)):
                lists = [np.append(x, end_id) for x in memo.spaced_id_lists(texts[a:b])]
                totals = np.fromiter(map(len, lists), np.int64, len(lists))
                owner, length = decompose(totals, capacity)
                before = np.cumsum(length) - length
                start = before - (np.cumsum(totals) - totals)[owner]
                bucket = np.log2(length).astype(np.int32)
                slot = np.zeros(len(bucket), np.int64)
                for k in np.unique(bucket):
                    here = bucket == k
                    slot[here] = used[k] + np.arange(here.sum())
                    used[k] += here.sum()
                columns = [doc_ids.take(pa.array(owner + a)), *map(pa.array, (start, length, totals[owner], slot, np.full(len(slot), part, np.int32))), binary_column(np.concatenate(lists), length), pa.array(bucket)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SEQUENCES.split(", ")])

    path = new_path(df.sparkSession, "length-buckets")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs.mapInArrow(run, _SEQUENCES).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(_SEQUENCES).parquet(path)


def pack_documents(df: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = 1024, batch_tokens: int = 8192, **columns: str) -> DataFrame:
    """A row for each sequence: its document and place there, its ids, its number, bucket (log2 of its length) and
    batch. Batches of one bucket hold sequences of one length, `batch_tokens` tokens in all, or one sequence."""
    s = write_sequences(df, tokenizer_file, end_id, capacity, **columns)
    number = lambda slot: F.shiftleft(F.col("bucket").cast("long"), 58) + F.shiftleft(F.col("part").cast("long"), 34) + slot
    a_batch = F.greatest(F.lit(1), F.floor(batch_tokens / F.col("length"))).cast("long")
    return s.select("doc_id", "start", "length", "ids", "doc_tokens", number(F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", number(F.floor(F.col("slot") / a_batch)).alias("batch_id"))
