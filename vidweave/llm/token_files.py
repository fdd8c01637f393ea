"""Token ids in seekable binary files: one zstandard frame for each document, and a trailing seek table.

File format, all integers little-endian:
  frames       one independent zstandard frame a document, of its ids as unsigned 32-bit integers
  index        a skippable frame (magic 0x184D2A5D): for each frame its doc_id as a signed 64-bit integer
  seek table   a skippable frame (magic 0x184D2A5E), as in the public zstandard seekable format: for each
               frame its compressed size, its decompressed size and the low 32 bits of the XXH64 of its
               decompressed bytes; then the number of frames, a descriptor byte (0x80: with checksums) and
               the magic number 0x8F92EAB1

A reader takes the last nine bytes, then the table and the index, and decompresses only the frames it wants;
each is checked against its checksum. Any zstandard decoder reads the whole file, too.

Writing: documents are dealt by ranges of doc_id, sorted within each range, encoded and written by the task
that has them, file after file of about `file_bytes`. Files go to the folder that driver and executors share
(a URI that pyarrow knows). A task writes under a name of its own and only the files named in the manifest
count, so a repeated or lost task leaves no double rows. The manifest has a row for each file; places in the
whole come from running sums over it. Memory is bounded by one frame to write or read plus the file's table.

Defined results: a null text counts as empty; an empty text is a frame of the end id alone. Several rows of
one doc_id are all written, next to each other. A null id is written as the smallest 64-bit number, hence first, and
read back as null. An empty table gives no files and no rows. Columns other
than the two named ones are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices, stored
from .piece_memo import library_memo

INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Stands for a null id in the files; it sorts first.
NO_ID = -(1 << 63)
MANIFEST = "path string, first_doc long, last_doc long, n_docs long, n_ids long"
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file of frames to an open binary stream."""

    def __init__(self, stream, level: int = 3) -> None:
        import zstandard

        self._stream, self._pack = stream, zstandard.ZstdCompressor(level=level).compress
        self.doc_ids: list[int] = []
        self._entries: list[tuple[int, int, int]] = []
        self.n_ids = self.size = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        import xxhash

        plain = ids.astype("<u4").tobytes()
        packed = self._pack(plain)
        self._stream.write(packed)
        self.doc_ids.append(doc_id)
        self._entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.n_ids += len(ids)
        self.size += len(packed)

    def finish(self) -> None:
        index = np.array(self.doc_ids, "<i8").tobytes()
        table = np.array(self._entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self._entries), WITH_CHECKSUMS, SEEK_MAGIC)
        for magic, body in ((INDEX_MAGIC, index), (TABLE_MAGIC, table)):
            self._stream.write(struct.pack("<II", magic, len(body)) + body)


class FrameReader:
    """Random access to the documents of one file, given as a seekable binary stream and its size."""

    def __init__(self, stream, size: int) -> None:
        import zstandard

        self._stream, self._unpack = stream, zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a file of checked, seekable frames")
        table = size - 9 - n * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(table, n * _ENTRY.itemsize), _ENTRY)
        self.doc_ids = np.frombuffer(self._at(table - 8 - n * 8, n * 8), "<i8")
        self.starts = np.cumsum(self.entries["packed"], dtype=np.int64) - self.entries["packed"]

    def _at(self, offset: int, n: int) -> bytes:
        self._stream.seek(offset)
        return self._stream.read(n)

    def frame(self, k: int, packed: bytes | None = None) -> np.ndarray:
        import xxhash

        entry = self.entries[k]
        packed = self._at(int(self.starts[k]), int(entry["packed"])) if packed is None else packed
        plain = self._unpack(packed, max_output_size=max(1, int(entry["plain"])))
        if len(plain) != entry["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != entry["check"]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(plain, "<u4")

    def frames(self, wanted: Iterable[int], gap: int = 65_536, most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
        """(k, ids) of the wanted frames, in order. Frames with up to `gap` bytes between them are read by one request
        of about `most` bytes, and only the wanted ones are decompressed."""
        held: list[int] = []
        end_of = lambda k: int(self.starts[k]) + int(self.entries["packed"][k])

        def read() -> Iterator[tuple[int, np.ndarray]]:
            first = int(self.starts[held[0]])
            raw = self._at(first, end_of(held[-1]) - first)
            for k in held:
                yield k, self.frame(k, raw[int(self.starts[k]) - first : end_of(k) - first])

        for k in map(int, wanted):
            if held and (int(self.starts[k]) - end_of(held[-1]) > gap or end_of(k) - int(self.starts[held[0]]) > most):
                yield from read()
                held = []
            held.append(k)
        if held:
            yield from read()

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the wanted documents, or of all, decompressing no other frames."""
        keep = range(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)))
        for k, ids in self.frames(keep):
            yield int(self.doc_ids[k]), ids


def write_files(df: DataFrame, tokenizer_file: str, end_id: int, file_bytes: int = 32_000_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encodes and writes all documents; returns the manifest (a row a file), stored."""
    spark = df.sparkSession
    folder = new_path(spark, "token-files")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = library_memo(tokenizer_file, "\n", pack=64)
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name = stream = writer = None

        def close() -> pd.DataFrame:
            writer.finish()
            stream.close()
            return pd.DataFrame({"path": [f"{folder}/{name}"], "first_doc": [writer.doc_ids[0]], "last_doc": [writer.doc_ids[-1]], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

        for pdf in batches:
            for start, end in slices(map(len, pdf["text"])):
                lists = memo.spaced_id_lists(pdf["text"].iloc[start:end].tolist())
                for doc_id, ids in zip(pdf["doc_id"].iloc[start:end], lists, strict=True):
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.zst"
                        stream = files.open_output_stream(f"{root}/{name}", compression=None)
                        writer = FrameWriter(stream)
                    writer.add(int(doc_id), np.append(ids, end_id))
                    if writer.size >= file_bytes:
                        yield close()
                        writer = None
        if writer is not None:
            yield close()

    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(dealt.mapInPandas(run, MANIFEST), "token-manifest")


def read_files(manifest: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """Each document read back from the files: its place in the whole, its number of ids and their CRC-32.

    With `wanted`, files that cannot hold a wanted doc_id are not opened, and only wanted frames are read."""
    spark: SparkSession = manifest.sparkSession
    before = Window.orderBy("first_doc", "last_doc", "path").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    wanted = None if wanted is None else sorted(wanted)
    if wanted is not None:
        hit = F.lit(False)
        for doc_id in wanted:
            hit = hit | ((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
        files = files.where(hit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                files, name = _filesystem(path)
                with files.open_input_file(name) as stream:
                    reader = FrameReader(stream, stream.size())
                    n = reader.entries["plain"].astype(np.int64) // 4
                    starts = int(start) + np.cumsum(n) - n
                    keep = range(len(n)) if wanted is None else np.flatnonzero(np.isin(reader.doc_ids, wanted))
                    rows = [(int(reader.doc_ids[k]), int(starts[k]), int(n[k]), zlib.crc32(ids)) for k, ids in reader.frames(keep)]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
