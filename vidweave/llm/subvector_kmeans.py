"""Exact integer k-means over vectors that are kept as codes of distinct subvectors.

Vectors become integers, floor(1024 * x) of each component as a double, and are written once in chunks of a bounded
number of rows. In a chunk, the dimensions are cut into blocks of one width, and each block is dictionary-encoded
without loss: its distinct subvectors, and a code a row. The width is the one that costs the chunk least by a count of
operations (on the dictionaries' components, and on the codes), so a chunk of repeated vectors keeps whole vectors
as entries, and one of varied vectors keeps single components. In a round, each entry's squared distance to each
centroid's block is computed once, and a row's distance is the sum of its entries' by code; the sums of the clusters'
vectors come from the entries, too, each counted by cluster. All of it is whole numbers, so results are exact.

Chunks lie in the shared folder, and a round is one pass over them that gives a row a cluster and task; only the k
centroids (k times dims numbers, whatever the table's size) pass through the driver. Nothing is shuffled but these
rows. Memory is bounded by one chunk. Rows are dealt as they are read, so hot labels or repeated vectors land nowhere
in particular.

Defined results: only vectors with exactly `dims` components, none null or non-finite, take part. Rows that repeat an
id are vectors of their own. A null id stays null; it has no hash and starts a centroid only where too few others
do. With fewer vectors than k, each is a centroid. An empty table gives an empty result. Other columns are not
read. Integers beyond 2^27 raise an error, as their distances might not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_CHUNK = "ids array<long>, width int, sizes array<int>, entries binary, codes binary"
LARGEST = 1 << 27


def encoded(matrix: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct subvectors of each block of `width` dimensions, and the rows' codes, a row of codes a block."""
    entries, codes = [], []
    for at in range(0, matrix.shape[1], width):
        block = np.ascontiguousarray(matrix[:, at : at + width])
        keys = block[:, 0] if width == 1 else block.view(np.dtype((np.void, 8 * width)))[:, 0]
        _, first, code = np.unique(keys, return_index=True, return_inverse=True)
        entries.append(block[first])
        codes.append(code.reshape(-1).astype(np.uint16))
    return entries, np.array(codes)


def narrowest_cost(matrix: np.ndarray, widths: tuple[int, ...]) -> tuple[int, list[np.ndarray], np.ndarray]:
    """The width of least cost and its encoding. For each centroid, a component of an entry takes three operations
    (difference, square, sum), a code one (sum)."""
    tried = [(w, *encoded(matrix, w)) for w in widths if matrix.shape[1] % w == 0]
    return min(tried, key=lambda x: 3 * sum(e.size for e in x[1]) + x[2].size)


def write_chunks(vectors: DataFrame, dims: int, rows: int, scale: int = 1024, widths: tuple[int, ...] = (64, 8, 2, 1)) -> DataFrame:
    """vectors (id, v: array<double> of `dims`) as stored chunks of at most `rows`."""
    if not 0 < rows <= 1 << 16:
        raise ValueError("codes have 16 bits: a chunk holds at most 65536 rows")

    def packed(ids: list, parts: list) -> pa.RecordBatch:
        matrix = np.concatenate(parts)
        if np.abs(matrix).max() > LARGEST:
            raise ValueError("a scaled component is beyond 2^27")
        width, entries, codes = narrowest_cost(matrix.astype(np.int64), widths)
        flat = np.concatenate([e.ravel() for e in entries]).astype("<i4")
        row = {"ids": [ids], "width": [width], "sizes": [[len(e) for e in entries]], "entries": [flat.tobytes()], "codes": [codes.astype("<u2").tobytes()]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("sizes", pa.list_(pa.int32())), ("entries", pa.binary()), ("codes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in batches:
            got = batch.column(0).to_pylist()
            matrix = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(got), dims))
            while len(got):
                take = rows - len(ids)
                ids, got = ids + got[:take], got[take:]
                parts.append(matrix[:take])
                matrix = matrix[take:]
                if len(ids) == rows:
                    yield packed(ids, parts)
                    ids, parts = [], []
        if ids:
            yield packed(ids, parts)

    return stored(vectors.select("id", "v").mapInArrow(run, _CHUNK), "subvector-chunks")


def opened(row: dict, dims: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries and codes of a stored chunk."""
    width, sizes = row["width"], np.array(row["sizes"], np.int64)
    flat = np.frombuffer(row["entries"], "<i4").astype(np.int64)
    entries = [x.reshape(-1, width) for x in np.split(flat, np.cumsum(sizes * width)[:-1])]
    return entries, np.frombuffer(row["codes"], "<u2").reshape(dims // width, -1)


def distances(entries: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid: those of the entries, computed once, summed by code."""
    total, at = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for entry, code in zip(entries, codes, strict=True):
        width = entry.shape[1]
        table = np.stack([((entry - c[at : at + width]) ** 2).sum(1) for c in centroids], 1)
        total += table[code]
        at += width
    return total


def cluster_sums(entries: list[np.ndarray], codes: np.ndarray, nearest: np.ndarray, k: int) -> np.ndarray:
    """The sum of each cluster's vectors, from how often each entry occurs in it."""
    out = []
    for entry, code in zip(entries, codes, strict=True):
        times = np.bincount(code.astype(np.int64) * k + nearest, minlength=len(entry) * k).reshape(len(entry), k)
        out.append(times.T @ entry)
    return np.concatenate(out, 1)


def round_sums(chunks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and vector sum of each centroid's vectors: one pass over the chunks, k rows to the driver."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                entries, codes = opened(row, dims)
                nearest = distances(entries, codes, centroids).argmin(1)  # the first of the least
                n += np.bincount(nearest, minlength=k)
                sums += cluster_sums(entries, codes, nearest, k)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.arange(k, dtype=np.int32)), "n": pa.array(n), "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    found = chunks.select("width", "sizes", "entries", "codes").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", i)) for i in range(dims)]).alias("sums"))
    return {r["cluster"]: (r["n"], r["sums"]) for r in total.where("n > 0").collect()}


def assigned(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector, stored."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = distances(*opened(row, dims), centroids)
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(nearest.astype(np.int32)), "distance": pa.array(d[np.arange(len(d)), nearest])})

    return stored(chunks.mapInArrow(run, "vec_id long, cluster int, distance long"), "subvector-assigned")


def takes_part(vector: Column, dims: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & fine


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = 16_384) -> DataFrame:
    """The cluster of every vector, with its squared distance, the inertia of its cluster and of all, and the hash of
    its final centroid's components."""
    spark, v = df.sparkSession, F.col(vector_col).cast("array<double>")
    vectors = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(takes_part(F.col("v"), dims))
    hashed = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    first = hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.floor(1024 * np.array([r["v"] for r in first])).astype(np.int64)
    chunks = write_chunks(vectors, dims, chunk_rows)
    for _ in range(rounds):
        for c, (n, sums) in round_sums(chunks, centroids).items():
            centroids[c] = [s // n for s in sums]
    found = assigned(chunks, centroids)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """The same rows in DuckDB SQL, a pair of steps a round."""
    distance = f"CAST(list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT)"
    nearest = lambda of: f"SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, {distance} AS d FROM v, c{of} c) GROUP BY r"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({nearest(n)})")
        mean = f"SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.e) AS x, unnest(range(1, {dims} + 1)) AS i FROM a{n} a JOIN v USING (r)) GROUP BY c, i"
        floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (SELECT c, list({floor} ORDER BY i) AS e FROM ({mean}) GROUP BY c) m USING (c))")
    return f"""WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k})),
{", ".join(steps)}, a AS MATERIALIZED ({nearest(rounds)})
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.c"""
