"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(256 * x) of each component as a double. They are packed in blocks with a
vertical layout: dimension by dimension, one column of all the block's vectors. Within a pair of a query
block and a candidate block, scores build up over dimension blocks, the dimensions of most mass first. After each
block, what a candidate can still gain is at most the product of the lengths of both rests (Cauchy-Schwarz), so
candidates that cannot reach the k-th best score any more are dropped and the columns compacted to the survivors.
The k-th best is that of the pair's lower bounds or, if higher, the one that the task has found for the query in
earlier block pairs. Bounds are rounded up and a candidate goes only if it falls short strictly, so ties stay and
results are exact. Where vectors point everywhere alike, as random ones do, the bounds drop candidates late.

Scores are exact: sums go through doubles only where they stay below 2^53, else through 64-bit integers; a
component or score that might not fit 64 bits raises an error.

The query set is stated (rows chosen by a condition) and meets all rows in blocks: query blocks are copied to the
candidate blocks by an equi-join on the latters' numbers, so candidates are shuffled once, and a task holds one
block pair at a time. That join is a sort-merge join by a hint: the copies are many times the query blocks of which
Spark knows the size, and would be broadcast through the driver. Blocks hold the narrowest integers that fit. Each pair
gives at most k rows a query; the best k of those follow from a window over the query. Nothing grows on the driver but
the two block counts.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, as query
or as candidate. Vectors of different lengths meet as if the shorter were filled with zeros. Equal scores are
ranked by smaller id. Rows that repeat an id are queries and candidates of their own: each query has its own ranks, and
another row of its id is a candidate like others. A query has fewer than k rows if there are
fewer candidates. Empty tables give an empty result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_BLOCK = "block string, ids binary, keys binary, dims int, width int, columns binary"
_RESULT = "query_key long, query_id long, vec_key long, vec_id long, score long"


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """df (id, key, v: array<double>) in blocks of at most `rows` vectors of one length, vertical layout."""

    def pack(ids: list, keys: list, vectors: list) -> dict:
        matrix = np.floor(256.0 * np.array(vectors, np.float64))
        if np.abs(matrix).max() >= 2.0**62:
            raise ValueError("a component times 256 does not fit 64 bits")
        width = next(w for w in (2, 4, 8) if w == 8 or np.abs(matrix).max() < 2 ** (8 * w - 1))
        return {"block": uuid.uuid4().hex, "ids": np.array(ids, np.int64).tobytes(), "keys": np.array(keys, np.int64).tobytes(), "dims": matrix.shape[1], "width": width, "columns": np.ascontiguousarray(matrix.T.astype(f"i{width}")).tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list, list]] = {}
        for pdf in batches:
            out = []
            for i, key, v in zip(pdf["id"], pdf["key"], pdf["v"], strict=True):
                ids, keys, vectors = held.setdefault(len(v), ([], [], []))
                ids.append(i)
                keys.append(key)
                vectors.append(v)
                if len(ids) == rows:
                    out.append(pack(*held.pop(len(v))))
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([pack(*x) for x in held.values()])

    return df.mapInPandas(run, _BLOCK)


def _numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The blocks with numbers from 0, and how many there are; only their names are ranked."""
    names = blocks.select("block").distinct()
    order = names.withColumn("number", (F.row_number().over(Window.orderBy("block")) - 1).cast("int"))
    out = blocks.join(order, "block").drop("block")
    return out.select(F.col("number").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("ids", "keys", "dims", "width", "columns")]), names.count()


def search_block(queries: np.ndarray, columns: np.ndarray, ids: np.ndarray, query_keys: np.ndarray, k: int, step: int = 8, floors: np.ndarray | None = None, keys: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], np.ndarray, int]:
    """The best k of a block for each query (the query's key, the candidate's place in the block, the score), the k-th
    best scores known so far, and how many products of components were spared. queries: a row each; columns: dimension
    by vector; floors: k-th best scores known before; keys: of the candidates' rows, by which a query passes over its
    own row (default: ids)."""
    keys = ids if keys is None else keys
    dims = min(queries.shape[1], columns.shape[0])
    floors = np.full(len(queries), -np.inf) if floors is None else floors.copy()
    most = sum(int(a) * int(b) for a, b in zip(np.abs(queries[:, :dims]).max(0), np.abs(columns[:dims]).max(1), strict=True)) if len(queries) and len(ids) else 0
    if most >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    exact = np.float64 if most < 1 << 53 else np.int64
    fq, fc = queries[:, :dims].astype(np.float64), columns[:dims].astype(np.float64)
    order = np.argsort(-(fq**2).sum(0) * (fc**2).sum(1), kind="stable")
    fq, fc = fq[:, order], fc[order]
    qs, cols = (fq, fc) if exact is np.float64 else (queries[:, order], columns[order])
    cuts = [*range(0, dims, step), dims]
    rest_c = np.array([np.sqrt((fc[c:] ** 2).sum(0)) for c in cuts])
    rest_q = np.array([np.sqrt((fq[:, c:] ** 2).sum(1)) for c in cuts])
    begun = min(1, len(cuts) - 1)  # the first block of all queries at once: there is no bound before it
    out, spared = [], 0
    error = 1e-6 + most * 2.0**-40  # of the bounds, which are doubles

    def lowest(bounds: np.ndarray, known: float) -> float:
        return np.partition(bounds, len(bounds) - k)[len(bounds) - k] if known == -np.inf else known

    for top in range(0, len(qs), 256):  # queries side by side while most of their candidates stay
        rows = slice(top, top + 256)
        other = keys != query_keys[rows, None]
        scores, b, alive = qs[rows, : cuts[begun]] @ cols[: cuts[begun]], begun, other
        while b < len(cuts) - 1 and len(ids) > k:
            slack = rest_q[b, rows, None] * rest_c[b]
            low = floors[rows].copy()
            for i in np.flatnonzero(low == -np.inf):
                low[i] = lowest(np.where(other[i], scores[i] - slack[i], -np.inf), low[i])
            slack += scores
            alive = other & (slack >= (low - 2 * error)[:, None])
            if np.count_nonzero(alive) * 4 < alive.size:
                break
            scores += qs[rows, cuts[b] : cuts[b + 1]] @ cols[cuts[b] : cuts[b + 1]]
            b += 1
        for i, own in enumerate(query_keys[rows]):
            row, at = top + i, b
            live = np.flatnonzero(alive[i])
            score = scores[i, live]
            spared += (int(np.count_nonzero(other[i])) - len(live)) * (dims - cuts[at])
            for at in range(b, len(cuts) - 1):
                if len(live) > k and at > b:
                    slack = rest_q[at, row] * rest_c[at, live]
                    stay = score + slack + error >= lowest(score - slack, floors[row]) - error
                    if not stay.all():
                        spared += int((~stay).sum()) * (dims - cuts[at])
                        live, score = live[stay], score[stay]
                score = score + qs[row, cuts[at] : cuts[at + 1]] @ cols[cuts[at] : cuts[at + 1], live]
            if len(live) > k:
                stay = score >= np.partition(score, len(live) - k)[len(live) - k]
                live, score = live[stay], score[stay]
            best = np.lexsort((keys[live], ids[live], -score))[:k]
            if len(best) == k:
                floors[row] = max(floors[row], float(score[best[-1]]))
            out += [(int(own), int(live[j]), int(score[j])) for j in best]
    return out, floors, spared


def top_k(df: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 1024, candidate_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row for which is_query holds."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.size(vector) > 0
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine & whole)
    # written once with a key for each row, so that a query passes over its own row only
    every = stored(vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.expr(is_query).alias("asks"), F.monotonically_increasing_id().alias("key")), "vectors")
    chosen = every.where("asks")
    candidates, n_candidates = _numbered(stored(_blocks(every, candidate_rows), "candidate-blocks"), "c")
    queries, n_queries = _numbered(stored(_blocks(chosen, query_rows), "query-blocks"), "q")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    pairs = queries.withColumn("c", each(n_candidates)).hint("merge").join(candidates, "c")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}  # of the query blocks met last
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, keys = np.frombuffer(r.c_ids, np.int64), np.frombuffer(r.c_keys, np.int64)
                own = dict(zip(np.frombuffer(r.q_keys, np.int64).tolist(), np.frombuffer(r.q_ids, np.int64).tolist(), strict=True))
                columns = np.frombuffer(r.c_columns, f"i{r.c_width}").reshape(r.c_dims, len(ids)).astype(np.int64)
                rows = np.frombuffer(r.q_columns, f"i{r.q_width}").reshape(r.q_dims, len(own)).T.astype(np.int64)
                rows, known[r.q], _ = search_block(rows, columns, ids, np.array(list(own)), k, floors=known.pop(r.q, None), keys=keys)
                if len(known) > 256:
                    known.pop(next(iter(known)))
                yield pd.DataFrame([(q, own[q], int(keys[at]), int(ids[at]), x) for q, at, x in rows], columns=[f.split()[0] for f in _RESULT.split(", ")])

    found = pairs.mapInPandas(run, _RESULT)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "vec_key")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same rows in DuckDB SQL. A vector's integers are joined with a query's by place.
ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
