"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become ids and one end id; only those longer than the capacity are cut, into pieces of the
capacity. A full piece is a sequence of its own. The other pieces are dealt by hash into blocks of a bounded
number of items. Each block is evolved on several islands: an island keeps a small population of packings
(whole assignments of items to bins, first made by best fit on orders by randomly raised lengths; a block's first
island starts with plain best fit, longest first, too, so no block takes more bins than that gives), and crosses two of them by injecting whole well-filled bins of one into the other, removing the bins that then hold duplicates, and best-fitting the
displaced documents, longest first. After each epoch the best packing of an island migrates to the next island of
its block. An island ends an epoch early where a packing has reached the lower bound ceil(total / capacity), which
no packing can beat. Of each block the best packing over all islands counts. `crossovers` and `elites_moved` say,
for each piece, how many children its block's islands made and how many packings moved between them (`elites_new`:
to an island whose best was another).

Blocks would each leave a part-filled bin, so the worst-filled bins of `fan` neighbouring blocks are
dissolved and packed again together, level by level, until one block is left: what a level passes on is a
bounded number of bins a block, so no task holds more than a bounded number of items.

Blocks and states are written to the shared folder between epochs, so a lost executor costs one step.
All choices are seeded by the block, island and epoch: repeated tasks give equal results. Pieces are dealt to blocks
by a hash of their place in the stored table, so many rows of one doc_id spread like others.

Defined results: a null text counts as empty; an empty text is a piece of the end id alone. Repeated rows of
one doc_id are packed as pieces of their own; a null id stays null. Ties between bins go to the fuller, then the earlier one. An
empty table gives an empty result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .piece_memo import library_memo, release, words

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ITEM = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("crc", "<i8"), ("nameless", "?")])


def cut_pieces(df: DataFrame, tokenizer_file: str, end_id: int, capacity: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each piece of each document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = library_memo(tokenizer_file, " \x01 ", lower=True)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(map(len, texts)):
                rows = []
                for k, ids in enumerate(memo.id_lists([words(t) for t in texts[a:b]]), a):
                    ids = np.append(ids, end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((k, piece, start, len(part), zlib.crc32(part)))
                of, piece, start, length, crc = zip(*rows, strict=True)
                columns = [doc_ids.take(pa.array(of)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], items: list[int], bins: np.ndarray, free: list[tuple[int, int]], next_bin: int, capacity: int) -> int:
    """Puts each item into the fullest bin that has room. free: (room, bin), sorted. Returns the next new bin."""
    for i in items:
        n = lengths[i]
        at = bisect_left(free, (n, -1))
        if at == len(free):
            room, b = capacity, next_bin
            next_bin += 1
        else:
            room, b = free.pop(at)
        bins[i] = b
        if room > n:
            insort(free, (room - n, b))
    return next_bin


#: All first packings but one take items by length, each length raised by up to this share at random.
SPREAD = 1.0


def renumbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def fitness(bins: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    """Fewer bins are better; then fuller full bins and emptier empty ones. The smallest is the best."""
    fill = np.bincount(bins, lengths)
    return len(fill), -float((fill**2).sum())


def crossed(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A child, and which items came in with injected bins: well-filled bins of b go into a whole; the bins of a that
    hold one of their items go, and so do a's emptiest; what these displace is best-fitted, longest first."""
    fill = np.bincount(b, lengths)
    good = (fill >= np.quantile(fill, rng.uniform(0.5, 0.95))) & (rng.random(len(fill)) < rng.uniform(0.2, 0.8))
    injected = good[b]
    struck = np.zeros(int(a.max()) + 1, bool)
    struck[a[injected]] = True
    fill_a = np.bincount(a, lengths)
    struck |= (fill_a <= np.quantile(fill_a, 0.02)) & (fill_a < capacity)
    displaced = struck[a] & ~injected
    child = np.where(injected, b + len(struck), a)
    whole = ~displaced
    rest_fill = np.bincount(child[whole], lengths[whole], minlength=len(struck) + len(fill))
    used = np.unique(child[whole])
    free = sorted((int(capacity - rest_fill[x]), int(x)) for x in used if rest_fill[x] < capacity)
    order = np.flatnonzero(displaced)
    order = order[np.argsort(-lengths[order] * (1 + 0.02 * rng.random(len(order))), kind="stable")]
    best_fit(lengths.tolist(), order.tolist(), child, free, len(struck) + len(fill), capacity)
    return renumbered(child), injected


def evolve(lengths: np.ndarray, capacity: int, seed: list[int], migrants: list[np.ndarray], population: int, generations: int, plain: bool = True) -> tuple[np.ndarray, int]:
    """The best packing that an island finds in an epoch, and how many children it made. plain: the first packing of a
    population without migrants is plain best fit."""
    rng = np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // capacity)
    as_list, people, children = lengths.tolist(), list(migrants), 0
    while len(people) < population:
        bins = np.zeros(len(lengths), np.int64)
        raised = lengths * (1 + SPREAD * rng.random(len(lengths))) if people or not plain else lengths
        order = np.argsort(-raised, kind="stable")
        best_fit(as_list, order.tolist(), bins, [], 0, capacity)
        people.append(bins)
    rank = lambda p: fitness(p, lengths)
    people.sort(key=rank)
    for _ in range(generations):
        if children and rank(people[0])[0] == bound:
            break
        one, two = rng.permutation(len(people))[:2]
        born = [crossed(people[x], people[y], lengths, capacity, rng)[0] for x, y in ((one, two), (two, 0) if two else (one, 0))]
        children += len(born)
        people = sorted([*people, *born], key=rank)[:population]
    return people[0], children


def _gathered(df: DataFrame) -> DataFrame:
    """df (block and the columns of PIECES) as one row a block, its items in a fixed order."""

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "nameless"])
        items = np.zeros(len(pdf), _ITEM)
        for name, column in (("doc_id", "doc_id"), ("start", "start"), ("piece", "piece"), ("length", "length"), ("crc", "ids_crc32"), ("nameless", "nameless")):
            items[name] = pdf[column].to_numpy()
        return pd.DataFrame({"block": [key[0]], "items": [items.tobytes()]})

    return df.groupBy("block").applyInPandas(gather, "block long, items binary")


def _rows(items: np.ndarray, bins: np.ndarray, keep: np.ndarray) -> pd.DataFrame:
    order = np.argsort(bins, kind="stable")
    order = order[keep[bins[order]]]
    items, bins = items[order], bins[order]
    ends = np.cumsum(items["length"])
    before = ends - items["length"]
    first = np.r_[True, bins[1:] != bins[:-1]] if len(bins) else np.zeros(0, bool)
    base = before[first][np.cumsum(first) - 1] if len(bins) else before
    return pd.DataFrame({"doc_id": items["doc_id"], "piece": items["piece"], "start": items["start"], "length": items["length"].astype(np.int64), "ids_crc32": items["crc"], "nameless": items["nameless"], "bin": bins.astype(np.int64), "offset": (before - base).astype(np.int64)})


def pack(pieces: DataFrame, capacity: int, block_items: int = 4096, islands: int = 2, epochs: int = 2, population: int = 3, generations: int = 8, fan: int = 64, passed_on: int = 8) -> DataFrame:
    """pieces (stored) with sequence_id and offset."""
    # ids go through numpy without nulls
    pieces = pieces.withColumn("nameless", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() + (1 << 62))
    full = full.select("*", *[F.lit(0).cast("long").alias(c) for c in ("offset", "crossovers", "elites_moved", "elites_new")])
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block_items))
    state = _gathered(rest.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))))
    out, level = full, 0

    while True:
        state = stored(state, "packing-blocks").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        state = state.withColumn("elites", F.array().cast("array<binary>")).withColumns({c: F.lit(0).cast("long") for c in ("crossovers", "elites_moved", "elites_new")})
        for epoch in range(epochs):

            def run(batches: Iterator[pd.DataFrame], epoch: int = epoch, level: int = level) -> Iterator[pd.DataFrame]:
                release()  # the tokenizer's memo
                for pdf in batches:
                    for r in pdf.itertuples(index=False):
                        lengths = np.frombuffer(r.items, _ITEM)["length"].astype(np.int64)
                        migrants = [np.frombuffer(e, np.int64) for e in r.elites]
                        bins, children = evolve(lengths, capacity, [level, int(r.block), int(r.island), epoch], migrants, population, generations, r.island == 0)
                        yield pd.DataFrame({"block": [r.block], "island": [r.island], "items": [r.items], "elite": [bins.astype(np.int64).tobytes()], "n_bins": [int(bins.max()) + 1], "crossovers": [r.crossovers + children], "elites_moved": [r.elites_moved], "elites_new": [r.elites_new]})

            spread = state.repartition(F.xxhash64("block", "island")) if epoch == 0 else state
            evolved = stored(spread.mapInPandas(run, "block long, island int, items binary, elite binary, n_bins long, crossovers long, elites_moved long, elites_new long"), "packing-islands")
            if epoch + 1 < epochs:
                migrants = evolved.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
                moved = [F.col("elites_moved") + F.lit(int(islands > 1)), F.col("elites_new") + (F.col("elite") != F.col("migrant")).cast("long")]
                moved = [c.alias(name) for c, name in zip(moved, ("elites_moved", "elites_new"), strict=True)]
                state = evolved.join(migrants, ["block", "island"]).select("block", "island", "items", "crossovers", *moved, F.array("elite", "migrant").alias("elites"))
        best = evolved.groupBy("block").agg(F.min(F.struct("n_bins", "island", "items", "elite")).alias("b"), *[F.sum(c).cast("long").alias(c) for c in ("crossovers", "elites_moved", "elites_new")])
        best = stored(best.select("block", "b.items", "b.elite", "crossovers", "elites_moved", "elites_new"), "packing-best")
        last = blocks <= 1

        def placed(batches: Iterator[pd.DataFrame], settled: bool, last: bool = last) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    items, bins = np.frombuffer(r.items, _ITEM), np.frombuffer(r.elite, np.int64)
                    fill = np.bincount(bins, items["length"])
                    keep = np.ones(len(fill), bool)
                    if not last:
                        keep[np.argsort(fill, kind="stable")[:passed_on]] = False
                    yield _rows(items, bins, keep if settled else ~keep).assign(block=r.block, crossovers=r.crossovers, elites_moved=r.elites_moved, elites_new=r.elites_new)

        schema = PIECES + ", nameless boolean, bin long, offset long, block long, crossovers long, elites_moved long, elites_new long"
        done = best.mapInPandas(lambda x, f=placed: f(x, True), schema)
        out = out.unionByName(done.withColumn("sequence_id", F.lit(level << 56) + F.col("block") * (1 << 20) + F.col("bin")).drop("bin", "block"))
        if last:
            break
        again = best.mapInPandas(lambda x, f=placed: f(x, False), schema)
        state = _gathered(again.withColumn("block", F.floor(F.col("block") / fan)).drop("bin", "offset", "crossovers", "elites_moved", "elites_new"))
        blocks, level = -(-blocks // fan), level + 1
    doc_id = F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id")
    return out.select(doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "crossovers", "elites_moved", "elites_new")


def pack_documents(df: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = 2048, **pack_args) -> DataFrame:
    return pack(stored(cut_pieces(df, tokenizer_file, end_id, capacity), "pieces"), capacity, **pack_args)
