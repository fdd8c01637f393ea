"""N-gram Jaccard join by PartEnum signatures.

A text's set holds the 64-bit hashes of its distinct word shingles. Two sets link when their Jaccard
similarity is at least `percent` hundredths. Sets that are equal form one class, known by two hashes, and are
joined by them; the first of these hashes names the class in what follows.

Signatures (partenum): two-level partitions of the feature domain by size band, with enumerated subsets. Every
text is read once for them; sets, bitmaps and signatures are written to the shared folder.

Candidates. Each signature shared by different classes names the smallest of them its leader; a class is a
member of the groups of its signatures' leaders, so all pairs with a common signature meet in a group. There,
the distance of two sets is bounded below by that of their parity bitmaps (2048 bits, folded to 512 for a
first look); pairs beyond the bound of a link are no candidates. The candidate graph's components hold all links
between them, and each set is sent once to its component, where pairs are compared exactly unless connected
already, the nearest by bitmap first. Only links that connect something new are given out, so the output is
linear in a group, not quadratic, and no link between different texts is lost to the components.

Bounds. Groups and components are cut by hash into blocks of bounded size, and all pairs of blocks of a group
are worked on, so no task holds an unbounded group. Which signatures are shared, and which texts are
candidates, also goes to all tasks as a bitmap of a fixed number of bits (`filter_bits`): rows whose bit is not
set are not shuffled a second time. The bitmap has no false negatives; on a corpus that fills it, it only
spares less work.

Skew: equal sets meet by hash with partial aggregation before the shuffle; hot signatures are joined by
joins whose partitions Spark may split; members of hot groups get their block before they are shuffled, and are
dealt by blocks. The list of groups of more than one block is broadcast where it is counted to be short.

Defined results: a text without words, or null, has an empty set and links with nothing; with fewer words
than a shingle, the whole sequence is its only one. Rows of one doc_id are documents of their own that share
that id, whether their texts are equal or not: each gets the component of its own text. Rows whose id is null
link like others, but a component takes its id from rows that have one (null if none has). An empty table gives
an empty result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .components import connected_components
from .partenum import signatures
from .piece_memo import release
from .shingles import M1, M2, mix, shingle_sets

BITS = 2048
FOLD = 4
_SETS = "doc_id long, n_shingles long, h long, g long, map binary, n_signatures long, sigs array<long>"


def parity_bitmaps(features: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit words for each set: each feature flips one; features that differ flip at most one each."""
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    place = (mix(features) >> np.uint64(7)).astype(np.int64) & (BITS - 1)
    bits = (np.bincount(of * BITS + place, minlength=len(ends) * BITS) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(ends), BITS), axis=1).view(np.uint64)


def class_hashes(features: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, as signed numbers."""
    sums = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mix(features + M2), mix(features ^ M1)))
    return tuple(np.diff(s[ends], prepend=np.uint64(0)).view(np.int64) for s in sums)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def connecting_pairs(sizes: np.ndarray, maps: np.ndarray, side: np.ndarray, percent: int, holds) -> list[tuple[int, int]]:
    """Pairs (places) that connect all that is connected by pairs for which holds(i, j) is true, among those
    whose sizes and bitmaps allow a link. side: 0 or 1; if both occur, only pairs across them are looked at
    (pairs within a side are another task's)."""
    order = np.argsort(sizes, kind="stable")
    sizes, side = sizes[order], side[order]
    maps, across, label, out = maps[order], side.min() != side.max(), np.arange(len(sizes)), []
    folded = np.bitwise_xor.reduce(maps.reshape(len(sizes), FOLD, -1), axis=1)
    ends = np.searchsorted(sizes, sizes * 100 // percent, "right")
    for i in range(len(sizes) - 1):
        j = np.arange(i + 1, ends[i])
        j = j[label[j] != label[i]]
        if across:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        most = (sizes[i] + sizes[j]) * (100 - percent) // (100 + percent)
        near = np.bitwise_count(folded[j] ^ folded[i]).sum(1) <= most
        j, most = j[near], most[near]
        distance = np.bitwise_count(maps[j] ^ maps[i]).sum(1)
        near = np.flatnonzero(distance <= most)
        for k in j[near[np.argsort(distance[near], kind="stable")]].tolist():
            if label[k] != label[i] and holds(order[i], order[k]):
                label[label == label[k]] = label[i]
                out.append((order[i], order[k]))
    return out


def _sets(docs: DataFrame, width: int, what, schema: str, bits=None, filter_bits: int = 1) -> DataFrame:
    """docs (doc_id, text) mapped by what(doc ids, features, ends), which gives columns of the schema. With `bits`,
    only documents whose id's bit is set; it is looked up here, as a UDF before would keep a second Python worker
    for each core, with all that a worker holds, through the later stages of a pipeline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(_is_set(bits.value, batch.column(2).to_numpy())))
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in slices(map(len, texts), 1_000_000):
                yield pa.RecordBatch.from_pydict(what(ids.slice(start, end - start), *shingle_sets(texts[start:end], width)))

    where = [] if bits is None else [_place("doc_id", filter_bits)]
    return docs.select("doc_id", "text", *where).mapInArrow(run, schema)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.view(np.int64)))


def _measured(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def measure(ids: pa.Array, features: np.ndarray, ends: np.ndarray) -> dict:
        h, g = class_hashes(features, ends)
        maps = parity_bitmaps(features, ends)
        sigs, last = signatures(features, ends, percent)
        return {"doc_id": ids, "n_shingles": np.diff(ends, prepend=0), "h": h, "g": g, "map": pa.array([m.tobytes() for m in maps], pa.binary()), "n_signatures": np.diff(last, prepend=0), "sigs": _lists(sigs, last)}

    return _sets(docs, width, measure, _SETS)


def _bits(df: DataFrame, column: str, filter_bits: int):
    """A broadcast bitmap of fixed size with the bit of each value set; false positives only."""
    at = _place(column, filter_bits) + 1  # the bitmap functions count from 1
    parts = df.select(at.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    held = np.zeros(filter_bits // 8, np.uint8)
    for r in parts:
        start = (r["n"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(held) - start]
        held[start : start + len(part)] |= part
    return df.sparkSession.sparkContext.broadcast(held)


def _place(column: str, filter_bits: int) -> Column:
    """The bit of a value; numbers here are hashes or are hashed."""
    return F.pmod(F.xxhash64(column) if column == "doc_id" else F.col(column), F.lit(filter_bits))


def _is_set(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bit_is_set(column: str, bits, filter_bits: int) -> Column:
    @F.pandas_udf("boolean")
    def is_set(at: pd.Series) -> pd.Series:
        return pd.Series(_is_set(bits.value, at.to_numpy()))

    return is_set(_place(column, filter_bits))


def _passing(sets: DataFrame, bits, filter_bits: int) -> DataFrame:
    """(sig, h) of the signatures whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sigs = lists.flatten().to_numpy()
            on = _is_set(bits.value, sigs & (filter_bits - 1))
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_pydict({"sig": sigs[on], "h": owner[on]})

    return sets.select("h", "sigs").mapInArrow(run, "sig long, h long")


def _tasks(members: DataFrame, group: str, weight, most: int, few: int = 50_000) -> DataFrame:
    """members dealt to tasks (group, i, j): every pair of the group's blocks of about `most` weight."""
    hot = stored(members.groupBy(group).agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks")).where("blocks > 1"), "hot-groups")
    hot = F.broadcast(hot) if hot.count() <= few else hot
    placed = members.join(hot, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other", "blocks")


def _by_task(df: DataFrame, columns: list[str], work) -> DataFrame:
    """work(columns) -> [(place, place)] for each task of two members or more; gives pairs of h."""
    key = ["group", "i", "j"]
    df = df.select(*key, "h", *columns).repartition(*key).sortWithinPartitions(*key)

    def pairs(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = held[0] if len(held) == 1 else pd.concat(held)
        if len(pdf) > 1:
            h = pdf["h"].to_numpy()
            if found := work(*[pdf[c].to_numpy() for c in columns]):
                yield pd.DataFrame(h[np.array(found)], columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        last, held = None, []
        for pdf in batches:
            keys = pdf[key].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(pdf)]
            out: list[pd.DataFrame] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and tuple(keys[a]) != last:
                    out += pairs(held)
                    held = []
                last = tuple(keys[a])
                held.append(pdf.iloc[a:b])
            if out:
                yield pd.concat(out)
        if held:
            yield from pairs(held)

    return df.mapInPandas(run, "a long, b long")


def _maps(maps: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)


def join(df: DataFrame, width: int = 5, percent: int = 80, block_sets: int = 3000, block_features: int = 4_000_000, filter_bits: int = 1 << 26, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and n_signatures (enumerated for its
    set; 0 where only equal sets link) of every document."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    measured = stored(_measured(docs, width, percent), "shingle-sets")
    sets = measured.where("n_shingles > 0")

    shared = sets.select("h", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.min("h").alias("group"), F.max("h").alias("last")).where("group <> last").drop("last")
    shared = stored(shared, "shared-signatures")
    members = stored(_passing(sets, _bits(shared, "sig", filter_bits), filter_bits).join(shared, "sig").select("group", "h").distinct(), "group-members")
    grouped = sets.where(_bit_is_set("h", _bits(members, "h", filter_bits), filter_bits))
    shapes = stored(grouped.groupBy("h").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"), F.min("map").alias("map")), "group-shapes")

    def candidates(n: np.ndarray, maps: np.ndarray, side: np.ndarray) -> list:
        return connecting_pairs(n, _maps(maps), side, percent, lambda i, j: True)

    placed = _tasks(members.join(shapes.drop("doc_id"), "h"), "group", F.lit(1), block_sets)
    coarse = connected_components(_by_task(placed, ["n", "map", "side"], candidates), "a", "b")
    wanted = stored(coarse.join(shapes, coarse["node"] == shapes["h"]).select(F.col("component").alias("group"), "h", "n", "map", "doc_id"), "candidates")

    def features(ids: pa.Array, features: np.ndarray, ends: np.ndarray) -> dict:
        raw = features.view(np.uint8)
        return {"h": class_hashes(features, ends)[0], "features": pa.array([raw[8 * a : 8 * b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)], pa.binary())}

    of_class = _sets(docs, width, features, "h long, features binary", _bits(wanted, "doc_id", filter_bits), filter_bits).dropDuplicates(["h"])

    def links(n: np.ndarray, maps: np.ndarray, side: np.ndarray, features: np.ndarray) -> list:
        sets = [np.frombuffer(x, np.uint64) for x in features]
        return connecting_pairs(n, _maps(maps), side, percent, lambda i, j: linked(sets[i], sets[j], percent))

    dealt = _tasks(wanted.drop("doc_id"), "group", F.col("n"), block_features).join(of_class, "h")
    component = connected_components(_by_task(dealt, ["n", "map", "side", "features"], links), "a", "b")
    classes = sets.groupBy("h", "g").agg(F.min("doc_id").alias("rep")).join(component.withColumnRenamed("node", "h"), "h", "left")
    least = classes.groupBy(F.coalesce("component", "h").alias("component")).agg(F.min("rep").alias("component_id"))
    named = classes.withColumn("component", F.coalesce("component", "h")).join(least, "component").select("h", "g", "component_id")
    out = measured.select("doc_id", "n_shingles", "n_signatures", "h", "g").join(named, ["h", "g"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "n_signatures")


def one_of_each(df: DataFrame, filter_bits: int = 1 << 26, **join_args) -> DataFrame:
    """The rows of df (with doc_id and text) but those that link to a smaller doc_id, with df's columns. Only
    rows that may be such ones are shuffled. Rows without an id stay, and rows that share an id stay or go together
    by the one of them that links to the smallest id."""
    found = stored(join(df, filter_bits=filter_bits, **join_args).where("component_id < doc_id").select("doc_id").distinct(), "linked")
    bit = F.coalesce(_bit_is_set("doc_id", _bits(found, "doc_id", filter_bits), filter_bits), F.lit(False))
    return df.where(~bit).unionByName(df.where(bit).join(found, "doc_id", "left_anti").select(df.columns))
