"""Merkle manifest of a table, and proofs of its rows by octopus multiproofs.

Each row is a leaf. Leaves of a group (a source) in order form a tree: every `fan` consecutive nodes of a level become
one of the next, until one is left, the group's subroot; subroots in order of their groups form the tree of the root.
A digest is the lower-case hex SHA-256 of its parts' texts joined.

Leaves are numbered in their groups by ranges: Spark deals them by (group, order, a salt) and sorts each range, and a
place is the place in the range plus what earlier ranges hold, so a group of any size is dealt over many tasks. Blocks
of fan ** height neighbouring leaves are then the leaf partitions. Going up, a task makes the roots of its blocks;
block roots are leaves of the next tier, in blocks again, so a tree of n leaves takes log(n) / log(fan ** height)
tiers. Going down, a block gets one row: the nodes at the coordinates that `missing` lists for all its leaves
together, which is the least set that its multiproof needs. Each is asked of one block of the tier above, which many
blocks never share (fan ** height at most). From its leaves and these nodes a block derives all interior nodes once,
and expands from them the proof of each leaf. No task holds more than one block, and no group passes through the driver
or one task; the driver knows only the largest group's size.

Defined results: a null field counts as `-`. A null group is a group of its own, before all others; null ids come
first in theirs. Rows that repeat group and id are leaves of their own, ordered by their digests. A row alone in its
group is its subroot; a group alone is the root. A null id is never tampered with. An empty table gives an empty result.
Columns other than the named ones are not read; names that clash with this operator's own do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_NODES = "array<struct<level: int, index: long, hash: string>>"
PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def missing(first: int, last: int, size: int, fan: int = 3) -> list[tuple[int, int]]:
    """Coordinates (level, index) of the nodes that leaves first..last of a tree of `size` leaves need beside
    themselves to reach the root: at each level, the runs' other members that are not known."""
    out, level = [], 0
    while size > 1:
        a, b = first // fan * fan, min((last // fan + 1) * fan, size)
        out += [(level, i) for i in (*range(a, first), *range(last + 1, b))]
        first, last, size, level = first // fan, last // fan, -(-size // fan), level + 1
    return out


def interiors(known: dict[tuple[int, int], str], first: int, last: int, size: int, fan: int, levels: int | None = None) -> tuple[int, int]:
    """Adds to known all nodes above its leaves first..last, each made once, up to the root or `levels` up. Returns
    the coordinates of the last node made."""
    level = 0
    while size > 1 and level != levels:
        for p in range(first // fan, last // fan + 1):
            known[level + 1, p] = digest([known[level, i] for i in range(p * fan, min((p + 1) * fan, size))])
        first, last, size, level = first // fan, last // fan, -(-size // fan), level + 1
    return level, first


def path(index: int, size: int, known: dict[tuple[int, int], str], fan: int) -> Iterator[tuple[list[str], list[str]]]:
    """The siblings to the left and right of a leaf and of each node above it."""
    level = 0
    while size > 1:
        a = index // fan * fan
        yield [known[level, i] for i in range(a, index)], [known[level, i] for i in range(index + 1, min(a + fan, size))]
        index, size, level = index // fan, -(-size // fan), level + 1


def fold(node: str, steps: list[tuple[list[str], list[str]]]) -> str:
    for left, right in steps:
        node = digest([*left, node, *right])
    return node


def _coordinates(nodes: list[dict]) -> dict[tuple[int, int], str]:
    return {(n["level"], n["index"]): n["hash"] for n in nodes}


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row's fields: each its length in bytes, a colon and its text, or a dash for null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(f.cast("string")) for f in fields]), 256)


def numbered(df: DataFrame, group: str, order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """df (stored) with the place `index` of each row in its group, and (group, size). A group's rows lie in
    consecutive ranges; rows equal in all order columns are told apart by a salt, so they spread, too."""
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    by = [group, *order, "_salt"]
    placed = stored(salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt").withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), label)
    ranges = placed.groupBy(group, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("_base", F.coalesce(before, F.lit(0)))
    at = ranges.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_first", "_base")
    out = placed.join(at, placed[group].eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("index", F.col("_place") - F.col("_first") + F.col("_base")).drop("_place", "_range", "_g", "_r", "_first", "_base"), ranges.groupBy(group).agg(F.sum("_n").alias("size"))


def blocked(leaves: DataFrame, per_block: int, carried: list[str]) -> DataFrame:
    """leaves (tree, index, size, hash, carried) as (tree, block, size, hashes, carried...): an array each, of at most
    per_block entries in order."""
    row = F.struct("index", "hash", *carried)
    b = leaves.groupBy("tree", F.floor(F.col("index") / per_block).alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(row)).alias("_l"))
    return b.select("tree", "block", "size", F.col("_l.hash").alias("hashes"), *[F.col(f"_l.{c}").alias(c) for c in carried])


def _batch(rows: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), _NODES: pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string())]))}
    fields = [f.split(" ", 1) for f in schema.replace(_NODES, "nodes").split(", ")]
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([(name, kinds[_NODES if kind == "nodes" else kind]) for name, kind in fields]))


def block_roots(blocks: DataFrame, fan: int, height: int) -> DataFrame:
    """(tree, block, size, root) of each block: up `height` levels, or to the root of a tree that one block holds."""
    per_block, schema = fan**height, "tree long, block long, size long, root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            roots = []
            for block, size, hashes in zip(rows["block"], rows["size"], rows["hashes"], strict=True):
                first = block * per_block
                known = {(0, first + i): x for i, x in enumerate(hashes)}
                roots.append(known[interiors(known, first, first + len(hashes) - 1, size, fan, None if size <= per_block else height)])
            yield _batch({"tree": rows["tree"], "block": rows["block"], "size": rows["size"], "root": roots}, schema)

    return blocks.select("tree", "block", "size", "hashes").mapInArrow(run, schema)


def climb(blocks: DataFrame, largest: int, fan: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each tier, from the leaves up, and (tree, root) of each tree. largest: the most leaves of a tree."""
    per_block, tiers, done = fan**height, [blocks], None
    while True:
        up = stored(block_roots(tiers[-1], fan, height), "merkle-roots")
        ended = up.where(F.col("size") <= per_block).select("tree", "root")
        done = ended if done is None else done.unionByName(ended)
        if largest <= per_block:
            return tiers, done
        largest = -(-largest // per_block)
        rest = up.where(F.col("size") > per_block).select("tree", F.col("block").alias("index"), F.ceil(F.col("size") / per_block).alias("size"), F.col("root").alias("hash"))
        tiers.append(stored(blocked(rest, per_block, []), "merkle-tier"))


def children(blocks: DataFrame, tier: int, fan: int, height: int) -> DataFrame:
    """(tree, index, nodes, above) of each leaf of a tier's blocks: the nodes that `missing` lists for it, found among
    those that the block derives and those it was given, in coordinates of the tree's leaves."""
    per_block, base, schema = fan**height, tier * height, f"tree long, index long, nodes {_NODES}, above {_NODES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"tree": [], "index": [], "nodes": [], "above": []}
            for row in batch.to_pylist():
                first, size = row["block"] * per_block, row["size"]
                known = {(n["level"] - base, n["index"]): n["hash"] for n in row["nodes"]}
                known |= {(0, first + i): x for i, x in enumerate(row["hashes"])}
                interiors(known, first, first + len(row["hashes"]) - 1, size, fan)
                for i in range(first, first + len(row["hashes"])):
                    out["tree"].append(row["tree"])
                    out["index"].append(i)
                    out["nodes"].append([{"level": base + level, "index": k, "hash": known[level, k]} for level, k in missing(i, i, size, fan)])
                    out["above"].append(row["above"])
            yield _batch(out, schema)

    return blocks.select("tree", "block", "size", "hashes", "nodes", "above").mapInArrow(run, schema)


def descend(tiers: list[DataFrame], above: DataFrame | None, fan: int, height: int) -> DataFrame:
    """The blocks of the lowest tier, each with the nodes of its multiproof and what `above` (tree, above) says of its
    tree, if given. Each tier asks the one over it; a tree enters where one block holds it."""
    per_block, got = fan**height, None
    none = F.array().cast(_NODES).alias("nodes")
    for tier in range(len(tiers) - 1, -1, -1):
        blocks = tiers[tier]
        ending = blocks.where(F.col("size") <= per_block).select("tree", "block", none)
        ending = ending.withColumn("above", F.array().cast(_NODES)) if above is None else ending.join(above.select("tree", "above"), "tree")
        asked = ending if got is None else ending.unionByName(got)
        rows = blocks.join(asked, ["tree", "block"])
        if tier:
            got = stored(children(rows, tier, fan, height), "merkle-multiproofs").withColumnRenamed("index", "block")
    return rows


def prove(df: DataFrame, group: str = "source", id_col: str = "doc_id", fields: list[str] | None = None, presented: list[Column] | None = None, fan: int = 3, height: int = 6) -> DataFrame:
    """The leaf, subroot, root and proof digest of each row, and the root that folding its proof gives. fields: the
    columns that a leaf covers; presented: what is shown to the verifier in their place (default: themselves)."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"] if fields is None else fields
    per_block, spark = fan**height, df.sparkSession
    original = leaf_digest([F.col(f) for f in fields])
    shown = original if presented is None else leaf_digest(presented)
    leaves = stored(df.select(F.col(group).cast("string").alias("group"), F.col(id_col).cast("long").alias("id"), original.alias("hash"), shown.alias("shown")), "merkle-leaves")
    placed, sizes = numbered(leaves, "group", ["id", "hash", "shown"], "merkle-leaves-placed")
    # the groups, numbered in their order, are the trees; a number is also the leaf of the tree of the root
    groups, n_groups = numbered(stored(sizes.withColumn("all", F.lit(0)), "merkle-groups"), "all", ["group"], "merkle-groups-placed")
    groups = stored(groups.select("group", "size", F.col("index").alias("tree")), "merkle-trees")
    largest = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    if not largest[1]:
        return spark.createDataFrame([], PROOFS)
    of = groups.withColumnRenamed("group", "_g")
    rows = placed.join(of, F.col("group").eqNullSafe(F.col("_g"))).select("tree", "index", "size", "hash", "shown", "id")
    tiers, subroots = climb(stored(blocked(rows, per_block, ["shown", "id"]), "merkle-blocks"), largest[0], fan, height)
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(largest[1]).cast("long").alias("size"), F.col("root").alias("hash"))
    over, _ = climb(stored(blocked(tops, per_block, []), "merkle-top"), largest[1], fan, height)
    of_group = stored(children(descend(over, None, fan, height), 0, fan, height), "merkle-top-proofs")
    ready = descend(tiers, of_group.select(F.col("index").alias("tree"), F.col("nodes").alias("above")), fan, height)
    n_trees = largest[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, size, hashes, tree = row["block"] * per_block, row["size"], row["hashes"], row["tree"]
                known = _coordinates(row["nodes"])
                if sorted(known) != sorted(missing(first, first + len(hashes) - 1, size, fan)):
                    raise ValueError("the nodes fetched are not those of the multiproof")
                known |= {(0, first + i): x for i, x in enumerate(hashes)}
                subroot = known[interiors(known, first, first + len(hashes) - 1, size, fan)]
                upper = list(path(tree, n_trees, _coordinates(row["above"]) | _ancestors(row["above"], subroot, tree, n_trees, fan), fan))
                root = fold(subroot, upper)
                out: dict[str, list] = {f.split()[0]: [] for f in PROOFS.split(", ")}
                for i, (leaf, shown) in enumerate(zip(hashes, row["shown"], strict=True), first):
                    steps = [*path(i, size, known, fan), *upper]
                    folded = fold(shown, steps)
                    proof = digest([x for left, right in steps for x in (*left, *right)])
                    for name, x in zip(out, (row["id"][i - first], leaf, subroot, root, proof, folded, folded == root), strict=True):
                        out[name].append(x)
                yield _batch(out, PROOFS)

    return ready.select("tree", "block", "size", "hashes", "shown", "id", "nodes", "above").mapInArrow(run, PROOFS)


def _ancestors(nodes: list[dict], leaf: str, index: int, size: int, fan: int) -> dict[tuple[int, int], str]:
    """All nodes on the way of one leaf to the root, from its siblings."""
    known = _coordinates(nodes) | {(0, index): leaf}
    interiors(known, index, index, size, fan)
    return known


#: The levels that the oracle goes up; 3 ** 16 leaves.
_LEVELS = 16


def oracle(fan: int = 3) -> str:
    """The proofs of `documents` in DuckDB SQL: each level from the one below, then all proofs level by level."""
    field = lambda c: f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('CAST(doc_id AS VARCHAR)', 'source', 'lang', 'CAST(n_chars AS VARCHAR)', text))})"
    bits = "list_transform(range(0, 8 * length(CAST(doc_id AS VARCHAR))), lambda b: (ascii(substr(CAST(doc_id AS VARCHAR), CAST(b // 8 + 1 AS INTEGER), 1)) >> CAST(b % 8 AS INTEGER)) & 1)"
    crc = f"xor(list_reduce({bits}, lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    text = f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"

    def levels(name: str, leaves: str) -> list[str]:
        up = lambda n: f"SELECT t, i // {fan} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, CAST(ceil(any_value(n) / {fan}) AS BIGINT) AS n FROM {name}{n} WHERE n > 1 GROUP BY t, i // {fan} UNION ALL SELECT * FROM {name}{n} WHERE n = 1"
        return [f"{name}0 AS MATERIALIZED ({leaves})", *[f"{name}{k + 1} AS MATERIALIZED ({up(k)})" for k in range(_LEVELS)]]

    def walk(name: str, nodes: str, start: str) -> list[str]:
        """(r, t, i, level, l, u, f): the siblings of each row at each level, and what folding gives so far."""
        sides = lambda k, f: f"""SELECT w.r, w.t, w.i, w.f, w.p, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i < w.i), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i > w.i), '') AS u, bool_or(s.n > 1) AS more
FROM {f} w JOIN {nodes}{k} s ON s.t = w.t AND s.i // {fan} = w.i // {fan} GROUP BY ALL"""  # noqa: E731
        step = lambda k: f"SELECT r, t, CASE WHEN more THEN i // {fan} ELSE i END AS i, CASE WHEN more THEN sha256(l || f || u) ELSE f END AS f, p || CASE WHEN more THEN l || u ELSE '' END AS p FROM ({sides(k, f'{name}{k}')})"
        return [f"{name}0 AS MATERIALIZED ({start})", *[f"{name}{k + 1} AS MATERIALIZED ({step(k)})" for k in range(_LEVELS)]]

    last = _LEVELS
    parts = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS h, {leaf('(' + text + ')')} AS shown FROM documents)",
        "o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, shown) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)",
        *levels("n", "SELECT t, i, h, n FROM o"),
        *levels("m", f"SELECT 0 AS t, t AS i, h, count(*) OVER () AS n FROM n{last}"),
        *walk("w", "n", "SELECT r, t, i, shown AS f, '' AS p FROM o"),
        *walk("x", "m", f"SELECT r, 0 AS t, t AS i, f, p FROM w{last}"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, o.h AS leaf, s.h AS subroot, q.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = q.h AS verified FROM o JOIN x{last} x USING (r) JOIN n{last} s ON s.t = o.t, m{last} q"
