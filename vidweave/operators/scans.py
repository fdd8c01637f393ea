"""Ordered work on a key of any size: blocked prefix scans, chains of pointers, and ordered folds of maps.

None of these puts a key's rows into one task. A key's rows are cut into ranges of their order (of time, or as Spark
deals them); each range is worked on by itself, its summary is one row, and what a range needs from those before it
is carried over the summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidweave.sources.storage import stored


@dataclass(frozen=True)
class Scan:
    """A running value: `sum`, `max`, or `last` (the last one that is not null) of a column in the scan's order, over
    the rows before each row (with `reverse`, those after it, from the end on), and the row itself if `inclusive`."""

    name: str
    kind: str
    value: Column
    inclusive: bool = False
    reverse: bool = False


_FOLD = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _summary(s: Scan, order: list[str]) -> Column:
    if s.kind != "last":
        return _FOLD[s.kind](s.value)
    return (F.min_by if s.reverse else F.max_by)(s.value, F.when(s.value.isNotNull(), F.struct(*order)))


def _both(kind: str, near: Column, far: Column) -> Column:
    """A value within the range, and what the ranges before it add."""
    if kind == "sum":
        return F.when(near.isNull(), far).otherwise(near + F.coalesce(far, F.lit(0)))
    return F.greatest(near, far) if kind == "max" else F.coalesce(near, far)


def prefix_scan(df: DataFrame, key: str, at: Column, width: int, order: list[str], scans: list[Scan]) -> DataFrame:
    """df with a column for each scan, run over each key's rows in order.

    at: the number that the order begins with; rows are dealt by key and range, floor(at / width). Windows run within
    a range; a summary of each range is carried over a key's ranges, a row each. df is written once, as both need it:
    in a row of scans, each would else be computed twice by the next. A null key is a key of its own. The order should
    be total: rows that tie have no defined order, as in any window."""
    df = stored(df.withColumn("_range", F.floor(at / width)), "scan")
    turned = lambda s, c: F.desc(c) if s.reverse else F.asc(c)
    parts = df.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(*[_summary(s, order).alias(f"_{s.name}") for s in scans])
    earlier = lambda s: Window.partitionBy("_key").orderBy(turned(s, "_of")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_key", "_of", *[_FOLD[s.kind](f"_{s.name}").over(earlier(s)).alias(f"_{s.name}") for s in scans])
    out = df.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_of")))
    for s in scans:
        within = Window.partitionBy(key, "_range").orderBy(*[turned(s, c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        out = out.withColumn(s.name, _both(s.kind, _FOLD[s.kind](s.value).over(within), F.col(f"_{s.name}")))
    return out.drop("_key", "_of", "_range", *[f"_{s.name}" for s in scans])


def chain(pointers: DataFrame, key: str, start: int = 0) -> DataFrame:
    """(key, at) of the rows that are met from place `start` of each key on by following the pointers (key, at, to; a
    null `to` ends it; places are unique in a key).

    By pointer doubling: after a round, the places known are twice as many and the pointers reach twice as far, so a
    chain of n places takes log2(n) rounds. The joins are on (key, place), so a long chain of one key spreads."""
    jump = stored(pointers.select(F.struct(F.col(key)).alias("_k"), "at", "to"), "pointers")  # a struct equals itself even if its key is null
    known = jump.where(F.col("at") == start).select("_k", "at")
    while True:
        further = stored(known.join(jump, ["_k", "at"]).where("to IS NOT NULL").select("_k", F.col("to").alias("at")), "chain")
        if further.isEmpty():
            return known.select(F.col(f"_k.{key}").alias(key), "at")
        known = stored(known.unionByName(further), "chain-known")
        beyond = jump.where("to IS NOT NULL").select("_k", F.col("at").alias("to"), F.col("to").alias("_far"))
        jump = stored(jump.join(beyond, ["_k", "to"]).select("_k", "at", F.col("_far").alias("to")), "pointers")


def ordered_fold(rows: DataFrame, key: str, order: list[str], first: Callable[[Column], Column], item: list[str], merge: Callable[[Column, Column], Column], run: int = 512) -> DataFrame:
    """(key, folded): each key's rows folded in order by an associative merge of maps.

    first(items) folds an array of structs (the columns `item`, in order, at most `run` of them) to a map; merge(f, g)
    is the map that does f and then g. Spark deals the rows by ranges of (key, order), so a hot key is in many; in a
    range, runs of a bounded number of rows are folded, then the runs of a range, then the ranges of a key. run: a power
    of two."""
    placed = rows.select(key, *order, *[c for c in item if c not in order]).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    runs = placed.groupBy(key, F.expr(f"_at div {run}").alias("_run")).agg(F.array_sort(F.collect_list(F.struct("_at", *item))).alias("_items")).select(key, "_run", first(F.col("_items")).alias("_map"))

    def folded(df: DataFrame, by: Column | None) -> DataFrame:
        keys = [key] if by is None else [key, by.alias("_run2")]
        by_run = lambda a, b: F.when(a["_run"] < b["_run"], -1).when(a["_run"] > b["_run"], 1).otherwise(0)
        g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_run", "_map")), by_run).alias("_maps"))  # maps have no order
        rest = F.slice("_maps", 2, F.greatest(F.lit(0), F.size("_maps") - 1))
        whole = F.aggregate(rest, F.get("_maps", 0)["_map"], lambda f, g: merge(f, g["_map"]))
        return g.select(key, *([] if by is None else [F.col("_run2").alias("_run")]), whole.alias("_map"))

    in_ranges = folded(runs, F.expr(f"_run div {(1 << 33) // run}"))
    return folded(in_ranges, None).select(key, F.col("_map").alias("folded"))
