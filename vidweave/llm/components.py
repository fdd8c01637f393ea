"""Connected components of a graph given as edges, by iterated minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node it reaches.

    Each round replaces the edges by ones to smaller nodes: every node learns the smallest node among
    itself and its neighbours, and all its larger neighbours are joined to that one (a star contraction).
    The graph keeps its components, and their depth shrinks by more than half a round, so the rounds grow
    with the logarithm of the longest path. Rounds are written to the shared folder, which cuts the lineage.
    A node with very many neighbours is handled by partial aggregation and by joins whose hot partitions
    Spark may split; no neighbour list is ever gathered. Ends when a round changes nothing; raises if
    `most_rounds` did not suffice rather than give a partial answer."""
    current = stored(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = current.union(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        # larger neighbours go to the least of the neighbourhood
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        # then, of what lies below a node, all go to the smallest
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        current = stored(small, "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(current.select("lo", "lo").distinct())
