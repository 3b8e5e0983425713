"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges stay in Spark; every round halves distances at least and is written to the shared
folder, so neither lineage nor the driver grows with the data. The neighbours of one node
are never gathered: minima are combined before the shuffle, and each join is between two
plain exchanges that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.session import shared_table


def _minimum(edges: DataFrame) -> DataFrame:
    """Each node u with the least of itself and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = shared_table(_minimum(both), "large-star")
    return both.join(least.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = shared_table(_minimum(down), "small-star")
    moved = down.join(least.hint("shuffle_merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for each node of the two bigint columns of `edges`.

    The component is its least node. Loops and repeated edges are fine; no edges, no rows.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = shared_table(now, "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = shared_table(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
