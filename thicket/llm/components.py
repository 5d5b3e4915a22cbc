"""Connected components of a graph whose edges are a table.

Alternating large and small stars (Kiveris and others, 2014), with minima by aggregation and joins, so
no neighbourhood is ever gathered; each round's edges are written to the shared folder. A node with many
neighbours is spread over tasks where edges meet their node's minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


SPREAD = 8


def meet(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """`rows` with the row of their key in `one`; rows of a hot key go to SPREAD tasks, by a hash of `by`."""
    every = one.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("_slot", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(every, [key, "_slot"]).drop("_slot")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large: a node's larger neighbours go to the least of all its
    neighbours and itself. Small: a node and its smaller neighbours go to the least of them."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = meet(both.filter("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = meet(edges, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = scratch.table(now, "edges")
    state = None
    while True:
        now = scratch.table(_star(_star(now, True), False), "stars")
        was, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
