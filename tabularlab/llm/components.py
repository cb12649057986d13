"""Connected components of an edge table, as alternating large-star and small-star rounds.

Every round is two aggregations and joins over the edges; no neighbour list,
component or node set is ever gathered in one task or on the driver.  Hub
nodes are handled by map-side combined minima and by skew-split joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularlab.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).union(moved).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def component_roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links of long ids -> (node, root): the smallest id reachable, for every
    node that is not a root itself.  Nodes without links are not listed."""
    now = scratch.table(edges.where("u <> v"), "edges")
    state = _state(now)
    while True:
        after = scratch.table(_small_star(_large_star(now)), "edges")
        new = _state(after)
        scratch.drop(now)
        now = after
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
