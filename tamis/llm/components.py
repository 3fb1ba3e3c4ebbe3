"""Connected components of an edge table by alternating large-star and small-star steps.

Every step replaces each node's edges by edges to the smallest node it knows. Minima are aggregated with
map-side combining and joined back by node, which adaptive execution splits where one node has many edges.
The number of rounds grows with the logarithm of the component size, and edges never multiply. Each round
is checkpointed into the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import cut_lineage


def _to_minimum(edges: DataFrame) -> DataFrame:
    """(node, other, least) with ``least`` the smallest of a node and its others."""
    least = edges.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("least"))
    return edges.join(least, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    near = _to_minimum(both).where("other > node")
    return near.select(F.col("other").alias("node"), F.col("least").alias("other")).where("node != other")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    near = _to_minimum(down)
    links = near.select(F.col("other").alias("node"), F.col("least").alias("other"))
    own = near.select("node", F.col("least").alias("other"))
    return links.unionByName(own).where("node != other")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge other than a loop: the smallest node it is connected to.

    ``edges``: columns ``node`` and ``other`` of one ordered type; direction, repeats and loops don't matter.
    """
    now, seen = cut_lineage(edges.where("node != other").select("node", "other").distinct()), None
    while True:
        now = cut_lineage(_small_star(_large_star(now)).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.groupBy("node").agg(F.min("other").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
