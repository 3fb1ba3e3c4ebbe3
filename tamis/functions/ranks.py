"""Exact-size hash samples per group without a global sort and without lists on the driver.

The rows of a group at wanted ranks of the 60-bit draw are found in two steps: counts per (group, 16-bit
prefix), combined map-side, tell the prefix of each rank, and only the rows of those prefixes are ordered,
each prefix by itself. The limits are a table with one row per group; a sample is a join with it and a
comparison, whatever the number and size of the groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.keys import ROW_ID, long_draw

DRAW_BITS = 60
PREFIX_BITS = 16


def rank_limits(df: DataFrame, ranks: Callable[[Column], list[Column]], use: str = "degree", group: Column | None = None) -> DataFrame:
    """(g, n, wanted, limits): per group its size, the 1-based ranks ``ranks(n)`` and the (draw, row_id) of the
    rows there. A rank below 1 or beyond the end has a NULL limit.
    """
    shift = DRAW_BITS - PREFIX_BITS
    base = df.select((group if group is not None else F.lit(0)).alias("g"), long_draw(use).alias("h"), F.col(ROW_ID))
    base = base.withColumn("p", F.shiftright("h", shift))
    counts = base.groupBy("g", "p").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("g")
    placed = counts.withColumn("n", F.sum("m").over(whole)).withColumn("before", F.sum("m").over(whole.orderBy("p")) - F.col("m"))
    asked = placed.select("g", "p", "m", "before", F.posexplode(F.array(*[k.cast("long") for k in ranks(F.col("n"))])).alias("j", "k"))
    hit = asked.where((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("m"))).select(
        F.col("g").alias("hg"), F.col("p").alias("hp"), "j", (F.col("k") - F.col("before")).alias("at")
    )
    same = base["g"].eqNullSafe(F.col("hg")) & (base["p"] == F.col("hp"))
    near = base.join(hit.select("hg", "hp").distinct(), same, "left_semi")
    ordered = near.withColumn("r", F.row_number().over(Window.partitionBy("g", "p").orderBy("h", ROW_ID)))
    ranked = ordered.select("g", "p", "r", F.struct("h", F.col(ROW_ID).alias("row")).alias("limit"))
    found = ranked.join(hit, ranked["g"].eqNullSafe(F.col("hg")) & (ranked["p"] == F.col("hp")) & (F.col("r") == F.col("at")))
    number = len(ranks(F.lit(1)))
    limits = found.groupBy("g").agg(F.array(*[F.max(F.when(F.col("j") == j, F.col("limit"))) for j in range(number)]).alias("limits"))
    sizes = counts.groupBy("g").agg(F.sum("m").alias("n")).withColumnRenamed("g", "sg")
    return sizes.join(limits, sizes["sg"].eqNullSafe(limits["g"]), "left").select(
        F.col("sg").alias("g"), "n", F.array(*[k.cast("long") for k in ranks(F.col("n"))]).alias("wanted"), "limits"
    )


def with_ranks_below(
    df: DataFrame, ranks: Callable[[Column], list[Column]], names: list[str], use: str = "degree", group: Column | None = None
) -> DataFrame:
    """``df`` with one boolean per rank: whether the row's own rank is at most that rank of its group."""
    table = rank_limits(df, ranks, use, group).select(
        F.col("g").alias("__g"), F.col("n").alias("__n"), F.col("wanted").alias("__wanted"), F.col("limits").alias("__limits")
    )
    if group is None:
        joined = df.join(F.broadcast(table), F.lit(True), "left")  # one row
    else:
        keyed = df.withColumn("__key", group)
        joined = keyed.join(table, F.col("__key").eqNullSafe(F.col("__g")), "left").drop("__key")
    h = long_draw(use)

    def below(j: int) -> Column:
        limit, k = F.get("__limits", F.lit(j)), F.get("__wanted", F.lit(j))
        return (k >= F.col("__n")) | ((k >= 1) & ((h < limit["h"]) | ((h == limit["h"]) & (F.col(ROW_ID) <= limit["row"]))))

    marked = [F.coalesce(below(j), F.lit(False)).alias(name) for j, name in enumerate(names)]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *marked)
