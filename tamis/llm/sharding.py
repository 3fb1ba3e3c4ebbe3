"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. A row descends it level by level: every child of the node it
stands in draws ``-ln(u) / weight`` with ``u`` from the md5 of the row's key and the child's path, and
the smallest draw wins, so a child is taken in proportion to its weight. A draw depends on nothing
else. When a weight changes, only the draws of that node and of the nodes above it change, so rows
move between a changed subtree and the others, and never between two subtrees that did not change.

``tree(n, base)`` builds the tree of a shard count: ``base`` shards in full regions, and every shard
beyond as a region of its own. One more shard therefore takes rows only into itself.

Defined cases: a null key draws as the empty string; a null text has no bytes; rows with the same key
go to the same shard and get neighbouring slots; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.session import cut_lineage

LEVELS = ("region", "rack", "shard")
SLOT_GROUP = 20_000  # rows that one task ranks, about


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0

    @property
    def paths(self) -> tuple[str, str, str]:
        return self.region, f"{self.region}/{self.rack}", f"{self.region}/{self.rack}/{self.shard}"


def tree(shards: int, base: int | None = None, per_rack: int = 4, per_region: int = 8) -> list[Leaf]:
    """The tree of a shard count; shards from ``base`` on hang as regions of their own."""
    base = shards if base is None else min(base, shards)
    inner = [Leaf(f"g{s // per_region}", f"k{s // per_rack}", s) for s in range(base)]
    return inner + [Leaf(f"x{s}", f"x{s}", s) for s in range(base, shards)]


def reweighted(leaves: list[Leaf], shard: int, weight: float) -> list[Leaf]:
    return [replace(leaf, weight=weight) if leaf.shard == shard else leaf for leaf in leaves]


def nodes(leaves: list[Leaf]) -> list[tuple[str, str, str, float, int | None]]:
    """(level, parent path, path, weight, shard) of every node; a node weighs what its leaves weigh."""
    found: dict[tuple[str, str, str], float] = {}
    shard_of = {leaf.paths[2]: leaf.shard for leaf in leaves}
    for leaf in leaves:
        if not leaf.weight > 0:
            continue
        parents = ("", *leaf.paths[:2])
        for level, parent, path in zip(LEVELS, parents, leaf.paths):
            found[level, parent, path] = found.get((level, parent, path), 0.0) + leaf.weight
    return [(level, parent, path, weight, shard_of.get(path)) for (level, parent, path), weight in found.items()]


def unit(key: Column, path: Column) -> Column:
    """A draw in (0, 1) from the md5 of key and path."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("@"), path)), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: three weighted draws, one on each level."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    at = F.lit("")
    for level in LEVELS:
        children: dict[str, list[Column]] = {}
        for where, parent, path, weight, _ in nodes(leaves):
            if where == level:
                children.setdefault(parent, []).append(F.struct(F.lit(path).alias("path"), F.lit(weight).alias("weight")))
        below = F.create_map(*[x for parent, rows in children.items() for x in (F.lit(parent), F.array(*rows))])
        draws = F.transform(
            F.element_at(below, at),
            lambda child: F.struct((-F.log(unit(key, child["path"])) / child["weight"]).alias("draw"), child["path"].alias("path")),
        )
        at = F.array_min(draws)["path"]
    return F.element_at(F.split(at, "/"), -1).cast("int")


def with_shard(df: DataFrame, key: str, leaves: list[Leaf], name: str = "shard") -> DataFrame:
    """``df`` with the shard of every row. Row-local; no shuffle."""
    return df.withColumn(name, descend(F.col(key), leaves))


def with_slots(df: DataFrame, shard: str, key: str, group: int = SLOT_GROUP) -> DataFrame:
    """``df`` with ``slot``: 0, 1, 2, ... within each shard, by the md5 of the key and then by all columns.

    No task sees a whole shard: the md5's first digits cut a shard into ranges of about ``group`` rows,
    ranks are taken within a range and shifted by the rows of the ranges before it. Equal rows are
    counted before the shuffle and spread out afterwards, so a repeated row is no hot key.
    """
    columns = df.columns
    hashed = df.withColumn("_hash", F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    counted = cut_lineage(hashed.groupBy("_hash", *columns).agg(F.count("*").alias("_rows")))
    total = counted.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.countDistinct(shard).alias("shards")).first()
    digits = 0
    while max(1, total["shards"]) * 16**digits * group < total["rows"]:
        digits += 1
    ranged = counted.withColumn("_range", F.substring("_hash", 1, digits) if digits else F.lit(""))
    sizes = ranged.groupBy(shard, "_range").agg(F.sum("_rows").alias("_rows"))
    before = sizes.select(
        F.col(shard).alias("_shard"),
        F.col("_range").alias("_at"),
        F.expr(f"sum(_rows) OVER (PARTITION BY `{shard}` ORDER BY _range) - _rows").alias("_before"),
    )
    order = ", ".join(["_hash", *[f"`{c}`" for c in columns]])
    ranked = ranged.withColumn(
        "_first",
        F.expr(f"sum(_rows) OVER (PARTITION BY `{shard}`, _range ORDER BY {order} ROWS UNBOUNDED PRECEDING) - _rows"),
    )
    joined = ranked.join(before, (F.col(shard) == F.col("_shard")) & (F.col("_range") == F.col("_at")))
    first = F.col("_before") + F.col("_first")
    return joined.select(*columns, F.explode(F.sequence(first, first + F.col("_rows") - 1)).alias("slot"))


def write_shards(df: DataFrame, key: str, leaves: list[Leaf], path: str, files: int = 1) -> None:
    """Write the rows as one folder per shard (``shard=<n>``), each in about ``files`` files."""
    sharded = with_shard(df, key, leaves)
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    sharded.repartition("shard", part).write.partitionBy("shard").parquet(path)
