"""Exact k nearest neighbours through a ball tree of two levels, kept as tables.

Donors fall into balls around sampled centers: some (the square root of the number of leaves) at the top, and inside
each of them leaves around centers of their own, so a row is compared with about twice that root and not with all
centers. Both counts grow with the donors: a leaf holds about half a block, however many rows there are. Queries fall
into the same balls. Then, before any row moves, balls are matched with balls: the distance of two centers and both
radii bound the distance of all their rows, the sizes of the donors' balls bound the k-th distance from above, and a
pair of balls that cannot hold one of the k is dropped; first at the top, then among the leaves of what is left. At
last every query looks at the leaves its own leaf was matched with, drops those too far for it alone, and meets the
others in bundles: in many dimensions leaves of one top ball travel together, and a query moves once for all leaves of
a bundle, with their numbers, and brings one list of neighbours back. So the rows shuffled are the queries times the bundles they
need, and each donor once per block of queries of its bundle. Where leaves travel alone and many meet, balls bound the k-th
distance too loosely: the leaves closest to a query are searched first, and the distance found there drops the others.
The rows that will move are counted before they do, and tasks grow with them.

Missing coordinates follow the usual rule: the squared distance over shared coordinates is scaled by (all coordinates /
shared coordinates). Rows with other coordinates missing lie in balls of their own; the bounds hold on what both sides
share. Patterns rarer among donors than the ``PATTERNS`` most frequent ones share balls that are never dropped.
Equal donors beyond the k that can matter are removed first, map-side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import cut_lineage

DONOR_BLOCK = 4_096
QUERY_BLOCK = 4_096
BUNDLE = 8  # blocks of donors that meet at once, at most
BUNDLE_VALUES = 1 << 22  # coordinates of a bundle's donors, where a block has fewer
TOP_BALLS = 1 << 16  # rows of the table of top balls at most: fewer centers where there are many patterns
PATTERNS = 256
CHUNK = 512
TASK_BYTES = 1 << 27  # rows that a task of the search takes and gives, as estimated before they move
FEW_TASKS = 8  # up to so many, one pass is taken
CLOSEST = 2  # leaves searched first
FEW_ROWS = 100_000  # rows of a table of balls that is broadcast; larger ones are joined by shuffle
RARE = "*"
NO_WANT = -1

# slack on the bounds, far above the rounding of the distances of centers
SLACK = 1e-6
# relative rounding of an estimated distance, far above that of a product of matrices
ROUNDING = 1e-12


@dataclass
class Tree:
    """Centers of both levels and the donors in their leaves.

    ``tops``: centers, one row each; ``subs``: (top, sub, center), the centers of the leaves; ``donors``: (did, dv,
    kind, top, sub, top_far, far) with the distances from both centers; ``kinds``: patterns with balls of their own.
    """

    dims: int
    tops: np.ndarray
    kinds: frozenset[str]
    subs: DataFrame
    donors: DataFrame
    block: int


def nearest(
    queries: DataFrame,
    donors: DataFrame,
    k: int,
    dims: int,
    skip_self: bool = False,
    donor_block: int = DONOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Rows ``(qid, want, rank, dist2, did, value)`` for the k nearest donors of each query.

    ``queries``: qid, qv array<double>, want int (coordinate the donor must have, or -1).
    ``donors``: did, dv array<double>. Ties go to the smaller did. ``value`` is the donor's wanted
    coordinate. ``dist2`` is the squared (scaled) distance.
    """
    need = k + (1 if skip_self else 0)
    id_type = donors.schema["did"].dataType.simpleString()
    out_schema = f"qid {id_type}, want int, dist2 double, did {id_type}, value double"
    tree = build_tree(donors, dims, need, donor_block)
    if tree is None:
        return donors.sparkSession.createDataFrame([], out_schema + ", rank int")
    placed, matched = match(tree, queries, need, query_block)
    layout = matched.groupBy("leaf").agg(*[F.first(c).alias(c) for c in ("bundle", "number", "rows", "d_parts", "q_parts")])
    # no query moves for more bundles than its leaf was matched with
    asking = matched.select("bundle", "pattern", "want", "q_top", "q_sub", F.expr("q_rows * d_parts AS moved")).distinct()
    copies = F.sum(F.col("rows") * F.col("q_parts"))
    moved = (asking.agg(F.sum("moved")).first()[0] or 0) + (layout.agg(copies).first()[0] or 0)
    row_bytes = 100 + 8 * dims + 80 * k

    partitions = int(donors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(left: DataFrame, layout: DataFrame, tasks: int) -> DataFrame:
        right = (
            small(tree.donors.withColumn("leaf", leaf_name("kind", "top", "sub")), layout, "leaf")
            .withColumn("dpart", F.pmod(F.xxhash64("did"), F.col("d_parts")).cast("int"))
            .select("did", "dv", "number", "bundle", "dpart", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("qpart"))
        )
        keys = ["bundle", "qpart", "dpart"]
        if tasks:
            left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
        local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_bundle_search(k, dims, skip_self, donor_block), out_schema)
        best = Window.partitionBy("qid", "want").orderBy("dist2", "did")
        local = local.repartition(tasks, "qid", "want") if tasks else local
        return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    tasks = -(-moved * row_bytes // TASK_BYTES)
    if bundled(dims, tree.block) > 1 or tasks <= FEW_TASKS:
        # no more than those of any shuffle: Spark deals as it sees fit
        return search(candidates(tree, placed, matched, need, query_block), layout, tasks if tasks > partitions else 0)

    def counted(left: DataFrame) -> DataFrame:
        """The search of candidates that are held, in as many blocks of queries as they are."""
        left = cut_lineage(left.drop("qpart"))
        met = left.groupBy("bundle").agg(F.count("*").alias("n"), F.ceil(F.count("*") / query_block).cast("int").alias("q_parts"))
        laid = cut_lineage(layout.drop("q_parts").join(met, "bundle"))
        parts = laid.select("bundle", "q_parts").distinct()
        left = small(left, parts, "bundle").withColumn("qpart", F.pmod(F.xxhash64("qid", "want"), F.col("q_parts")).cast("int"))
        moved = parts.join(met, ["bundle", "q_parts"]).agg(F.sum("n")).first()[0] or 0
        moved += laid.agg(copies).first()[0] or 0
        return search(left.drop("q_parts"), laid.drop("n"), max(partitions, -(-moved * row_bytes // TASK_BYTES)))

    first = counted(candidates(tree, placed, matched, need, query_block, closest=CLOSEST))
    bound = first.where(F.col("rank") == k).select("qid", "want", F.sqrt("dist2").alias("bound"))
    bounded = placed.join(bound, ["qid", "want"], "left").fillna(math.inf, ["bound"])
    return counted(candidates(tree, bounded, matched, need, query_block))


def bundled(dims: int, block: int) -> int:
    """Blocks in a bundle. In few dimensions bounds drop most leaves and small bundles move least; in many nearly all leaves meet."""
    return max(1, min(BUNDLE, dims // 4, BUNDLE_VALUES // max(dims * block, 1)))


def small(rows: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """Join with a table of balls: broadcast where it has few rows, else by shuffle."""
    few = table.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return rows.join(F.broadcast(table) if few else table, list(on))


def leaf_name(*parts: str) -> Column:
    return F.concat_ws(":", *[F.col(p).cast("string") for p in parts])


# --- building ---------------------------------------------------------------------------------------


def build_tree(donors: DataFrame, dims: int, need: int, block: int = DONOR_BLOCK) -> Tree | None:
    """None without donors."""
    same = Window.partitionBy("dv").orderBy("did")
    distinct = cut_lineage(
        donors.select("did", "dv", F.row_number().over(same).alias("copy")).where(F.col("copy") <= need).drop("copy")
    )
    total = distinct.count()
    if not total:
        return None
    leaves = max(1, -(-2 * total // block))
    frequent = distinct.mapInArrow(_with_pattern, "kind string").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(PATTERNS).collect()
    kinds = frozenset(r["kind"] for r in frequent)
    # grows with the root of the rows; the table of top balls stays bounded
    count = max(1, min(math.isqrt(leaves), TOP_BALLS // (len(kinds) + 1)))
    tops = _filled(_points_of([r["dv"] for r in distinct.orderBy(F.xxhash64("did"), "did").select("dv").limit(count).collect()], dims))
    # as many centers of leaves as leaves, drawn by hash: dense balls get more of them. The top's own center is one more
    drawn = distinct.where(F.pmod(F.xxhash64("did", F.lit("leaf")), F.lit(1 << 30)) < int(min(1.0, leaves / total) * (1 << 30)))

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A center's missing coordinates are those of its top's center."""
        for batch in batches:
            points, top = _points(batch.column(1), dims), batch.column(2).to_numpy()
            center = np.where(np.isnan(points), tops[top], points)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(center.tolist(), pa.list_(pa.float64())), batch.column(2)], names=["did", "center", "top"])

    id_type = distinct.schema["did"].dataType.simpleString()
    inside = _in_tops(drawn, "did", "dv", None, tops, dims).select("did", "dv", "top").mapInArrow(complete, f"did {id_type}, center array<double>, top int")
    own = distinct.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(tops)], "top int, center array<double>")
    numbered = inside.withColumn("sub", F.row_number().over(Window.partitionBy("top").orderBy("did"))).select("top", "sub", "center")
    subs = cut_lineage(own.withColumn("sub", F.lit(0)).select("top", "sub", "center").unionByName(numbered))
    placed = _in_leaves(_in_tops(distinct, "did", "dv", None, tops, dims), subs, "did", "dv", None, tops, dims, block)
    kind = F.when(F.col("pattern").isin(sorted(kinds)), F.col("pattern")).otherwise(F.lit(RARE))
    return Tree(dims, tops, kinds, subs, cut_lineage(placed.withColumn("kind", kind).drop("pattern")), block)


def _points_of(vectors: list, dims: int) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in vectors], dtype=float).reshape(-1, dims)


def _points(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column; missing coordinates are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def _filled(points: np.ndarray) -> np.ndarray:
    known = ~np.isnan(points)
    means = np.where(known.any(axis=0), np.where(known, points, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1), 0.0)
    return np.where(known, points, means)


def _patterns(points: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, masks, and the number of each row's pattern of present coordinates."""
    masks, at = np.unique(~np.isnan(points), axis=0, return_inverse=True)
    return [np.packbits(m).tobytes().hex() for m in masks], masks, at.ravel()


def _mask(name: str, dims: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bytes.fromhex(name), np.uint8), count=dims).astype(bool)


def _with_pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            column = batch.column(batch.schema.get_field_index("dv"))
            names, _, at = _patterns(_points(column, len(column[0])))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at])], names=["kind"])


def _distances(points: np.ndarray, centers: np.ndarray, on: np.ndarray) -> np.ndarray:
    a, b = points[:, on], centers[:, on]
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _closest(points: np.ndarray, centers: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pattern, nearest center and its distance on the present coordinates, for each row."""
    names, masks, kind = _patterns(points)
    where, far = np.zeros(len(points), np.int32), np.zeros(len(points))
    for p, on in enumerate(masks):
        mine = np.flatnonzero(kind == p)
        for start in range(0, len(mine), CHUNK):
            rows = mine[start : start + CHUNK]
            d = _distances(points[rows], centers, on)
            where[rows] = d.argmin(axis=1)
            far[rows] = d[np.arange(len(rows)), where[rows]]
    return [names[i] for i in kind], where, far


def _in_tops(rows: DataFrame, key: str, vector: str, want: str | None, tops: np.ndarray, dims: int) -> DataFrame:
    """Adds (pattern, top, top_far)."""
    kept = [key, vector] + ([want] if want else [])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, top, far = _closest(_points(batch.column(1), dims), tops)
            added = [pa.array(pattern, pa.string()), pa.array(top, pa.int32()), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kept, "pattern", "top", "top_far"])

    narrow = rows.select(*kept)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields)
    return narrow.mapInArrow(place, types + ", pattern string, top int, top_far double")


def _in_leaves(rows: DataFrame, subs: DataFrame, key: str, vector: str, want: str | None, tops: np.ndarray, dims: int, block: int) -> DataFrame:
    """Adds (sub, far): the rows of a top ball meet the centers of its leaves in parts of about a block."""
    rows = cut_lineage(rows)
    # a row per top ball
    parts = rows.groupBy("top").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    left = small(rows, parts, "top").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    right = small(subs, parts, "top").select("top", "sub", "center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    kept = [key, vector] + ([want] if want else []) + ["pattern", "top", "top_far"]
    types = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in kept)

    def place(mine: pa.Table, centers: pa.Table) -> pa.Table:
        mine = mine.select(kept)
        if not mine.num_rows:
            return mine.append_column("sub", pa.array([], pa.int32())).append_column("far", pa.array([], pa.float64()))
        _, at, far = _closest(_points(mine.column(vector), dims), _points(centers.column("center"), dims))
        sub = centers.column("sub").to_numpy()[at]
        return mine.append_column("sub", pa.array(sub, pa.int32())).append_column("far", pa.array(far))

    return left.groupBy("top", "part").cogroup(right.groupBy("top", "part")).applyInArrow(place, types + ", sub int, far double")


# --- matching ---------------------------------------------------------------------------------------


def _bounds(q_centers, q_radii, q_pattern, want, centers, radii, kinds, dims) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of any row of each query ball (or query) from any donor of each donor ball."""
    low = np.full((len(q_centers), len(centers)), np.inf)
    high = np.full((len(q_centers), len(centers)), np.inf)
    mine = _mask(q_pattern, dims)
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        if kind == RARE:
            low[:, at] = 0.0
            continue
        theirs = _mask(kind, dims)
        shared = mine & theirs
        if not shared.any() or (want >= 0 and not theirs[want]):
            continue
        scale = np.sqrt(dims / shared.sum())
        d = _distances(q_centers, centers[at], shared)
        reach = q_radii[:, None] + radii[at][None, :]
        gap = SLACK * (1.0 + d + reach)
        low[:, at] = np.maximum(d - reach - gap, 0.0) * scale
        high[:, at] = (d + reach + gap) * scale
    return low, high


def _needed(low: np.ndarray, high: np.ndarray, sizes: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the pairs that can hold one of the nearest ``need``."""
    order = np.argsort(high, axis=1)
    sorted_high = np.take_along_axis(high, order, 1)
    reached = np.cumsum(np.where(np.isfinite(sorted_high), sizes[order], 0), axis=1)
    enough = (reached >= need).argmax(axis=1)
    bound = np.where(reached[:, -1] >= need, sorted_high[np.arange(len(low)), enough], np.inf)
    return np.nonzero((low <= bound[:, None]) & np.isfinite(low))


def match(tree: Tree, queries: DataFrame, need: int, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The queries in their leaves, and the pairs of leaves that can hold a neighbour.

    Pairs: (pattern, want, q_top, q_sub, q_rows, home, leaf, kind, center, radius, rows, bundle, number, d_parts, q_parts), a
    row for each. ``bundle``: the leaves that travel with this one; ``number``: the leaf's among those of its top ball, ``home``.
    """
    dims = tree.dims
    wanted = queries.select("qid", "qv", F.col("want").cast("int").alias("want"))
    placed = cut_lineage(_in_leaves(_in_tops(wanted, "qid", "qv", "want", tree.tops, dims), tree.subs, "qid", "qv", "want", tree.tops, dims, tree.block))

    # top balls with top balls: at most TOP_BALLS rows of donors' balls
    balls = tree.donors.groupBy("kind", "top").agg(F.count("*").alias("n"), F.max("top_far").alias("r")).collect()
    kinds, sizes = np.array([b["kind"] for b in balls]), np.array([b["n"] for b in balls], np.int64)
    radii, homes = np.array([b["r"] for b in balls]), np.array([b["top"] for b in balls])
    tops = tree.tops

    def match_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pattern, want, top, radius in zip(*(c.to_pylist() for c in batch.columns)):
                bounds = _bounds(tops[[top]], np.array([radius]), pattern, want, tops[homes], radii, kinds, dims)
                _, at = _needed(*bounds, sizes, need)
                out += [(pattern, want, top, str(kinds[i]), int(homes[i])) for i in at]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=pa.schema([("pattern", pa.string()), ("want", pa.int32()), ("q_top", pa.int32()), ("kind", pa.string()), ("top", pa.int32())]))

    top_queries = placed.groupBy("pattern", "want", "top").agg(F.max("top_far").alias("radius"))
    met = top_queries.mapInArrow(match_tops, "pattern string, want int, q_top int, kind string, top int")

    # leaves with leaves, inside the top balls that met
    leaves = tree.donors.groupBy("kind", "top", "sub").agg(F.count("*").alias("rows"), F.max("far").alias("radius"))
    theirs = leaves.join(tree.subs, ["top", "sub"]).join(met, ["kind", "top"]).withColumn("leaf", leaf_name("kind", "top", "sub")).withColumnRenamed("top", "home")
    mine = placed.groupBy("pattern", "want", F.col("top").alias("q_top"), F.col("sub").alias("q_sub")).agg(F.count("*").alias("q_rows"), F.max("far").alias("q_radius"))
    centers = tree.subs.select(F.col("top").alias("q_top"), F.col("sub").alias("q_sub"), F.col("center").alias("q_center"))
    keys = ["pattern", "want", "q_top"]
    fields = "pattern string, want int, q_top int, q_sub int, q_rows long, home int, leaf string, kind string, center array<double>, radius double, rows long"

    def match_leaves(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pattern, want = key[0].as_py(), key[1].as_py()
        column = right.column("kind").to_numpy()
        found = [np.zeros((2, 0), int)]
        if left.num_rows and right.num_rows:
            a, b = _points(left.column("q_center"), dims), _points(right.column("center"), dims)
            r, s, n = left.column("q_radius").to_numpy(), right.column("radius").to_numpy(), right.column("rows").to_numpy()
            for start in range(0, len(a), CHUNK):
                rows, at = _needed(*_bounds(a[start : start + CHUNK], r[start : start + CHUNK], pattern, want, b, s, column, dims), n, need)
                found.append(np.stack([rows + start, at]))
        row, at = np.concatenate(found, axis=1)
        one, other = left.select(["pattern", "want", "q_top", "q_sub", "q_rows"]).take(row), right.select(["home", "leaf", "kind", "center", "radius", "rows"]).take(at)
        return pa.table([*one.columns, *other.columns], names=[*one.column_names, *other.column_names])

    pairs = cut_lineage(mine.join(centers, ["q_top", "q_sub"]).groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(match_leaves, fields))
    # what a bundle holds, and how many blocks of donors and of queries it makes, is known before any row moves
    blocks = bundled(dims, tree.block)
    rows, asking = blocks * tree.block, max(1, blocks // 2) * query_block
    axis = int(tops.var(axis=0).argmax()) if dims else 0
    along = Window.partitionBy("kind", "home").orderBy(F.get("center", F.lit(axis)), "leaf")
    before = F.coalesce(F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.floor(before / rows) if blocks > 1 else F.row_number().over(along)
    bundles = (
        pairs.groupBy("leaf")
        .agg(*[F.first(c).alias(c) for c in ("kind", "home", "center", "rows")])
        .select(
            "leaf",
            F.concat_ws(":", "kind", F.col("home").cast("string"), place.cast("string")).alias("bundle"),
            F.row_number().over(along).alias("number"),
            F.greatest(F.ceil(F.col("rows") / rows), F.lit(1)).cast("int").alias("d_parts"),
        )
    )
    laid = pairs.join(bundles, "leaf")
    asked = laid.select("bundle", *keys, "q_sub", "q_rows").distinct().groupBy("bundle")
    q_parts = asked.agg(F.greatest(F.ceil(F.sum("q_rows") / asking), F.lit(1)).cast("int").alias("q_parts"))
    return placed, cut_lineage(laid.join(q_parts, "bundle"))


def candidates(tree: Tree, placed: DataFrame, matched: DataFrame, need: int, query_block: int = QUERY_BLOCK, closest: int = 0) -> DataFrame:
    """(qid, qv, want, bundle, qpart, dpart, numbers): every query once for a bundle, with the leaves that it needs itself.

    ``closest``: only so many of them, those with the nearest farthest row. ``bound``, a column that the queries may have: the
    k-th distance found so far, which drops leaves that begin beyond it.
    """
    dims = tree.dims
    limits = ["bound"] if "bound" in placed.columns else []
    keys = ["pattern", "want", "q_top", "q_sub"]
    parts = matched.groupBy(*keys).agg(F.ceil(F.first("q_rows") / query_block).cast("int").alias("parts"))
    rows = placed.select("qid", "qv", "pattern", "want", F.col("top").alias("q_top"), F.col("sub").alias("q_sub"), F.xxhash64("qid", "want").alias("h"), *limits)
    left = small(rows, parts, *keys).withColumn("part", F.pmod("h", F.col("parts")).cast("int")).drop("parts")
    right = matched.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    id_type = placed.schema["qid"].dataType.simpleString()

    def choose(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        points, h = _points(mine.column("qv"), dims), mine.column("h").to_numpy()
        centers, radii = _points(theirs.column("center"), dims), theirs.column("radius").to_numpy()
        kinds, sizes = theirs.column("kind").to_numpy(), theirs.column("rows").to_numpy()
        d_parts, q_parts = theirs.column("d_parts").to_numpy(), theirs.column("q_parts").to_numpy()
        numbers, bundles = theirs.column("number").to_numpy(), np.unique(theirs.column("bundle").to_numpy().astype(str), return_inverse=True)[1]
        found = [np.zeros((2, 0), int)]
        for start in range(0, len(points), CHUNK):
            some = points[start : start + CHUNK]
            low, high = _bounds(some, np.zeros(len(some)), key[0].as_py(), key[1].as_py(), centers, radii, kinds, dims)
            if limits:
                low[low > mine.column("bound").to_numpy()[start : start + CHUNK, None]] = np.inf
            row, at = _needed(low, high, sizes, need)
            if closest:
                head = np.zeros(low.shape, bool)
                np.put_along_axis(head, np.argsort(high, axis=1)[:, :closest], True, axis=1)
                row, at = row[head[row, at]], at[head[row, at]]
            found.append(np.stack([row + start, at]))
        row, at = np.concatenate(found, axis=1)
        times = d_parts[at]
        row, at = np.repeat(row, times), np.repeat(at, times)
        dpart = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        order = np.lexsort((dpart, bundles[at], row))
        row, at, dpart = row[order], at[order], dpart[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (bundles[at[1:]] != bundles[at[:-1]]) | (dpart[1:] != dpart[:-1])
        head = np.flatnonzero(new)
        listed = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)), pa.int32()), pa.array(numbers[at], pa.int32()))
        row, at, dpart = row[head], at[head], dpart[head]
        out = mine.select(["qid", "qv", "want"]).take(row).append_column("bundle", theirs.column("bundle").take(at))
        out = out.append_column("qpart", pa.array(np.mod(h[row], q_parts[at]), pa.int32())).append_column("dpart", pa.array(dpart, pa.int32()))
        return out.append_column("numbers", listed)

    grouped = left.groupBy(*keys, "part").cogroup(right.groupBy(*keys, "part"))
    return grouped.applyInArrow(choose, f"qid {id_type}, qv array<double>, want int, bundle string, qpart int, dpart int, numbers array<int>")


# --- searching --------------------------------------------------------------------------------------


@dataclass
class Block:
    """Donors of one leaf, made ready for products of matrices."""

    at: np.ndarray  # places among the bundle's donors
    zeroed: np.ndarray
    there: np.ndarray
    whole: bool  # no coordinate is missing
    shift: np.ndarray
    moved: np.ndarray
    length: np.ndarray
    longest: float

    @classmethod
    def of(cls, donors: np.ndarray, at: np.ndarray) -> Block:
        donors = donors[at]
        there = ~np.isnan(donors)
        zeroed = np.where(there, donors, 0.0)
        # the estimate loses least where the values lie around zero
        shift = zeroed.sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        moved = np.where(there, donors - shift, 0.0)
        length = moved * moved
        return cls(at, zeroed, there, bool(there.all()), shift, moved, length, float(length.sum(axis=1).max()))


def _bundle_search(k: int, dims: int, skip_self: bool, block: int):
    """The k nearest of a bundle of leaves, for a block of queries, each of which names the leaves it needs.

    Products of matrices estimate all distances of a leaf and its queries; those that may be among the k are computed
    anew, coordinate by coordinate, so results do not depend on the blocks. After its first k a query's k-th distance
    bounds what it takes from the leaves that follow.
    """
    fields = ["qid", "want", "dist2", "did", "value"]

    def near_in(b: Block, q: np.ndarray, want: np.ndarray, bound: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, donor of the block, distance) of all that may be among the k; ``bound``: the k-th distance so far."""
        here = ~np.isnan(q)
        filled, near = np.where(here, q, 0.0), np.where(here, q - b.shift, 0.0)
        whole = b.whole and bool(here.all())
        shared = None
        if whole:
            scaled = near @ (-2.0 * b.moved.T)
            scaled += b.length.sum(axis=1)
            scaled += (near * near).sum(axis=1)[:, None]
            if other is not None:
                scaled[~other] = np.inf
        else:
            has = b.there.astype(float)
            shared = here.astype(float) @ has.T
            estimate = (near * near) @ has.T + here.astype(float) @ b.length.T - 2.0 * near @ b.moved.T
            usable = (shared > 0) & np.where((want >= 0)[:, None], b.there[:, np.maximum(want, 0)].T, True)
            if other is not None:
                usable &= other
            scaled = np.where(usable, estimate * (dims / np.where(usable, shared, 1.0)), np.inf)
        last = bound
        if scaled.shape[1] > k and not np.isfinite(bound).all():
            last = np.minimum(bound, np.partition(scaled, k - 1, axis=1)[:, k - 1])
        slack = ROUNDING * dims * ((near * near).sum(axis=1) + b.longest)
        r, c = np.nonzero(scaled <= (last + slack)[:, None])
        finite = np.isfinite(scaled[r, c])
        r, c = r[finite], c[finite]
        square = np.zeros(len(r))
        for j in range(dims):
            gap = filled[r, j] - b.zeroed[c, j]
            square += gap * gap if whole else np.where(here[r, j] & b.there[c, j], gap * gap, 0.0)
        return r, c, square * (dims / (float(dims) if whole else shared[r, c]))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("qid").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64()), right.column("did").slice(0, 0), pa.array([], pa.float64())], names=fields)
        right = right.sort_by("did")
        points, donors = _points(left.column("qv"), dims), _points(right.column("dv"), dims)
        want = left.column("want").to_numpy()
        ids, qids = (right.column("did").to_numpy(), left.column("qid").to_numpy()) if skip_self else (None, None)
        number = right.column("number").to_numpy()
        lists = left.column("numbers").combine_chunks()
        asking, asked = np.repeat(np.arange(len(points)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        found = []
        by_leaf = np.argsort(number, kind="stable")
        leaves = np.split(by_leaf, np.flatnonzero(np.diff(number[by_leaf])) + 1)
        blocks = [Block.of(donors, leaf[at : at + block]) for leaf in leaves for at in range(0, len(leaf), block)]
        askers = {int(number[leaf[0]]): np.sort(asking[asked == number[leaf[0]]]) for leaf in leaves}
        for start in range(0, len(points), CHUNK):
            size = min(CHUNK, len(points) - start)
            bound = np.full(size, np.inf)
            row, at, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in blocks:
                mine = askers[int(number[b.at[0]])]
                mine = mine[np.searchsorted(mine, start) : np.searchsorted(mine, start + size)]
                if not len(mine):
                    continue
                other = qids[mine][:, None] != ids[b.at][None, :] if skip_self else None
                r, c, d = near_in(b, points[mine], want[mine], bound[mine - start], other)
                row, at, dist = np.append(row, mine[r] - start), np.append(at, b.at[c]), np.append(dist, d)
                order = np.lexsort((at, dist, row))
                ranked = row[order]
                place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked, side="left")
                order, place = order[place < k], place[place < k]
                row, at, dist = row[order], at[order], dist[order]
                full = place == k - 1
                bound[row[full]] = dist[full]
            found.append((row + start, at, dist))
        row, at, dist = (np.concatenate(x) for x in zip(*found))
        value = np.where(want[row] >= 0, donors[at, np.maximum(want[row], 0)], np.nan)
        columns = [left.column("qid").take(row), pa.array(want[row], pa.int32()), pa.array(dist), right.column("did").take(at), pa.array(value)]
        return pa.table(columns, names=fields)

    return search
