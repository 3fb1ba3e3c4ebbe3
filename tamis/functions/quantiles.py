"""Exact quantiles without gathering a column in one task, by one path for every size and number of quantiles.

Every pass counts the rows per bucket (a few thousand buckets per column, combined map-side), and the buckets
that hold a wanted rank are split further until they hold one value or few enough rows to list. No pass
shuffles rows, a value shared by any share of the rows ends up alone in its bucket, and any number of ranks
is followed at once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 2_048
SPLIT_INTO = 16  # parts of an open bucket, at least
LIST_ROWS = 100_000


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float], buckets: int = BUCKETS, list_rows: int = LIST_ROWS
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each named expression; NULL and NaN are skipped."""
    return _select_ranks(df, columns, probs, buckets, list_rows) if columns else {}


def constant_array(values: list[float]) -> Column:
    """Array literal, parsed in one call: arrays of a thousand literals are slow to build one by one."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _rank_pairs(n: int, probs: list[float]) -> list[tuple[int, int, float]]:
    pairs = []
    for p in probs:
        at = p * (n - 1)
        low = int(math.floor(at))
        pairs.append((low, min(low + 1, n - 1), at - low))
    return pairs


def _select_ranks(df, columns, probs, buckets, list_rows) -> dict[str, list[float | None]]:
    names = list(columns)
    wide = df.select(*[F.nanvl(columns[n].cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, n in enumerate(names)])
    bounds = wide.agg(
        *[f(f"x{i}").alias(f"{tag}{i}") for i in range(len(names)) for tag, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    found: dict[int, dict[int, float]] = {}
    wanted: dict[int, set[int]] = {}
    # per column: (low, high, rows before, rows) of the buckets that hold wanted ranks
    opened: dict[int, list[tuple[float, float, int, int]]] = {}
    for i in range(len(names)):
        n = bounds[f"n{i}"]
        if n:
            wanted[i] = {r for low, high, _ in _rank_pairs(n, probs) for r in (low, high)}
            found[i] = {}
            opened[i] = [(bounds[f"lo{i}"], bounds[f"hi{i}"], 0, n)]
    previous_rows = None
    while opened:
        rows = sum(b[3] for bs in opened.values() for b in bs)
        if rows <= list_rows:
            _list_buckets(wide, opened, wanted, found)
            break
        # very uneven values: let quantile sketches place the cuts, each value isolated
        stuck = previous_rows is not None and rows * 2 > previous_rows
        previous_rows = rows
        sketched = opened if stuck else {i: part for i, bs in opened.items() if (part := [b for b in bs if not _even(b[0], b[1])])}
        placed = _sketches(wide, sketched, buckets) if sketched else {}
        splits = {i: _edges(bs, max(SPLIT_INTO, buckets // len(bs)), stuck, placed.get(i, set())) for i, bs in opened.items()}
        counts = _bucket_counts(wide, list(opened), splits)
        following: dict[int, list[tuple[float, float, int, int]]] = {}
        for i in opened:
            ranks, at, before = sorted(wanted[i]), 0, 0
            for _, size, low, high in counts[i]:
                hit = []
                while at < len(ranks) and ranks[at] < before + size:
                    hit.append(ranks[at])
                    at += 1
                if hit and low == high:
                    found[i].update(dict.fromkeys(hit, low))
                    wanted[i] -= set(hit)
                elif hit:
                    following.setdefault(i, []).append((low, high, before, size))
                before += size
        opened = following
    out: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        if i not in found:
            out[name] = [None] * len(probs)
        else:
            out[name] = [
                found[i][low] * (1.0 - frac) + found[i][high] * frac if frac else found[i][low]
                for low, high, frac in _rank_pairs(bounds[f"n{i}"], probs)
            ]
    return out


def _even(low: float, high: float) -> bool:
    """A bucket that can be cut into equal steps."""
    return math.isfinite(low) and math.isfinite(high) and math.isfinite(high - low)


def _edges(opened: list[tuple[float, float, int, int]], share: int, stuck: bool, placed: set[float]) -> list[float]:
    """Cuts of the open buckets of a column, each bucket's ends included; ``placed``: those of its sketches."""
    edges = set(placed)
    for low, high, _, _ in opened:
        if not stuck and _even(low, high):
            edges.update(np.linspace(low, high, share + 1).tolist())
        edges.update((low, float(np.nextafter(high, np.inf))))
    return [-math.inf, *(sorted(e for e in edges if math.isfinite(e)) or [0.0]), math.inf]


def _open_buckets(wide: DataFrame, opened: dict[int, list[tuple[float, float, int, int]]]) -> tuple[dict[int, list[float]], DataFrame]:
    """Splits at the ends of the open buckets, and the numbers that these buckets have under them.

    A row is matched to its bucket by number; there is no chain of conditions, however many are open.
    """
    splits = {i: sorted({e for low, high, _, _ in bs for e in (low, float(np.nextafter(high, np.inf)))}) for i, bs in opened.items()}
    splits = {i: [-math.inf, *([e for e in es if math.isfinite(e)] or [0.0]), math.inf] for i, es in splits.items()}
    held = [
        (i, float(min(np.searchsorted(splits[i], at, side="right") - 1, len(splits[i]) - 2)))
        for i, bs in opened.items()
        for low, high, _, _ in bs
        for at in {low, high}
    ]
    # as many rows as there are open buckets: at most two for each wanted quantile
    return splits, F.broadcast(wide.sparkSession.createDataFrame(held, "c int, b double"))


def _sketches(wide: DataFrame, opened: dict[int, list[tuple[float, float, int, int]]], buckets: int) -> dict[int, set[float]]:
    """Cuts of all open buckets of all columns from one grouped sketch, combined map-side."""
    grid = max(64, buckets // max(len(bs) for bs in opened.values()))
    splits, held = _open_buckets(wide, opened)
    sketch = F.percentile_approx("x", [j / grid for j in range(grid + 1)], F.lit(max(1000, 4 * grid)))
    rows = _marked(wide, list(opened), splits).join(held, ["c", "b"], "left_semi").groupBy("c", "b").agg(sketch.alias("cuts")).collect()
    out: dict[int, set[float]] = {}
    for r in rows:
        out.setdefault(r["c"], set()).update(e for v in r["cuts"] for e in (v, float(np.nextafter(v, np.inf))))
    return out


def _bucket_counts(wide: DataFrame, todo: list[int], splits: dict[int, list[float]]):
    """Per column: (bucket, rows, smallest, largest) in bucket order."""
    rows = (
        _marked(wide, todo, splits).groupBy("c", "b").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    )
    out: dict[int, list] = {i: [] for i in todo}
    for r in rows:
        out[r["c"]].append((r["b"], r["n"], r["lo"], r["hi"]))
    for i in todo:
        out[i].sort()
    return out


def _marked(wide: DataFrame, todo: list[int], splits: dict[int, list[float]]) -> DataFrame:
    """(column, bucket, value) of all values."""
    marked = Bucketizer(
        splitsArray=[splits[i] for i in todo],
        inputCols=[f"x{i}" for i in todo],
        outputCols=[f"b{i}" for i in todo],
        handleInvalid="keep",
    ).transform(wide)
    items = F.explode(
        F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"b{i}").alias("b"), F.col(f"x{i}").alias("x")) for i in todo])
    ).alias("item")
    return marked.select(items).select("item.*").where(F.col("x").isNotNull())


def _list_buckets(wide, opened, wanted, found) -> None:
    """The open buckets hold few rows (checked): list their distinct values and read the ranks off."""
    todo = list(opened)
    splits, held = _open_buckets(wide, opened)
    rows = _marked(wide, todo, splits).join(held, ["c", "b"], "left_semi").groupBy("c", "x").count().collect()
    for i, bs in opened.items():
        mine = sorted((r["x"], r["count"]) for r in rows if r["c"] == i)
        ranks, at = sorted(wanted[i]), 0
        values = iter(mine)
        value, n = next(values, (None, 0))
        for low, high, before, _ in bs:
            while value is not None and value < low:
                value, n = next(values, (None, 0))
            while value is not None and value <= high:
                while at < len(ranks) and ranks[at] < before + n:
                    found[i][ranks[at]] = value
                    at += 1
                before += n
                value, n = next(values, (None, 0))
        wanted[i].clear()


HEAVY_GROUPS = 10_000
GRID = 256
ACCURACY = 10_000


def grouped_quantile(df: DataFrame, keys: list[str], value: str, p: float, name: str, list_rows: int = LIST_ROWS) -> DataFrame:
    """Exact quantile per group, for groups of any number and any size: one row ``(keys, name)`` per group.

    Groups of at most ``list_rows`` rows (or 1 of ``HEAVY_GROUPS`` parts of all rows) send their distinct values with
    counts to be ordered. So there are at most ``HEAVY_GROUPS`` larger groups. For all of these at once a sketch,
    combined map-side, gives a bracket around the wanted ranks, and exact counts of the rows below, at and between its
    ends say what is left. Brackets are a small broadcast table, rows stay where they are; every round leaves some
    hundredths of the rows between the ends, until few enough are left to be ordered. Values that many rows share
    become ends and are found by counting. NULL and NaN are skipped.
    """
    base = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__x")).where(F.col("__x").isNotNull())
    sizes = base.groupBy(*keys).agg(F.count("__x").alias("__n"))
    every, largest = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    limit = max(list_rows, every // HEAVY_GROUPS)
    if largest <= limit:
        return _ordered_quantile(base, keys, p, name)
    heavy = _Brackets(base, keys, sizes.where(F.col("__n") > limit).collect(), p)
    while heavy.narrow(list_rows):
        pass
    light = base.join(F.broadcast(heavy.table().drop("__n")), _same(keys), "left_anti")
    return _ordered_quantile(light, keys, p, name).unionByName(heavy.quantiles(name))


def _same(keys: list[str], left: str = "", right: str = "__k_") -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}"))
    return test


def _ordered_quantile(base: DataFrame, keys: list[str], p: float, name: str) -> DataFrame:
    """Quantiles of groups whose distinct values can be ordered in one task."""
    counted = base.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__m"))
    group = Window.partitionBy(*keys)
    spread = counted.withColumn("__to", F.sum("__m").over(group.orderBy("__x"))).withColumn("__n", F.sum("__m").over(group))
    at = F.lit(p) * (F.col("__n") - 1)
    low = F.floor(at)
    high = F.least(low + 1, F.col("__n") - 1)

    def pick(rank: Column) -> Column:
        return F.max(F.when((F.col("__to") - F.col("__m") <= rank) & (rank < F.col("__to")), F.col("__x")))

    found = spread.groupBy(*keys).agg(pick(low).alias("__a"), pick(high).alias("__c"), F.first(at - low).alias("__f"))
    return found.select(*keys, _between("__a", "__c", "__f").alias(name))


def _between(a: str, c: str, f: str) -> Column:
    return F.when(F.col(f) == 0, F.col(a)).otherwise(F.col(a) * (1 - F.col(f)) + F.col(c) * F.col(f))


class _Brackets:
    """The open interval around the unknown ranks of each heavy group, as a small table."""

    def __init__(self, base: DataFrame, keys: list[str], groups: list, p: float):
        self.base, self.keys = base, keys
        types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
        self.schema = ", ".join(f"`__k_{k}` {types[k]}" for k in keys) + ", __lo double, __hi double, __before long, __n long"
        self.state = {}
        for r in groups:
            n = r["__n"]
            low = math.floor(p * (n - 1))
            high = min(low + 1, n - 1)
            open_now = {"lo": -math.inf, "hi": math.inf, "before": 0, "inside": n, "found": {}, "ranks": (low, high), "part": p * (n - 1) - low}
            self.state[tuple(r[k] for k in keys)] = open_now

    def table(self) -> DataFrame:
        """One row per heavy group, at most ``HEAVY_GROUPS``."""
        rows = [(*k, s["lo"], s["hi"], s["before"], s["inside"]) for k, s in self.state.items()]
        return self.base.sparkSession.createDataFrame(rows, self.schema)

    def _wanted(self, s: dict) -> list[int]:
        return sorted({r for r in s["ranks"] if r not in s["found"]})

    def inside(self) -> DataFrame:
        """Rows strictly inside their group's interval; infinite values lie inside an unbounded one."""
        x, lo, hi = F.col("__x"), F.col("__lo"), F.col("__hi")
        above = (x > lo) | (lo == -math.inf) & (F.col("__before") == 0)
        return self.base.join(F.broadcast(self.table()), _same(self.keys)).where(above & ((x < hi) | (hi == math.inf)))

    def narrow(self, list_rows: int) -> bool:
        """One sketch and one count for all groups; False when what is left can be ordered."""
        todo = [k for k, s in self.state.items() if self._wanted(s) and s["inside"] > list_rows]
        if not todo:
            return False
        grid = F.percentile_approx("__x", [i / GRID for i in range(GRID + 1)], F.lit(ACCURACY))
        sketches = {tuple(r[k] for k in self.keys): r["__grid"] for r in self.inside().groupBy(*self.keys).agg(grid.alias("__grid")).collect()}
        ends = {}
        for k in todo:
            s = self.state[k]
            wanted = self._wanted(s)
            at = [(r - s["before"]) / s["inside"] * GRID for r in (wanted[0], wanted[-1])]
            ends[k] = sketches[k][max(0, math.floor(at[0]) - 1)], sketches[k][min(GRID, math.ceil(at[1]) + 1)]
        rows = [(*k, a, b, 0, 0) for k, (a, b) in ends.items()]
        met = self.base.join(F.broadcast(self.base.sparkSession.createDataFrame(rows, self.schema)), _same(self.keys))
        x, lo, hi = F.col("__x"), F.col("__lo"), F.col("__hi")
        tests = {"below": x < lo, "at_lo": x == lo, "inside": (x > lo) & (x < hi), "at_hi": (x == hi) & (hi > lo)}
        counts = met.groupBy(*self.keys).agg(*[F.sum(t.cast("long")).alias(f"__{n}") for n, t in tests.items()]).collect()
        moved = False
        for r in counts:
            k = tuple(r[c] for c in self.keys)
            s, (a, b) = self.state[k], ends[k]
            first, second = r["__below"] + r["__at_lo"], r["__below"] + r["__at_lo"] + r["__inside"]
            for rank in self._wanted(s):
                if r["__below"] <= rank < first:
                    s["found"][rank] = a
                elif second <= rank < second + r["__at_hi"]:
                    s["found"][rank] = b
            wanted = self._wanted(s)
            if wanted and (wanted[0] < first or wanted[-1] >= second):
                continue  # the sketch missed a rank: what was known stays
            moved |= r["__inside"] < s["inside"]
            s |= {"lo": a, "hi": b, "before": first, "inside": r["__inside"]}
        return moved

    def quantiles(self, name: str) -> DataFrame:
        """Orders the distinct values that are left in the intervals."""
        counted = self.inside().groupBy(*self.keys, "__x").agg(F.count(F.lit(1)).alias("__m"), F.first("__before").alias("__before"))
        earlier = Window.partitionBy(*self.keys).orderBy("__x")
        spread = counted.withColumn("__to", F.col("__before") + F.sum("__m").over(earlier))
        rows = [(*k, *(s["found"].get(r) for r in s["ranks"]), *s["ranks"], s["part"]) for k, s in self.state.items()]
        schema = self.schema.split(", __lo")[0] + ", __a double, __c double, __r long, __s long, __f double"
        known = F.broadcast(self.base.sparkSession.createDataFrame(rows, schema))

        def pick(value: str, rank: str) -> Column:
            hit = (F.col("__to") - F.col("__m") <= F.col(rank)) & (F.col(rank) < F.col("__to"))
            return F.max(F.coalesce(value, F.when(hit, F.col("__x")))).alias(value)

        # a row per heavy group that stands for what is known, beside the values that are left
        own = [f"__k_{k}" for k in self.keys]
        values = known.join(spread.select(*[F.col(k).alias(f"__v_{k}") for k in self.keys], "__x", "__m", "__to"), _same(self.keys, "__k_", "__v_"), "left")
        found = values.groupBy(*own).agg(pick("__a", "__r"), pick("__c", "__s"), F.first("__f").alias("__f"))
        return found.select(*[F.col(c).alias(k) for c, k in zip(own, self.keys)], _between("__a", "__c", "__f").alias(name))
