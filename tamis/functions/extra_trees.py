"""Extremely randomised classification trees, grown level by level, for the weight of each column.

In every node the columns come in a seeded order, and the first few that are not constant there are looked at. A column
has one cut in a node, drawn between the smallest and largest value of the node's rows; the column whose cut lowers Gini
impurity most is taken, the first of equals. All trees use all rows.

A level takes two aggregates over the rows, for all trees at once: ranges per (node, column), and class counts left of
the cut per (node, column). Tasks send sums only, combined before the shuffle, and the driver sees one number per node,
column and class, which does not grow with the rows. Ranges and counts are exact, so the layout of the rows changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _walk(values: np.ndarray, column: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of every row after ``levels`` steps; node n has the children 2n + 1 and 2n + 2."""
    node, rows = np.zeros(len(values), np.int64), np.arange(len(values))
    for _ in range(levels):
        node = 2 * node + 1 + (values[rows, column[node]] > cut[node])
    return node


class _Level:
    """The open nodes of one level of all trees; ``number``: (tree, node of the level) -> open node or -1."""

    def __init__(self, level: int, column: np.ndarray, cut: np.ndarray, number: np.ndarray):
        self.level, self.column, self.cut, self.number = level, column, cut, number

    def rows(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tree, the rows in open nodes and the nodes' numbers."""
        for tree in range(len(self.column)):
            node = _walk(values, self.column[tree], self.cut[tree], self.level) - (2**self.level - 1)
            number = self.number[tree][node]
            use = np.flatnonzero(number >= 0)
            if len(use):
                yield use, number[use]


def _values(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ranges(rows: DataFrame, level: _Level, width: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value per (open node, column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch, width)
            for use, number in level.rows(values):
                order = np.argsort(number, kind="stable")
                ranked, here = number[order], values[use[order]]
                starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                cells = (ranked[starts][:, None] * width + np.arange(width)).ravel()
                low, high = np.minimum.reduceat(here, starts).ravel(), np.maximum.reduceat(here, starts).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(low), pa.array(high)], names=["cell", "low", "high"])

    out = rows.mapInArrow(run, "cell long, low double, high double").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    low, high = np.zeros(nodes * width), np.zeros(nodes * width)
    cells = out.column("cell").to_numpy()
    low[cells], high[cells] = out.column("low").to_numpy(), out.column("high").to_numpy()
    return low.reshape(nodes, width), high.reshape(nodes, width)


def _left_counts(rows: DataFrame, level: _Level, chosen: np.ndarray, cuts: np.ndarray, width: int, classes: int) -> np.ndarray:
    """Rows at or below the cut per (open node, chosen column, class); a chosen column of -1 is none."""
    nodes, tried = chosen.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, y = _values(batch, width), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for use, number in level.rows(values):
                for k in range(tried):
                    column = chosen[number, k]
                    left = (column >= 0) & (values[use, column] <= cuts[number, k])
                    cells, counts = np.unique((number[left] * tried + k) * classes + y[use[left]], return_counts=True)
                    if len(cells):
                        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], names=["cell", "n"])

    out = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(nodes * tried * classes, np.int64)
    counts[out.column("cell").to_numpy()] = out.column("n").to_numpy()
    return counts.reshape(nodes, tried, classes)


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times the number of rows, over the last axis."""
    total = counts.sum(axis=-1)
    return total - (counts.astype(float) ** 2).sum(axis=-1) / np.maximum(total, 1)


def column_weights(rows: DataFrame, x: str, y: str, width: int, classes: int, trees: int = 50, depth: int = 10, columns: int | None = None, seed: int = 1) -> np.ndarray:
    """The share of each column in the decrease of impurity, averaged over the trees; all zero if nothing splits.

    ``x``: an array of ``width`` numbers without gaps; ``y``: a class number; ``columns``: how many are looked at in
    a node, the root of ``width`` by default. Rows are read twice a level, so the caller may persist them.
    """
    data = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("int").alias("y"))
    tried = min(width, columns or max(1, math.isqrt(width)))
    root = np.zeros(classes, np.int64)
    for r in data.groupBy("y").agg(F.count("*").alias("n")).collect():
        root[r["y"]] = r["n"]
    column, cut = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), math.inf)
    weight = np.zeros((trees, width))
    here = {(tree, 0): root for tree in range(trees)}
    for depth_now in range(depth):
        first = 2**depth_now - 1
        nodes = sorted(place for place, counts in here.items() if (counts > 0).sum() > 1)
        if not nodes:
            break
        number = np.full((trees, 2**depth_now), -1, np.int64)
        for i, (tree, node) in enumerate(nodes):
            number[tree, node - first] = i
        level = _Level(depth_now, column.copy(), cut.copy(), number)
        low, high = _ranges(data, level, width, len(nodes))
        chosen, cuts = np.full((len(nodes), tried), -1, np.int64), np.zeros((len(nodes), tried))
        for i, (tree, node) in enumerate(nodes):
            draw = np.random.default_rng((seed, tree, node))
            order, share = draw.permutation(width), draw.random(width)
            usable = order[low[i, order] < high[i, order]][:tried]
            chosen[i, : len(usable)] = usable
            at = low[i, usable] * (1 - share[usable]) + high[i, usable] * share[usable]
            cuts[i, : len(usable)] = np.where(at >= high[i, usable], low[i, usable], at)
        lefts = _left_counts(data, level, chosen, cuts, width, classes)
        below: dict[tuple[int, int], np.ndarray] = {}
        for i, (tree, node) in enumerate(nodes):
            whole = here[tree, node]
            gain = np.where(chosen[i] >= 0, _impurity(whole) - _impurity(lefts[i]) - _impurity(whole - lefts[i]), -math.inf)
            best = int(gain.argmax())
            if chosen[i, best] < 0:
                continue
            column[tree, node], cut[tree, node] = chosen[i, best], cuts[i, best]
            weight[tree, chosen[i, best]] += gain[best]
            below[tree, 2 * node + 1], below[tree, 2 * node + 2] = lefts[i, best], whole - lefts[i, best]
        here = below
    totals = weight.sum(axis=1, keepdims=True)
    shares = np.divide(weight, totals, out=np.zeros_like(weight), where=totals > 0).mean(axis=0)
    return shares / shares.sum() if shares.sum() > 0 else shares
