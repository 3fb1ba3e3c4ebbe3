"""Sparse linear machines: squared hinge loss with an L1 penalty, by accelerated proximal steps.

Every round is one pass that adds up gradients per class (one against the rest); the step size comes from the
covariance of the columns, so no search is needed, and rounds end by a tolerance on the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

FEW_PARTITIONS = 16  # partitions whose sums the driver adds up itself


@dataclass(frozen=True)
class Machine:
    """``weights``: (classes or 1, columns) on standardized columns; ``gap``: the last change of a weight."""

    weights: np.ndarray
    intercept: np.ndarray
    rounds: int
    gap: float


def _blocks(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, classes: int) -> RDD:
    """(standardized values, signs per class) of some thousand rows."""
    width = len(mean)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            arrays = [((values - mean) / spread).tobytes(), batch.column(1).to_numpy(zero_copy_only=False).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in arrays], names=["x", "y"])

    def unpacked(r) -> tuple[np.ndarray, np.ndarray]:
        y = np.frombuffer(r["y"], float)
        sign = np.where(y[:, None] > 0, 1.0, -1.0) if classes <= 2 else np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
        return np.frombuffer(r["x"], float).reshape(-1, width), sign

    return rows.mapInArrow(packed, "x binary, y binary").rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)


def _add(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sparse_machine(
    rows: DataFrame, mean: np.ndarray, spread: np.ndarray, corr: np.ndarray, classes: int, penalty: float, tolerance: float = 1e-6, rounds: int = 2_000
) -> Machine:
    """Least mean of squared hinges plus ``penalty`` times the absolute weights, over ``rows`` (vector, class number).

    ``mean``, ``spread`` and ``corr`` are those of the columns. Raises where ``rounds`` do not reach ``tolerance``.
    """
    outputs, width = 1 if classes <= 2 else classes, len(mean)
    blocks = _blocks(rows, mean, spread, classes)
    depth = 1 if blocks.getNumPartitions() <= FEW_PARTITIONS else 2
    # the curvature of the mean loss is at most twice that of the columns and the constant
    step = 1.0 / (2.0 * max(1.0, float(np.linalg.eigvalsh(corr)[-1])) + 1e-12) if width else 1.0
    w, b = np.zeros((outputs, width)), np.zeros(outputs)
    ahead, ahead_b, pace = w, b, 1.0

    def sums(at: np.ndarray, at_b: np.ndarray):
        def run(part: Iterator) -> Iterator[tuple]:
            g, g_b, n = np.zeros_like(at), np.zeros_like(at_b), 0
            for x, sign in part:
                short = np.maximum(0.0, 1.0 - sign * (x @ at.T + at_b)) * sign
                g, g_b, n = g - 2.0 * short.T @ x, g_b - 2.0 * short.sum(axis=0), n + len(x)
            yield g, g_b, n

        return run

    try:
        for turn in range(1, rounds + 1):
            g, g_b, n = blocks.mapPartitions(sums(ahead, ahead_b)).treeReduce(_add, depth=depth)
            if not n:
                return Machine(w, b, 0, 0.0)
            moved = ahead - step * g / n
            new, new_b = np.sign(moved) * np.maximum(0.0, np.abs(moved) - step * penalty), ahead_b - step * g_b / n
            gap = float(max(np.abs(new - w).max(initial=0.0), np.abs(new_b - b).max(initial=0.0)))
            # a step against the last move starts the acceleration anew
            back = float(((ahead - new) * (new - w)).sum() + ((ahead_b - new_b) * (new_b - b)).sum()) > 0
            pace, before = (1.0, 1.0) if back else ((1.0 + (1.0 + 4.0 * pace * pace) ** 0.5) / 2.0, pace)
            share = 0.0 if back else (before - 1.0) / pace
            ahead, ahead_b = new + share * (new - w), new_b + share * (new_b - b)
            w, b = new, new_b
            if gap <= tolerance:
                return Machine(w, b, turn, gap)
    finally:
        blocks.unpersist()
    raise RuntimeError(f"the weights still move by {gap:g} after {rounds} rounds")
