"""Extremely randomised trees: closed cases, and the same weights for every layout."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tamis.functions.extra_trees import column_weights


def table(spark, x, y, parts=3):
    return spark.createDataFrame([(list(map(float, r)), float(v)) for r, v in zip(x, y)], "x array<double>, y double").repartition(parts)


def test_two_levels_against_sql(spark):
    """Columns of 0 and 1 can be cut in one place only, so two levels take the better column first, then the other."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (600, 2))
    y = np.where(rng.random(600) < 0.15, rng.integers(0, 3, 600), 2 * x[:, 0] * (1 - x[:, 1]) + x[:, 0] * x[:, 1])
    duck = duckdb.connect()
    duck.register("t", pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))

    def impurity(by):
        counts = f"SELECT {by} AS k, y, count(*) AS c FROM t GROUP BY ALL"
        return duck.sql(f"SELECT sum(i) FROM (SELECT sum(c) - sum(c * c) / sum(c) AS i FROM ({counts}) GROUP BY k)").fetchall()[0][0]

    root, by_a, by_b, both = impurity("0"), impurity("a"), impurity("b"), impurity("a * 2 + b")
    assert by_a < by_b
    want = [(root - by_a) / (root - both), (by_a - both) / (root - both)]
    assert column_weights(table(spark, x, y), "x", "y", 2, 3, trees=5, depth=2, columns=2) == pytest.approx(want, rel=1e-9)


def test_layout_and_constant_columns(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400), np.full(400, 7.0), rng.normal(size=400), rng.integers(0, 3, 400)])
    y = (x[:, 0] + 0.2 * x[:, 3] > 0).astype(int)
    first = column_weights(table(spark, x, y), "x", "y", 4, 2, trees=20, depth=5)
    assert first.sum() == pytest.approx(1) and first[1] == 0 and first.argmax() == 0
    assert (column_weights(table(spark, x, y, 7), "x", "y", 4, 2, trees=20, depth=5) == first).all()


@pytest.mark.parametrize("x, y", [([], []), ([[1, 2]], [0]), ([[1, 2], [3, 4]], [0, 0]), ([[1, 2], [1, 2]], [0, 1])])
def test_nothing_to_split(spark, x, y):
    assert column_weights(table(spark, x, y), "x", "y", 2, 2, trees=3, depth=3).tolist() == [0, 0]
