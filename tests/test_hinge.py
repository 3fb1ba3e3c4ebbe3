"""Sparse machines against closed cases."""

from itertools import product

import numpy as np
import pytest

from tamis.functions.hinge import sparse_machine
from tamis.operators.stages import FeatureSelection


def fitted(spark, x, y, penalty, classes=2, **options):
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, y double").repartition(3)
    return sparse_machine(rows, np.zeros(x.shape[1]), np.ones(x.shape[1]), x.T @ x / len(x), classes, penalty, **options)


@pytest.mark.parametrize("penalty", [0.02, 0.5, 1.9, 2.5])
def test_orthogonal_columns(spark, penalty):
    """One column is the sign: (1 - w)^2 + penalty |w| is least at 1 - penalty / 2; the others are orthogonal to it."""
    x = np.array(list(product([-1.0, 1.0], repeat=4)))
    done = fitted(spark, x, (x[:, 1] > 0).astype(float), penalty)
    assert done.weights[0] == pytest.approx([0, max(0.0, 1 - penalty / 2), 0, 0], abs=1e-5)
    assert (done.weights[0] != 0).tolist() == [False, penalty < 2, False, False] and done.gap <= 1e-6


def test_one_against_the_rest(spark):
    x = np.repeat(np.eye(3), 40, axis=0) * 3 ** 0.5
    x = np.hstack([x - x.mean(axis=0), np.tile([[1.0], [-1.0]], (60, 1))])
    done = fitted(spark, x, np.repeat([0, 1, 2], 40), 0.01, classes=3)
    assert done.weights.shape == (3, 4) and (done.weights[:, 3] == 0).all()
    scores = x @ done.weights.T + done.intercept
    assert (scores.argmax(axis=1) == np.repeat([0, 1, 2], 40)).all()


def test_rounds_that_do_not_suffice_are_an_error(spark):
    x = np.random.default_rng(1).normal(size=(50, 3))
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        fitted(spark, x, (x[:, 0] > 0).astype(float), 0.01, rounds=2)


def test_selection_keeps_the_columns_that_matter(spark, keyed_frame):
    rng = np.random.default_rng(5)
    rows = [(i, *(float(v) for v in r), "yes" if r[0] + 0.5 * r[2] > 0 else "no") for i, r in enumerate(rng.normal(size=(400, 4)))]
    df = keyed_frame(rows, "id long, a double, b double, c double, d double, y string")
    model = FeatureSelection("SVC", label="y", l1_weight=0.2).fit(df)
    assert model.state["keep"] == ["a", "c"] and model.state["scores"]["a"] > model.state["scores"]["c"] > 0
