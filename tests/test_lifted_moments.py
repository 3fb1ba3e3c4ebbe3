"""Moments of kernel features, summed in the tasks that make them."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tamis.operators import extract


@pytest.mark.parametrize("block", [3, 4096])
def test_one_pass_gives_mean_and_population_covariance(spark, monkeypatch, block):
    monkeypatch.setattr(extract, "LIFTED_ROWS", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 2)) + 5
    state = {"columns": ["a", "b"], "centre": [5.0, 5.0], "scale": [1.0, 2.0], "frequencies": rng.normal(size=(20, 2)).tolist(), "phases": rng.uniform(0, 6, 20).tolist()}
    rows = [(r.tolist(),) for r in x] + [([None, 1.0],), ([2.0, None],)]  # rows with gaps do not count
    mean, cov = extract._lifted_moments(spark.createDataFrame(rows, "x array<double>").repartition(7), state)
    lifted = math.sqrt(2 / 20) * np.cos((x - [5, 5]) / [1, 2] @ np.array(state["frequencies"]).T + state["phases"])
    np.testing.assert_allclose(mean, lifted.mean(axis=0), atol=1e-12)
    np.testing.assert_allclose(cov, np.cov(lifted.T, bias=True), atol=1e-12)
