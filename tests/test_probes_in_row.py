"""Probes of a plan as its columns, against probes as rows that are grouped."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.plans.allocate import Space, column_score, frank_wolfe, gaussian_directions, smoothed_gradient, smoothed_gradient_in_row
from tamis.plans.objective import Objective


def _utility(e):
    return 0.6 + 0.15 * F.sqrt(e[0]) + 0.2 * F.sqrt(e[1])


def _cost(e):
    return 0.05 + 0.4 * e[0] + 0.6 * e[1]


def _plans(spark, keys):
    rows = [(k, 0.0, 1.0, 0.0, 1.0, 0.02 + 0.07 * i) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "id long, lo_0 double, hi_0 double, lo_1 double, hi_1 double, budget double")


def _rows(df):
    return sorted(([None if x is None else round(x, 9) if isinstance(x, float) else x for x in r] for r in df.collect()), key=str)


def test_probes_in_row_are_those_of_grouped_rows(spark):
    space = Space(2, Objective(budget=F.col("budget")), cost=_cost, affine=True)
    plans = _plans(spark, range(1, 13)).where("budget > 0.1").withColumn("e_0", F.lit(0.1)).withColumn("e_1", F.col("budget") / 2 - 0.04)
    drawn = gaussian_directions(["id"], 2, 3, 42, 1)
    names = ["id", "g_0", "g_1", "probe.u", "probe.cost", "probe.e_0", "probe.e_1"]
    row = smoothed_gradient_in_row(plans, space, _utility, drawn, 0.1)
    assert "Exchange" not in row._jdf.queryExecution().executedPlan().toString()
    assert _rows(row.select(*names)) == _rows(smoothed_gradient(plans, space, column_score(_utility, 2), ["id"], drawn, 0.1).select(*names))


def test_plans_are_the_same_with_and_without_grouping(spark):
    """Repeated and null keys become one plan either way."""
    plans = _plans(spark, [1, 2, 3, 4, 5, 6, 7, None, 8]).unionByName(_plans(spark, [1, 2]))
    space = Space(2, Objective(budget=F.col("budget")), cost=_cost, affine=True)
    grouped = column_score(_utility, 2)
    moves = {"rounds": 2, "checkpoint_every": 1}
    assert _rows(frank_wolfe(plans, space, column_score(_utility, 2), ["id"], **moves)) == _rows(frank_wolfe(plans, space, lambda df: grouped(df), ["id"], **moves))
