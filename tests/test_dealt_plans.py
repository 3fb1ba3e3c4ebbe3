import pytest
from pyspark.sql import functions as F

from tamis.plans import allocate
from tamis.plans.allocate import Space, column_score, dealt, monte_carlo
from tamis.plans.objective import Objective


@pytest.fixture
def plans(spark):
    return spark.range(300).select(
        "id", *[F.lit(x).alias(f"{n}_{i}") for i in range(2) for n, x in (("e", 0.5), ("lo", 0.0), ("hi", 1.0))], (F.lit(0.2) + F.col("id") / 300).alias("budget")
    )


def test_tasks_grow_with_the_probes(spark, plans, monkeypatch):
    few = dealt(plans, ["id"], 30).rdd.getNumPartitions()
    monkeypatch.setattr(allocate, "PROBES", 100)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and dealt(plans, ["id"], 30).rdd.getNumPartitions() == 90


def test_draws_are_grouped_where_they_are_made(plans, monkeypatch):
    space = Space(2, Objective(budget=F.col("budget")), cost=lambda e: F.lit(0.05) + F.lit(0.4) * e[0] + F.lit(0.6) * e[1])
    score = column_score(lambda e: F.sqrt(e[0]) + F.sqrt(e[1]), 2)

    def rows():
        return sorted(map(tuple, monte_carlo(plans, space, score, ["id"], 30).collect()))

    few = rows()
    monkeypatch.setattr(allocate, "PROBES", 100)
    assert rows() == few and len(few) == 300
    plan = monte_carlo(plans, space, score, ["id"], 30)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
