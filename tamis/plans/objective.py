"""Objectives, feasibility and preference of plans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the objectives.
OBJECTIVES = {
    "budget_performance": "budget_performance",
    "performance_under_budget": "budget_performance",
    "max_performance": "budget_performance",
    "target_cost": "target_cost",
    "cost_under_target": "target_cost",
    "min_cost": "target_cost",
    "utility_cost_ratio": "utility_cost_ratio",
    "benefit_cost_ratio": "utility_cost_ratio",
    "ratio": "utility_cost_ratio",
}
BUDGET_SLACK = 1e-9


def objective_name(name: str) -> str:
    key = str(name).lower()
    if key not in OBJECTIVES:
        raise ValueError(f"objective must be one of {sorted(set(OBJECTIVES.values()))}")
    return OBJECTIVES[key]


class Objective:
    """One objective with its parameters. ``floor`` also penalises a missed target in the ratio."""

    def __init__(
        self,
        name: str = "budget_performance",
        budget: float | Column | None = None,
        target: float | None = None,
        baseline: float = 0.0,
        tolerance: float = 1e-6,
        penalty: float = 100.0,
        epsilon: float = 1e-6,
        floor: bool = False,
        enforce_budget: bool | None = None,
    ):
        self.name = objective_name(name)
        self.bounded = self.name == "budget_performance" if enforce_budget is None else enforce_budget
        if self.bounded and budget is None:
            raise ValueError("a budget is required")
        if self.name == "target_cost" and target is None:
            raise ValueError("target_cost needs a target")
        if target is not None and not 0.0 <= target <= 1.0:
            raise ValueError("target must be within [0, 1]")
        self.budget, self.target, self.baseline = budget, target, baseline
        self.tolerance, self.penalty, self.epsilon = tolerance, penalty, epsilon
        self.floor = floor and target is not None

    def limit(self) -> Column:
        return self.budget if isinstance(self.budget, Column) else F.lit(self.budget)

    def value(self, u: Column, cost: Column) -> Column:
        """The scalar to maximise."""
        if self.name == "budget_performance":
            return u
        short = F.greatest(F.lit(0.0), F.lit(self.target if self.target is not None else 0.0) - u)
        if self.name == "target_cost":
            return -cost - self.penalty * short * short
        ratio = (u - self.baseline) / (F.greatest(F.lit(0.0), cost) + self.epsilon)
        return ratio - self.penalty * short * short if self.floor else ratio

    def achieved(self, u: Column) -> Column:
        return u + self.tolerance >= F.lit(self.target)

    def feasible(self, cost: Column) -> Column:
        return cost <= self.limit() + BUDGET_SLACK if self.bounded else F.lit(True)

    def preference(self, u: Column, cost: Column) -> Column:
        """Sort key, larger is better. A met target beats a missed one; then cheaper, then better."""
        if self.name == "budget_performance":
            return F.struct(F.lit(0).alias("met"), u.alias("a"), (-cost).alias("b"))
        if self.name == "utility_cost_ratio":
            value = self.value(u, cost)
            if not self.floor:
                return F.struct(F.lit(0).alias("met"), value.alias("a"), F.lit(0.0).alias("b"))
            met = self.achieved(u)
            return F.struct(
                F.when(met, 1).otherwise(0).alias("met"),
                F.when(met, value).otherwise(u).alias("a"),
                F.when(met, F.lit(0.0)).otherwise(-cost).alias("b"),
            )
        met = self.achieved(u)
        return F.struct(
            F.when(met, 1).otherwise(0).alias("met"),
            F.when(met, -cost).otherwise(u).alias("a"),
            F.when(met, u).otherwise(-cost).alias("b"),
        )


def within_bounds(e: list[Column], low: list[Column], high: list[Column]) -> Column:
    test = F.lit(True)
    for x, lo, hi in zip(e, low, high):
        test = test & (x >= lo - BUDGET_SLACK) & (x <= hi + BUDGET_SLACK) & (x >= -BUDGET_SLACK) & (x <= 1 + BUDGET_SLACK)
    return test
