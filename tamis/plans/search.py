"""Searches over all combinations and budgets in one plan table.

A case is a row with its keys, a ``budget`` and the cost lines of its dataset: per stage a map from method to
(k, b). Every case meets every combination of methods by decoding a number, so there is no cross join; degrees are
allocated and plans priced and scored row by row; the best plan of a case is limited map-side before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.keys import seeded_unit
from tamis.plans.allocate import Score, Space, balanced_start, best_plan, cols, frank_wolfe_deterministic, hybrid_rule
from tamis.plans.benefit import BenefitModel
from tamis.plans.space import combo_columns, combo_count, combos_per_row, per_row
from tamis.session import cut_lineage

Allocate = Callable[[DataFrame, Space], DataFrame]


def with_lines(plans: DataFrame, options: dict[str, list], prefix: str, low: float) -> DataFrame:
    """Cost lines and bounds of the chosen methods, stage by stage; plans of a method without a line go."""
    lines = [F.col(f"{prefix}{stage}")[F.col(stage)] for stage in options]
    # the sum keeps the optimizer from repeating the lookup wherever a line is used: a bare extraction counts as free
    named = [c for i, line in enumerate(lines) for c in ((line["k"] + 0.0).alias(f"k_{i}"), (line["b"] + 0.0).alias(f"b_{i}"))]
    bounds = [c for i in range(len(lines)) for c in (F.lit(low).alias(f"lo_{i}"), F.lit(1.0).alias(f"hi_{i}"))]
    kept = [F.col(c) for c in plans.columns if not c.startswith(prefix)]
    priced = plans.select(*kept, *named, *bounds)
    known = F.lit(True)
    for i in range(len(lines)):
        known = known & F.col(f"k_{i}").isNotNull()
    return priced.where(known)


def search(
    cases: DataFrame, options: dict[str, list], prefix: str, space: Space, score: Score, keys: list[str],
    allocate: Allocate = balanced_start, hybrid: bool = True, low: float = 0.2,
) -> DataFrame:
    """The preferred plan of each case over all combinations.

    ``hybrid``: combinations whose full degrees are affordable take them, those whose lowest degrees are too dear
    are skipped, and only the others are allocated. Otherwise all combinations are allocated.
    """
    plans = with_lines(combos_per_row(cases, options), options, prefix, low)
    if hybrid:
        marked = hybrid_rule(plans, space, low).where("branch <> 'skip'").drop("full_cost", "low_cost")
        moved = allocate(marked, space)
        full = F.col("branch") == "direct"
        chosen = [F.when(full, F.lit(1.0)).otherwise(e).alias(f"e_{i}") for i, e in enumerate(cols("e", space.d))]
        plans = moved.select(*[c for c in moved.columns if not c.startswith("e_")], *chosen)
    else:
        plans = allocate(plans, space)
    return best_plan(score(space.priced(plans)), space, keys, ["combo_id"])


def model_score(model: BenefitModel, options: dict[str, list], digits: int = 9) -> Score:
    """Scores plans with stage columns and degrees ``e_i`` by an accuracy model; equal up to ``digits`` is equal."""

    def score(plans: DataFrame) -> DataFrame:
        named = [c for i, s in enumerate(options) for c in (F.col(s).alias(f"m_{s}"), F.col(f"e_{i}").alias(f"e_{s}"))]
        kept = [c for c in plans.columns if c != "u"]
        return model.score(plans.select(*kept, *named)).select(*kept, F.round("u", digits).alias("u"))

    return score


def model_search(
    cases: DataFrame, options: dict[str, list], prefix: str, space: Space, score: Score, keys: list[str], low: float = 0.2, **moves
) -> DataFrame:
    """The hybrid search with Frank-Wolfe moves: affordable combinations at full degrees, those that even the lowest
    degrees make too dear left out, all others moved by ``moves`` (options of the deterministic allocation)."""
    plans = with_lines(combos_per_row(cases, options), options, prefix, low)
    marked = hybrid_rule(plans, space, low).drop("full_cost", "low_cost")
    at = [*keys, "combo_id"]
    full = marked.where("branch = 'direct'").select("*", *[F.lit(1.0).alias(f"e_{i}") for i in range(space.d)])
    kept = [*at, "branch", "u", "cost", *[f"e_{i}" for i in range(space.d)]]
    direct = score(space.priced(full)).select(*kept)
    moved = frank_wolfe_deterministic(marked.where("branch = 'optimise'").drop("branch"), space, score, at, **moves)
    found = direct.unionByName(moved.withColumn("branch", F.lit("optimise")).select(*kept))
    return best_plan(found, space, keys, ["combo_id"])


def drawn_plans(cases: DataFrame, options: dict[str, list], keys: list[str], draws: int, low: float, seed: int) -> DataFrame:
    """``draws`` random combinations with random degrees per case."""
    many = per_row(cases, draws, "draw")
    at = [F.col(k) for k in keys] + [F.col("draw")]
    number = F.least(F.floor(seeded_unit(seed, "combo", *at) * combo_count(options)), F.lit(combo_count(options) - 1))
    numbered = many.withColumn("combo_id", number.cast("long"))
    degrees = [(F.lit(low) + seeded_unit(seed, "degree", i, *at) * (1.0 - low)).alias(f"e_{i}") for i in range(len(options))]
    return numbered.select("*", *combo_columns(options, F.col("combo_id")), *degrees)


def random_search(
    cases: DataFrame, options: dict[str, list], prefix: str, space: Space, validate: Score, keys: list[str],
    draws: int = 120, low: float = 0.1, seed: int = 42,
) -> DataFrame:
    """Random plans within the budget are validated: the best accuracy, then the shorter time; else the cheapest drawn plan.

    ``validate`` adds ``u``, the accuracy of a run of the plan.
    """
    plans = space.priced(with_lines(drawn_plans(cases, options, keys, draws, low, seed), options, prefix, low))
    tried = validate(plans).withColumn("feasible", F.col("cost") <= space.objective.limit())
    inside = F.col("feasible")
    order = [F.desc("feasible"), F.desc(F.when(inside, F.col("u"))), F.col("cost"), F.col("draw")]
    window = Window.partitionBy(*keys).orderBy(*order)
    return tried.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def multi_start(
    cases: DataFrame, options: dict[str, list], prefix: str, space: Space, score: Score, keys: list[str],
    starts: int = 3, low: float = 0.2, seed: int = 42,
) -> DataFrame:
    """One best plan per case and restart; every restart moves from the lowest degrees toward its own random ones."""
    again = cases.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))

    def toward_draw(plans: DataFrame, space: Space) -> DataFrame:
        at: list[Column] = [*[F.col(k) for k in keys], F.col("restart"), F.col("combo_id")]
        draws = [lo + seeded_unit(seed, "start", i, *at) * (hi - lo) for i, (lo, hi) in enumerate(zip(cols("lo", space.d), cols("hi", space.d)))]
        drawn = space.startable(plans).select("*", *[x.alias(f"__t_{i}") for i, x in enumerate(draws)])
        names = [f"e_{i}" for i in range(space.d)]
        return space.toward(drawn, cols("lo", space.d), cols("__t", space.d), names).drop(*[f"__t_{i}" for i in range(space.d)])

    # a row per case and restart: what ranks them need not plan the whole search again
    return cut_lineage(search(again, options, prefix, space, score, [*keys, "restart"], toward_draw, hybrid=False, low=low))
