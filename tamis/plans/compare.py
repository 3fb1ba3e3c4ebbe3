"""Comparison of planners over result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["actual_acc", "actual_time", "budget_utilization", "gain_per_cost"]


def repeat_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and deviations over repeated runs, and the run whose time is the upper median."""
    by_time = Window.partitionBy(*keys).orderBy("actual_time", "run")
    whole = Window.partitionBy(*keys)
    # a group holds the few repeats of one plan (three by default)
    marked = runs.select(
        "*", F.row_number().over(by_time).alias("__at"), F.count(F.lit(1)).over(whole).alias("__n")
    )
    return marked.groupBy(*keys).agg(
        F.percentile("actual_acc", F.lit(0.5)).alias("actual_acc"),
        F.percentile("actual_f1", F.lit(0.5)).alias("actual_f1"),
        F.percentile("actual_time", F.lit(0.5)).alias("actual_time"),
        F.stddev_pop("actual_acc").alias("actual_acc_std"),
        F.stddev_pop("actual_time").alias("actual_time_std"),
        F.max(F.when(F.col("__at") == F.floor(F.col("__n") / 2) + 1, F.col("run"))).alias("median_run"),
    )


def flat_text(entries: Column, fmt: Callable | None = None) -> Column:
    """``key=value`` pairs of a map in key order, joined by semicolons."""
    pairs = F.array_sort(F.transform(F.map_entries(entries), lambda kv: F.concat(kv["key"], F.lit("="), fmt(kv["value"]) if fmt else kv["value"])))
    return F.concat_ws(";", pairs)


def result_record(df: DataFrame) -> DataFrame:
    """Add gain, gain per cost, budget use and the flattened plan to rows of validated plans."""
    gain = F.col("actual_acc") - F.col("base_acc")
    return df.select(
        "*",
        gain.alias("gain"),
        F.when(F.col("actual_time") > 0, gain / F.when(F.col("actual_time") > 0, F.col("actual_time"))).alias("gain_per_cost"),
        F.when(F.col("budget") > 0, F.col("actual_time") / F.when(F.col("budget") > 0, F.col("budget"))).alias("budget_utilization"),
        flat_text(F.col("methods")).alias("methods_text"),
        flat_text(F.col("degrees"), lambda v: F.format_string("%.4f", v)).alias("degrees_text"),
    )


def average_by_planner(results: DataFrame) -> DataFrame:
    return results.groupBy("method").agg(*[F.avg(m).alias(m) for m in METRICS]).orderBy(F.desc("actual_acc"), "method")


def best_by_case(results: DataFrame, tie: list[str]) -> DataFrame:
    """Best row per (dataset, budget) by accuracy; ties by ``tie``."""
    window = Window.partitionBy("dataset", "budget").orderBy(F.desc("actual_acc"), *tie)
    best = results.where(F.col("actual_acc").isNotNull()).withColumn("__rn", F.row_number().over(window)).where("__rn = 1")
    return best.select(
        "dataset", "budget", F.col("method").alias("best_method"), F.col("actual_acc").alias("best_acc"), "actual_time",
        "budget_utilization", "gain_per_cost",
    )


def win_counts(best: DataFrame, planners: DataFrame) -> DataFrame:
    """Wins per planner; planners without a win count 0."""
    wins = best.groupBy(F.col("best_method").alias("method")).agg(F.count(F.lit(1)).alias("wins"))
    return planners.join(wins, "method", "left").select("method", F.coalesce("wins", F.lit(0)).cast("long").alias("wins"))


def rerank(candidates: DataFrame, group: list[str], guard: float = 0.95) -> DataFrame:
    """Validated candidates: within the guarded budget first, then within the budget, else the cheapest.

    Columns selection_acc, selection_time, pred_time, budget, restart.
    """
    valid = F.col("selection_acc").isNotNull() & F.col("selection_time").isNotNull()
    tier = (
        F.when(valid & (F.col("selection_time") <= F.col("budget") * guard), 0)
        .when(valid & (F.col("selection_time") <= F.col("budget")), 1)
        .otherwise(2)
    )
    marked = candidates.withColumn("tier", tier)
    inside = F.col("tier") < 2
    window = Window.partitionBy(*group).orderBy(
        "tier",
        F.desc(F.when(inside, F.col("selection_acc"))),
        F.when(inside, F.col("selection_time")),
        F.when(~inside, F.col("pred_time")).asc_nulls_last(),
        "restart",
    )
    return marked.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn").withColumn("feasible", inside)


def running_best(trace: DataFrame, group: list[str], order: str, value: str, chunk: int = 65_536) -> DataFrame:
    """Running maximum of a search trace by its integer step.

    The trace of a long search is cut into chunks of steps: a window inside each chunk, and one over
    the chunk maxima, so a search of any length is shared by many tasks.
    """
    chunked = trace.withColumn("__chunk", F.floor(F.col(order) / chunk))
    inside = Window.partitionBy(*group, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = chunked.groupBy(*group, "__chunk").agg(F.max(value).alias("__top")).withColumn("__before", F.max("__top").over(before)).drop("__top")
    joined = chunked.withColumn("__in", F.max(value).over(inside)).join(tops, [*group, "__chunk"])
    return joined.select(*trace.columns, F.greatest("__in", "__before").alias("best_so_far"))
