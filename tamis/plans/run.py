"""Running plans on a table: the fold over the stages, timing, validation and record generation."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.keys import SPLIT
from tamis.operators.base import StageModel
from tamis.operators.convert import convert
from tamis.operators.score import evaluate
from tamis.operators.split import stratified_holdout
from tamis.operators.stages import STAGE_ORDER
from tamis.plans.space import draw_plans, method_options
from tamis.plans.tree import Outcome, run_plans
from tamis.sources.records import RECORD_SCHEMA

ROW_REMOVING = {"duplicate_detection", "imputation", "outlier_detection"}


def prepare(
    df: DataFrame, methods: dict, degrees: dict, label: str, options: dict | None = None, keep: bool = True
) -> tuple[DataFrame, list[StageModel]]:
    """Fit and apply the planned stages in order; returns the prepared table and the fitted models.

    With ``keep`` the table is persisted after stages that remove rows, because the fits of the later
    stages read it again; a lost block is recomputed from the plan.
    """
    models = []
    current = df
    for cls in STAGE_ORDER:
        method = methods.get(cls.STAGE)
        if not method:
            continue
        stage = cls(method, degree=float(degrees.get(cls.STAGE, 1.0)), label=label, **(options or {}).get(cls.STAGE, {}))
        model = stage.fit(current)
        current = model.transform(current)
        models.append(model)
        if keep and cls.STAGE in ROW_REMOVING:
            current = current.persist(StorageLevel.MEMORY_AND_DISK)
    return current, models


def apply_models(df: DataFrame, models: list[StageModel]) -> DataFrame:
    for model in models:
        df = model.transform(df)
    return df


def run_plan(df: DataFrame, methods: dict, degrees: dict, label: str, model: str, evaluation: str = "test") -> dict:
    """Prepare, score and time one plan. Preparation and model seconds are kept apart."""
    started = time.perf_counter()
    prepared, _ = prepare(convert(df), methods, degrees, label)
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    rows = {r[SPLIT]: r["count"] for r in prepared.groupBy(SPLIT).count().collect()}
    done = time.perf_counter()
    result = evaluate(prepared, label, model, evaluation)
    prepared.unpersist()
    return {
        **result,
        "prep_seconds": done - started,
        "model_seconds": time.perf_counter() - done,
        "rows": rows,
    }


def validate_plan(df: DataFrame, methods: dict, degrees: dict, label: str, model: str, repeats: int = 3) -> list[dict]:
    """The plan run ``repeats`` times; summarise with ``compare.repeat_summary``."""
    return [{"run": i, **run_plan(df, methods, degrees, label, model)} for i in range(max(1, repeats))]


def training_holdout(df: DataFrame, label: str, rate: float = 0.25) -> DataFrame:
    """The training rows alone, with a stratified holdout as their test split: labels without leakage."""
    train = stratified_holdout(df.where(F.col(SPLIT) == "train"), label, rate)
    return train.withColumn(SPLIT, F.when(F.col("holdout"), "test").otherwise("train")).drop("holdout")


def benefit_records(
    df: DataFrame, dataset: str, label: str, models: list[str], samples: int, space: str = "legacy", source: str = "train_holdout",
    seed: int = 42, parallel: int = 4, first: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Run drawn plans and score them; returns (records, failures).

    The plans are numbered; start at ``first`` to continue an earlier run. The plans of a round run as one tree:
    equal beginnings are prepared once, and all classifiers read one table. Failed plans are redrawn, at most five
    attempts per wanted sample; if these do not suffice, that is an error and not a shorter table.
    """
    if source == "train_holdout":
        base = training_holdout(df, label)
    elif source in ("val", "test"):
        base = df
    else:
        raise ValueError("source must be 'train_holdout', 'val' or 'test'")
    evaluation = "val" if source == "val" else "test"
    spark = df.sparkSession
    options = method_options(space)
    stages = list(options)
    good, bad, number = [], [], first
    last = first + 5 * samples
    while len(good) < samples and number < last:
        size = min(samples - len(good), last - number)
        drawn = draw_plans(spark.range(number, number + size), "id", options, seed).collect()
        number += size
        plans = [(r["id"], {s: r[f"m_{s}"] for s in stages}, {s: r[f"e_{s}"] for s in stages}) for r in drawn]
        scored: dict[int, list[Outcome]] = {}
        for outcome in run_plans(base, plans, label, models, evaluation, parallel=parallel):
            scored.setdefault(outcome.plan, []).append(outcome)
        for name, methods, degrees in plans:
            reason = next((o.reason for o in scored[name] if o.reason), None)
            if reason:
                bad.append((dataset, str(methods), reason))
            else:
                good.append((methods, degrees, scored[name]))
    if len(good) < samples:
        raise RuntimeError(f"{len(good)} of {samples} plans gave a record; the last reason: {bad[-1][2] if bad else 'none'}")
    rows = [
        (dataset, o.model, "e", space, None, source, None, None, None, methods, degrees, float(o.accuracy), o.prep_seconds + o.model_seconds)
        for methods, degrees, scored in good
        for o in scored
    ]
    return spark.createDataFrame(rows, RECORD_SCHEMA), spark.createDataFrame(bad, "dataset string, plan string, reason string")
