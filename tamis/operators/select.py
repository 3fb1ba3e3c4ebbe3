"""Feature selection: one statistic per column from the fitted sample, then a column list."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.extra_trees import column_weights
from tamis.functions.hinge import sparse_machine
from tamis.functions.schema import feature_columns, finite_or_null, no_nulls, numeric_columns, quoted
from tamis.functions.stats import correlations, moments, summaries
from tamis.operators.base import Settings, Stage, register, training_sample
from tamis.operators.extract import apply_kept


def _scored(columns: list[str], scores: dict, keep: list[str]) -> dict:
    return {"columns": columns, "scores": scores, "keep": keep}


def fit_correlation(df: DataFrame, s: Settings) -> dict:
    """A column goes if it correlates with any earlier column, itself dropped or not."""
    numeric = numeric_columns(df, s.label)
    if not numeric:
        raise ValueError("no numeric columns to correlate")
    corr = correlations(training_sample(df, s.degree), numeric)
    worst = {c: 0.0 for c in numeric}
    for (_, later), r in corr.items():
        if r is not None:
            worst[later] = max(worst[later], abs(r))
    drop = {c for c in numeric if worst[c] > s.threshold}
    return _scored(numeric, worst, [c for c in feature_columns(df, s.label) if c not in drop])


def fit_variance(df: DataFrame, s: Settings) -> dict:
    numeric = numeric_columns(df, s.label)
    if not numeric:
        return _scored([], {}, feature_columns(df, s.label))
    stats = summaries(training_sample(df, s.degree), {c: quoted(c).cast("double") for c in numeric}, {"d": F.stddev_samp})
    scores = {c: stats[c]["d"] for c in numeric}
    known = [v for v in scores.values() if v is not None]
    cut = float(np.percentile(known, 100.0 * s.threshold)) if known else math.inf
    return _scored(numeric, scores, [c for c in numeric if scores[c] is not None and scores[c] >= cut])


def fit_missing(df: DataFrame, s: Settings) -> dict:
    columns = feature_columns(df, s.label)
    stats = summaries(training_sample(df, s.degree), {c: quoted(c).isNull().cast("double") for c in columns}, {"r": F.avg})
    scores = {c: stats[c]["r"] or 0.0 for c in columns}
    keep = [c for c in columns if scores[c] <= s.threshold]
    if not keep and columns:
        keep = [min(columns, key=lambda c: scores[c])]
    return _scored(columns, scores, keep)


def fit_weighted(df: DataFrame, s: Settings) -> dict:
    """Chi-square of column sums per class after a shift to zero; the best ten."""
    numeric = numeric_columns(df, s.label)
    _need_label(s)
    values = {c: finite_or_null(quoted(c).cast("double")) for c in numeric}
    clean = training_sample(df, s.degree).select(quoted(s.label).alias("__y"), *[values[c].alias(f"__x{i}") for i, c in enumerate(numeric)])
    clean = clean.na.drop("any")
    table = clean.groupBy("__y").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(f"__x{i}").alias(f"{tag}{i}") for i in range(len(numeric)) for tag, f in (("s", F.sum), ("m", F.min))],
    )
    rows = table.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the label has more than 10000 classes")
    scores = {}
    total = sum(r["n"] for r in rows)
    for i, c in enumerate(numeric):
        if not rows:
            continue
        low = min(r[f"m{i}"] for r in rows)
        observed = [r[f"s{i}"] - low * r["n"] for r in rows]
        whole = sum(observed)
        expected = [whole * r["n"] / total for r in rows]
        scores[c] = sum((o - e) ** 2 / e for o, e in zip(observed, expected)) if whole > 0 else math.nan
    ranked = sorted(scores, key=lambda c: (-scores[c] if scores[c] == scores[c] else math.inf, numeric.index(c)))
    best = set(ranked[: int(s.best)])
    return _scored(numeric, scores, [c for c in numeric if c in best])


def _need_label(s: Settings) -> None:
    if s.label is None:
        raise ValueError(f"{s.method} needs the label option")


def _labelled(df: DataFrame, s: Settings) -> tuple[list[str], DataFrame]:
    _need_label(s)
    numeric = numeric_columns(df, s.label)
    if not numeric:
        raise ValueError(f"{s.method} needs at least one numeric column")
    clean = training_sample(df, s.degree).where(no_nulls([*numeric, s.label]))
    indexed = StringIndexer(inputCol="__t", outputCol="__y", stringOrderType="alphabetAsc").fit(
        clean.select(quoted(s.label).cast("string").alias("__t"))
    )
    labelled = indexed.transform(clean.withColumn("__t", quoted(s.label).cast("string")))
    return numeric, VectorAssembler(inputCols=numeric, outputCol="__x").transform(labelled).select("__x", "__y")


def fit_tree(df: DataFrame, s: Settings) -> dict:
    """Columns with at least the mean weight in extremely randomised trees."""
    numeric, data = _labelled(df, s)
    rows = data.select(vector_to_array("__x").alias("x"), "__y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes = int(rows.agg(F.coalesce(F.max("__y"), F.lit(0.0))).first()[0]) + 1
        weights = column_weights(rows, "x", "__y", len(numeric), classes, int(s.trees), int(s.tree_depth), seed=int(s.seed))
    finally:
        rows.unpersist()
    return _scored(numeric, dict(zip(numeric, map(float, weights))), [c for c, w in zip(numeric, weights) if w >= weights.mean()])


def fit_svc(df: DataFrame, s: Settings) -> dict:
    """Columns with a weight in a linear machine with squared hinge loss and L1 penalty, on standardized columns."""
    numeric, data = _labelled(df, s)
    rows = data.select(vector_to_array("__x").alias("x"), "__y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, mean, cov = moments(rows, [F.get("x", F.lit(i)) for i in range(len(numeric))])
        if not n:
            raise ValueError("SVC selection needs rows without gaps")
        spread = np.where(np.diag(cov) > 0, np.sqrt(np.maximum(np.diag(cov), 0)), 1.0)
        classes = rows.agg(F.max("__y")).first()[0] + 1
        machine = sparse_machine(rows, np.asarray(mean), spread, cov / np.outer(spread, spread), int(classes), s.l1_weight)
    finally:
        rows.unpersist()
    weights = np.abs(machine.weights).max(axis=0)
    keep = [c for c, w in zip(numeric, weights) if w > 0]
    if not keep:
        raise ValueError("SVC selection keeps no column; lower l1_weight")
    return _scored(numeric, dict(zip(numeric, map(float, weights))), keep)


@register
class FeatureSelection(Stage):
    """Methods ``LC VAR Tree SVC MR WR``."""

    STAGE = "feature_selection"
    METHODS = {
        "LC": (fit_correlation, apply_kept),
        "VAR": (fit_variance, apply_kept),
        "Tree": (fit_tree, apply_kept),
        "SVC": (fit_svc, apply_kept),
        "MR": (fit_missing, apply_kept),
        "WR": (fit_weighted, apply_kept),
    }
    OPTIONS = {"threshold": 0.3, "best": 10, "trees": 50, "tree_depth": 10, "l1_weight": 0.02, "seed": 1}


def score_table(model) -> list[tuple]:
    """(column, score, kept) rows of a fitted selection or cfs stage, for reports."""
    state = model.state
    keep = set(state["keep"])
    return [(c, None if state["scores"].get(c) is None else float(state["scores"][c]), c in keep) for c in state["columns"]]
