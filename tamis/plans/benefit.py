"""The accuracy model: plans to feature vectors, boosted trees, clipped predictions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.boosting import SQUARE, Boosting, Ensemble, boost
from tamis.functions.keys import seeded_unit
from tamis.operators.score import MODELS
from tamis.plans.cost import METHOD_PARAMS
from tamis.plans.profile import META_NAMES
from tamis.plans.space import method_options

# Families of the classifiers.
MODEL_FAMILIES = {
    "model_is_linear": ["LDA", "LR", "SVM"],
    "model_is_tree": ["CART", "RF", "XGB"],
    "model_is_bayes": ["NB", "MNB"],
    "model_requires_nonnegative": ["MNB"],
    "model_has_regularization": ["LR", "MLP", "SVM"],
    "model_generative": ["LDA", "NB", "MNB"],
}


def model_columns(model: Column) -> list[Column]:
    out = [F.when(model == name, 1.0).otherwise(0.0).alias(f"model_{name}") for name in MODELS]
    return out + [F.when(model.isin(*names), 1.0).otherwise(0.0).alias(f) for f, names in MODEL_FAMILIES.items()]


def stage_param_names(stage: str, methods: list[str]) -> list[str]:
    return sorted({p for m in methods for p in METHOD_PARAMS[stage][m]})


def feature_columns(space: str = "legacy", method_params: bool = False, context: bool = False) -> list[Column]:
    """One slot per method holding its degree, then method parameters, dataset and model features.

    Plans carry ``m_<stage>`` and ``e_<stage>``; with ``context`` also ``model`` and the dataset
    meta-features.
    """
    options = method_options(space)
    out = []
    for stage, methods in options.items():
        for m in methods:
            out.append(F.when(F.col(f"m_{stage}") == m, F.col(f"e_{stage}")).otherwise(0.0).alias(f"x_{m}"))
    if method_params:
        for stage, methods in options.items():
            for p in stage_param_names(stage, methods):
                value = F.lit(0.0)
                for m in methods:
                    v = float(METHOD_PARAMS[stage][m].get(p, 0))
                    if v:
                        value = F.when(F.col(f"m_{stage}") == m, F.lit(v)).otherwise(value)
                out.append(value.alias(f"p_{stage}_{p}"))
    if context:
        out += [F.col(c).cast("double") for c in META_NAMES] + model_columns(F.col("model"))
    return out


def clipped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


class BenefitModel:
    """Fitted trees as flat arrays; ``score`` adds the predicted utility ``u`` to plan rows, as one expression."""

    def __init__(self, trees: Ensemble, space: str, method_params: bool, context: bool, mse: float | None):
        self.trees, self.space, self.method_params, self.context, self.mse = trees, space, method_params, context, mse

    def score(self, plans: DataFrame) -> DataFrame:
        columns = feature_columns(self.space, self.method_params, self.context)
        names = [f"__f{i}" for i in range(len(columns))]
        wide = plans.select("*", *[c.alias(n) for c, n in zip(columns, names)])
        return wide.select(*[F.col(c) for c in plans.columns], clipped(F.expr(self.trees.text(names))).alias("u"))

    def save(self, path: str) -> None:
        text = json.dumps({"trees": self.trees.state(), "space": self.space, "method_params": self.method_params, "context": self.context, "mse": self.mse})
        SparkSession.getActiveSession().createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> BenefitModel:
        s = json.loads(spark.read.text(path).first()["value"])
        return BenefitModel(Ensemble.from_state(s["trees"]), s["space"], s["method_params"], s["context"], s["mse"])


def holdout(records: DataFrame, keys: list[str], rate: float = 0.2, seed: int = 42) -> Column:
    return seeded_unit(seed, "benefit", *[F.col(k) for k in keys]) < rate


def train_benefit(
    records: DataFrame, keys: list[str], space: str = "legacy", method_params: bool = False, context: bool = False,
    trees: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42, cuts: list[float] | None = None,
) -> BenefitModel:
    """Boosted trees on 80 % of the records with an accuracy; squared error on the rest.

    ``cuts``: the same cuts for every feature instead of those that sketches place.
    """
    usable = records.where(F.col("accuracy").isNotNull())
    columns = feature_columns(space, method_params, context)
    vector = F.array(*[c.cast("double") for c in columns])
    rows = usable.select("*", vector.alias("__x"), F.col("accuracy").cast("double").alias("__t"), holdout(usable, keys, seed=seed).alias("__held"))
    settings = Boosting(rounds=trees, depth=depth, rate=rate, seed=seed)
    given = [np.array(cuts)] * len(columns) if cuts is not None else None
    fitted = boost(rows.where(~F.col("__held")), "__x", "__t", len(columns), SQUARE, settings, cuts=given)
    model = BenefitModel(fitted, space, method_params, context, None)
    held = model.score(rows.where("__held").drop("__x"))
    model.mse = held.agg(F.avg(F.pow(F.col("__t") - F.col("u"), 2))).first()[0]
    return model


def pool(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """Records of all (dataset, model) pairs with their dataset features; pairs without a profile drop out."""
    return records.join(profiles, "dataset")


def mean_squared_error(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    usable = rows.where(truth.isNotNull())
    return usable.agg(F.avg(F.pow(truth - clipped(predicted), F.lit(2.0))).alias("mse"), F.count(F.lit(1)).alias("n"))
