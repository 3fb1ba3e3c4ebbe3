"""The stage contract: an estimator with options, fitted to a model that is a set of expressions.

A table is one DataFrame with ``row_id``, ``row_hash`` and ``split`` columns. Statistics come from the
training rows of the execution-degree sample; a fitted model is plain data (numbers and column names),
so ``transform`` adds no job and the model can be stored as JSON. Neighbour methods keep a table as well,
trees a list of learners; these are stored beside it.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.keys import RESERVED, SPLIT, in_sample


# the entry of a model's state that holds fitted learners: (column, inputs, learner)
LEARNERS = "models"


class Settings(dict):
    """Option values with attribute access."""

    def __getattr__(self, name):
        try:
            return self[name]
        except KeyError as missing:
            raise AttributeError(name) from missing


class Stage(Estimator):
    """Base of the preparation stages. Unknown options raise."""

    STAGE = ""
    METHODS: dict = {}
    OPTIONS: dict = {}
    # methods whose fit reads nothing; reads all splits, not only the training rows; or keeps a plan over its rows
    LEARNS_NOTHING: frozenset = frozenset()
    EVERY_SPLIT: frozenset = frozenset()
    KEEPS_ROWS: frozenset = frozenset()
    # whether a fit holds its rows; not where the caller holds the table they come from
    hold = True

    def __init__(self, method: str | None = None, **options):
        super().__init__()
        defaults = {"method": next(iter(self.METHODS)), "degree": 1.0, "label": None, **self.OPTIONS}
        for name, value in defaults.items():
            setattr(self, name, Param(self, name, f"{self.STAGE} option {name}"))
            self._setDefault(**{name: value})
        self.set_params(**({"method": method} if method is not None else {}), **options)

    def set_params(self, **options) -> Stage:
        for name in options:
            if not self.hasParam(name):
                raise ValueError(f"{self.STAGE}: unknown option {name}")
        self._set(**options)
        method = self.getOrDefault("method")
        if method not in self.METHODS:
            raise ValueError(f"{self.STAGE}: unknown method {method!r}; one of {sorted(self.METHODS)}")
        if not 0.0 <= float(self.getOrDefault("degree")) <= 1.0:
            raise ValueError("degree must be within [0, 1]")
        return self

    def get_params(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params}

    def _fit(self, df: DataFrame) -> StageModel:
        missing = [c for c in RESERVED if c not in df.columns]
        if missing:
            raise ValueError(f"{self.STAGE}: the table lacks {missing}; key and split it first")
        settings = Settings(self.get_params())
        fit, _ = self.METHODS[settings.method]
        if settings.method in self.LEARNS_NOTHING:
            return StageModel(self.STAGE, dict(settings), fit(df, settings) or {})
        # fits read their rows several times: hold them, once keyed and split, for as long as the fit runs
        rows = df if settings.method in self.EVERY_SPLIT else df.where(F.col(SPLIT) == "train")
        hold = self.hold and settings.method not in self.KEEPS_ROWS and not df.storageLevel.useMemory
        if hold:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return StageModel(self.STAGE, dict(settings), fit(rows, settings) or {})
        finally:
            if hold:
                rows.unpersist()


class StageModel(Model):
    """A fitted stage."""

    def __init__(self, stage: str, settings: dict, state: dict):
        super().__init__()
        self.stage, self.settings, self.state = stage, settings, state

    def _transform(self, df: DataFrame) -> DataFrame:
        _, apply = stage_class(self.stage).METHODS[self.settings["method"]]
        return apply(df, Settings(self.settings), self.state)

    def copy(self, extra=None) -> StageModel:
        return StageModel(self.stage, dict(self.settings), self.state)

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """Numbers and names as JSON; tables as Parquet and learners in their own format beside it."""
        spark = spark or SparkSession.getActiveSession()
        plain = {}
        for key, value in self.state.items():
            if isinstance(value, DataFrame):
                value.write.mode("overwrite").parquet(f"{path}/tables/{key}")
                plain[key] = {"stored": "table"}
            elif key == LEARNERS:
                for i, (_, inputs, learner) in enumerate(value):
                    inputs.write().overwrite().save(f"{path}/learners/{i}/inputs")
                    learner.write().overwrite().save(f"{path}/learners/{i}/model")
                plain[key] = {"stored": [at for at, _, _ in value]}
            else:
                plain[key] = value
        text = json.dumps({"stage": self.stage, "settings": self.settings, "state": plain})
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/state")

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> StageModel:
        """Tables are read when the model is applied, not here."""
        spark = spark or SparkSession.getActiveSession()
        found = json.loads(spark.read.text(f"{path}/state").first()["value"])
        state = found["state"]
        for key, value in state.items():
            if key == LEARNERS:
                read = lambda i, what: (VectorAssembler if what == "inputs" else RandomForestRegressionModel).load(f"{path}/learners/{i}/{what}")
                state[key] = [(at, read(i, "inputs"), read(i, "model")) for i, at in enumerate(value["stored"])]
            elif isinstance(value, dict) and value.get("stored") == "table":
                state[key] = spark.read.parquet(f"{path}/tables/{key}")
        return StageModel(found["stage"], found["settings"], state)


_CLASSES: dict[str, type[Stage]] = {}


def register(cls: type[Stage]) -> type[Stage]:
    _CLASSES[cls.STAGE] = cls
    return cls


def stage_class(stage: str) -> type[Stage]:
    import tamis.operators.stages  # noqa: F401  (registers every stage)

    return _CLASSES[stage]


def training_sample(df: DataFrame, degree: float) -> DataFrame:
    return df.where((F.col(SPLIT) == "train") & in_sample(degree))


def literal(value) -> Column:
    return F.lit(None) if value is None else F.lit(value)


def nothing(df: DataFrame, s: Settings) -> dict:
    """Fit of a method that learns nothing."""
    return {}
