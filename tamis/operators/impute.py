"""Missing values: fitted on the training sample, filled in the sample of every split.

Rows outside the sample are dropped if they lack a value, so after the stage no row is half-filled
except for text gaps under the numeric methods.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.keys import ROW_ID, in_sample
from tamis.functions.linear import bayesian_ridge, pinv
from tamis.functions.neighbours import nearest
from tamis.functions.quantiles import exact_quantiles
from tamis.functions.schema import feature_columns, no_nulls, numeric_columns, quoted
from tamis.functions.stats import modes, moments, summaries
from tamis.operators.base import Settings, Stage, literal, nothing, register, training_sample

MAX_PATTERNS = 50_000


def _keep(df: DataFrame, s: Settings) -> DataFrame:
    """The sample, and the rows outside it that lack nothing."""
    return df.where(in_sample(s.degree) | no_nulls(feature_columns(df, s.label)))


def _fill(df: DataFrame, s: Settings, fills: dict[str, Column]) -> DataFrame:
    kept = _keep(df, s)
    return kept.select(
        *[F.coalesce(quoted(c), fills[c]).alias(c) if c in fills else quoted(c) for c in df.columns]
    )


def apply_drop(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    return df.where(no_nulls(feature_columns(df, s.label)))


def fit_mean(df: DataFrame, s: Settings) -> dict:
    stats = summaries(training_sample(df, s.degree), {c: quoted(c) for c in numeric_columns(df, s.label)}, {"m": F.avg})
    return {"fills": {c: v["m"] for c, v in stats.items()}}


def fit_median(df: DataFrame, s: Settings) -> dict:
    q = exact_quantiles(training_sample(df, s.degree), {c: quoted(c) for c in numeric_columns(df, s.label)}, [0.5])
    return {"fills": {c: v[0] for c, v in q.items()}}


def apply_number(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    return _fill(df, s, {c: literal(v).cast("double") for c, v in state["fills"].items()})


def fit_mode(df: DataFrame, s: Settings) -> dict:
    """Modes of the columns that lack a value in the fitted sample."""
    sample = training_sample(df, s.degree)
    columns = feature_columns(df, s.label)
    gaps = summaries(sample, {c: quoted(c).isNull().cast("long") for c in columns}, {"n": F.sum})
    return {"fills": modes(sample, [c for c in columns if gaps[c]["n"]])}


def apply_mode(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return _fill(df, s, {c: literal(v).cast(types[c]) for c, v in state["fills"].items()})


def apply_dummy(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    numeric = set(numeric_columns(df, s.label))
    fills = {}
    for f in df.schema.fields:
        if f.name in feature_columns(df, s.label):
            if f.name in numeric:
                fills[f.name] = F.lit(s.dummy_number).cast(f.dataType)
            elif isinstance(f.dataType, T.StringType):
                fills[f.name] = F.lit(s.dummy_text)
    return _fill(df, s, fills)


# --- k nearest neighbours -------------------------------------------------------------------------


def fit_knn(df: DataFrame, s: Settings) -> dict:
    columns = numeric_columns(df, s.label)
    sample = training_sample(df, s.degree)
    means = summaries(sample, {c: quoted(c) for c in columns}, {"m": F.avg})
    return {
        "columns": columns,
        "means": {c: v["m"] for c, v in means.items()},
        "donors": sample.select(F.col(ROW_ID).alias("did"), _vector(columns).alias("dv")),
    }


def _vector(columns: list[str]) -> Column:
    return F.array(*[quoted(c).cast("double") for c in columns])


def apply_knn(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    columns = state["columns"]
    kept = _keep(df, s)
    holes = F.array_compact(F.array(*[F.when(quoted(c).isNull(), F.lit(i)) for i, c in enumerate(columns)]))
    gaps = kept.where(~no_nulls(columns)).select(
        F.col(ROW_ID).alias("qid"), _vector(columns).alias("qv"), F.explode(holes).alias("want")
    )
    near = nearest(gaps, state["donors"], int(s.neighbours), len(columns))
    filled = near.groupBy("qid").agg(
        *[F.avg(F.when(F.col("want") == i, F.col("value"))).alias(f"__f{i}") for i in range(len(columns))]
    )
    joined = kept.join(filled.withColumnRenamed("qid", ROW_ID), ROW_ID, "left")
    at = {c: i for i, c in enumerate(columns)}
    return joined.select(
        *[
            F.coalesce(quoted(c), F.col(f"__f{at[c]}"), literal(state["means"][c]).cast("double")).alias(c)
            if c in at
            else quoted(c)
            for c in df.columns
        ]
    )


# --- Gaussian expectation-maximization ------------------------------------------------------------


def _pattern(columns: list[str]) -> Column:
    """Bit i is set where column i is missing."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        out = out + F.when(quoted(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return out


def _pattern_rows(df: DataFrame, columns: list[str]) -> list[int]:
    found = [r[0] for r in df.select(_pattern(columns).alias("p")).distinct().limit(MAX_PATTERNS + 1).collect()]
    if len(found) > MAX_PATTERNS:
        raise ValueError("too many patterns of missing values for one broadcast table")
    return found


def _conditional(patterns: list[int], mean: np.ndarray, cov: np.ndarray) -> list[tuple]:
    """Per pattern: constant and weights of the conditional mean of each missing column."""
    p = len(mean)
    rows = []
    for pattern in patterns:
        missing = np.array([(pattern >> i) & 1 for i in range(p)], dtype=bool)
        constant, weights = np.zeros(p), np.zeros((p, p))
        if missing.any():
            constant[missing] = mean[missing]
            if not missing.all():
                seen = ~missing
                part = cov[np.ix_(missing, seen)] @ pinv(cov[np.ix_(seen, seen)])
                constant[missing] -= part @ mean[seen]
                weights[np.ix_(missing, seen)] = part
        rows.append((int(pattern), constant.tolist(), weights.ravel().tolist()))
    return rows


def _with_conditional(df: DataFrame, columns: list[str], rows: list[tuple], names: list[str]) -> DataFrame:
    """Add the filled columns. The pattern table is one small row per pattern, size checked."""
    table = df.sparkSession.createDataFrame(rows, "__p long, __a array<double>, __w array<double>")
    p = len(columns)
    joined = df.withColumn("__p", _pattern(columns)).join(F.broadcast(table), "__p", "left")
    x = [F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in columns]

    def fill(j: int) -> Column:
        total = F.get("__a", F.lit(j))
        for o in range(p):
            if o != j:
                total = total + F.get("__w", F.lit(j * p + o)) * x[o]
        return F.coalesce(quoted(columns[j]).cast("double"), total)

    return joined.select(*[quoted(c) for c in df.columns], *[fill(j).alias(names[j]) for j in range(p)])


def fit_em(df: DataFrame, s: Settings) -> dict:
    """Every round reads the original values, so the plan does not grow with the rounds."""
    columns = numeric_columns(df, s.label)
    if not columns:
        return {"columns": []}
    sample = training_sample(df, s.degree).select(*[quoted(c) for c in columns])
    p = len(columns)
    means = summaries(sample, {c: quoted(c) for c in columns}, {"m": F.avg})
    mean = np.array([means[c]["m"] or 0.0 for c in columns])
    start = sample.select(*[F.coalesce(quoted(c).cast("double"), F.lit(float(mean[i]))).alias(f"f{i}") for i, c in enumerate(columns)])
    names = [f"f{i}" for i in range(p)]
    patterns = _pattern_rows(sample, columns)
    n, _, cov = moments(start, [F.col(c) for c in names])
    ridge = np.eye(p) * 1e-6
    factor = n / (n - 1) if n > 1 else 0.0
    cov = cov * factor + ridge
    # the first round compares with the mean-filled table
    previous = [(pattern, mean.tolist(), [0.0] * (p * p)) for pattern in patterns]
    for _ in range(int(s.em_rounds)):
        current = _conditional(patterns, mean, cov)
        n, mean, cov = moments(_with_conditional(sample, columns, current, names), [F.col(c) for c in names])
        cov = cov * factor + ridge
        if _largest_move(sample, columns, previous, current) < s.em_tolerance:
            break
        previous = current
    return {"columns": columns, "mean": mean.tolist(), "cov": cov.tolist()}


def _largest_move(sample: DataFrame, columns: list[str], before: list[tuple], after: list[tuple]) -> float:
    """Largest change of a filled cell between two rounds, from the differences of their weights."""
    old = {pattern: (np.array(a), np.array(w)) for pattern, a, w in before}
    change = [(p, (np.array(a) - old[p][0]).tolist(), (np.array(w) - old[p][1]).tolist()) for p, a, w in after]
    p = len(columns)
    names = [f"d{i}" for i in range(p)]
    moved = _with_conditional(sample.where(~no_nulls(columns)), columns, change, names)
    cells = [F.when(quoted(c).isNull(), F.abs(F.col(n))) for c, n in zip(columns, names)]
    return moved.agg(*[F.max(c).alias(f"x{i}") for i, c in enumerate(cells)]).select(
        F.greatest(*[F.coalesce(F.col(f"x{i}"), F.lit(0.0)) for i in range(p)], F.lit(0.0))
    ).first()[0]


def apply_em(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    columns = state["columns"]
    if not columns:
        return _keep(df, s)
    kept = _keep(df, s)
    mean, cov = np.array(state["mean"]), np.array(state["cov"])
    patterns = list(range(2 ** len(columns))) if len(columns) <= 10 else _pattern_rows(kept, columns)
    names = [f"__e{i}" for i in range(len(columns))]
    done = _with_conditional(kept, columns, _conditional(patterns, mean, cov), names)
    at = {c: names[i] for i, c in enumerate(columns)}
    return done.select(*[F.col(at[c]).alias(c) if c in at else quoted(c) for c in df.columns])


# --- chained regressions --------------------------------------------------------------------------


def _chain_start(df: DataFrame, columns: list[str], means: dict) -> DataFrame:
    """``c<i>``: current value, starting from the mean; ``g<i>``: the value is missing."""
    return df.select(
        "*",
        *[F.coalesce(quoted(c).cast("double"), literal(means[c]).cast("double"), F.lit(0.0)).alias(f"__c{i}") for i, c in enumerate(columns)],
        *[quoted(c).isNull().alias(f"__g{i}") for i, c in enumerate(columns)],
    )


def _chain_step(df: DataFrame, j: int, p: int, intercept: float, weights: list[float]) -> DataFrame:
    value = F.lit(float(intercept))
    for o in range(p):
        if o != j and weights[o] != 0.0:
            value = value + F.lit(float(weights[o])) * F.col(f"__c{o}")
    return df.withColumn(f"__c{j}", F.when(F.col(f"__g{j}"), value).otherwise(F.col(f"__c{j}")))


def _chain_setup(df: DataFrame, s: Settings):
    columns = numeric_columns(df, s.label)
    sample = training_sample(df, s.degree).select(*[quoted(c) for c in columns])
    stats = summaries(sample, {c: quoted(c) for c in columns}, {"m": F.avg, "n": F.count, "hi": lambda c: F.max(F.abs(c))})
    rows = max([v["n"] for v in stats.values()], default=0)
    gaps = summaries(sample, {c: quoted(c).isNull().cast("long") for c in columns}, {"n": F.sum}) if columns else {}
    # columns with the fewest gaps first
    order = sorted((i for i, c in enumerate(columns) if gaps[c]["n"]), key=lambda i: (gaps[columns[i]]["n"], i))
    largest = max([abs(v["hi"]) for v in stats.values() if v["hi"] is not None], default=0.0)
    return columns, sample, {c: v["m"] for c, v in stats.items()}, order, largest, rows


def _settled(chain: DataFrame, columns: list[str], limit: float) -> bool:
    """True if the largest row-wise change of the round is below the limit."""
    p = len(columns)
    move = F.lit(0.0)
    for i in range(p):
        move = move + F.abs(F.col(f"__c{i}") - F.col(f"__b{i}"))
    return (chain.agg(F.max(move)).first()[0] or 0.0) < limit


def fit_mice(df: DataFrame, s: Settings) -> dict:
    """Bayesian ridge per column and round, each from one pass of sums and cross products."""
    columns, sample, means, order, largest, _ = _chain_setup(df, s)
    p = len(columns)
    steps: list = []
    chain = _chain_start(sample, columns, means)
    if p > 1:
        for _ in range(int(s.mice_rounds)):
            chain = chain.select(*[c for c in chain.columns if not c.startswith("__b")], *[F.col(f"__c{i}").alias(f"__b{i}") for i in range(p)])
            for j in order:
                others = [o for o in range(p) if o != j]
                n, mean, cov = moments(
                    chain.where(~F.col(f"__g{j}")), [F.col(f"__c{o}") for o in others] + [F.col(f"__c{j}")]
                )
                weights, intercept = bayesian_ridge(n, mean[:-1], cov[:-1, :-1] * n, mean[-1], cov[:-1, -1] * n, cov[-1, -1] * n)
                full = [0.0] * p
                for o, w in zip(others, weights):
                    full[o] = float(w)
                steps.append([j, float(intercept), full])
                chain = _chain_step(chain, j, p, intercept, full)
            if not order or _settled(chain, columns, s.chain_tolerance * largest):
                break
    return {"columns": columns, "means": means, "steps": steps}


def apply_mice(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    columns = state["columns"]
    chain = _chain_start(_keep(df, s), columns, state["means"])
    for j, intercept, weights in state["steps"]:
        chain = _chain_step(chain, j, len(columns), intercept, weights)
    return _chain_end(df, columns, chain)


def _chain_end(df: DataFrame, columns: list[str], chain: DataFrame) -> DataFrame:
    at = {c: f"__c{i}" for i, c in enumerate(columns)}
    return chain.select(*[F.col(at[c]).alias(c) if c in at else quoted(c) for c in df.columns])


def fit_tree_chain(df: DataFrame, s: Settings) -> dict:
    """One randomized regression tree per column and round; complete columns are skipped."""
    columns, sample, means, order, largest, _ = _chain_setup(df, s)
    p = len(columns)
    chain = _chain_start(sample, columns, means)
    models: list = []
    if p > 1:
        for _ in range(int(s.tree_rounds)):
            chain = chain.select(*[c for c in chain.columns if not c.startswith("__b")], *[F.col(f"__c{i}").alias(f"__b{i}") for i in range(p)])
            for j in order:
                others = VectorAssembler(inputCols=[f"__c{o}" for o in range(p) if o != j], outputCol="__x")
                learner = RandomForestRegressor(
                    featuresCol="__x", labelCol=f"__c{j}", predictionCol="__y", numTrees=1, maxDepth=int(s.tree_depth),
                    featureSubsetStrategy="sqrt", bootstrap=False, seed=0,
                )
                model = learner.fit(others.transform(chain.where(~F.col(f"__g{j}"))).select("__x", f"__c{j}"))
                models.append((j, others, model))
                chain = _tree_step(chain, j, others, model)
            if not order or _settled(chain, columns, s.chain_tolerance * largest):
                break
    return {"columns": columns, "means": means, "models": models}


def _tree_step(chain: DataFrame, j: int, others: VectorAssembler, model) -> DataFrame:
    scored = model.transform(others.transform(chain))
    return scored.withColumn(f"__c{j}", F.when(F.col(f"__g{j}"), F.col("__y")).otherwise(F.col(f"__c{j}"))).drop("__x", "__y")


def apply_tree_chain(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    chain = _chain_start(_keep(df, s), state["columns"], state["means"])
    for j, others, model in state["models"]:
        chain = _tree_step(chain, j, others, model)
    return _chain_end(df, state["columns"], chain)


@register
class Imputation(Stage):
    """Methods ``DROP MEAN MEDIAN MF MICE KNN EM DT DUMMY``; ``DROP`` does not depend on the degree."""

    STAGE = "imputation"
    METHODS = {
        "DROP": (nothing, apply_drop),
        "MEAN": (fit_mean, apply_number),
        "MEDIAN": (fit_median, apply_number),
        "MF": (fit_mode, apply_mode),
        "MICE": (fit_mice, apply_mice),
        "KNN": (fit_knn, apply_knn),
        "EM": (fit_em, apply_em),
        "DT": (fit_tree_chain, apply_tree_chain),
        "DUMMY": (nothing, apply_dummy),
    }
    LEARNS_NOTHING = frozenset({"DROP", "DUMMY"})
    KEEPS_ROWS = frozenset({"KNN"})
    OPTIONS = {
        "neighbours": 4,
        "em_rounds": 10,
        "em_tolerance": 1e-5,
        "mice_rounds": 3,
        "tree_rounds": 5,
        "tree_depth": 10,
        "chain_tolerance": 1e-3,
        "dummy_number": -1.0,
        "dummy_text": "dummy_category",
    }
