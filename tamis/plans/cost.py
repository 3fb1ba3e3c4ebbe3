"""Cost of stages and plans as column expressions over measurement and method tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.quantiles import grouped_quantile

# Features of each method, by stage.
METHOD_PARAMS = {
    "duplicate_detection": {
        "ED": {"approximate": 0, "string_similarity": 0},
        "AD": {"approximate": 1, "string_similarity": 1},
    },
    "feature_encoding": {
        "ordinal": {"encoding_dim_factor": 1, "needs_target": 0},
        "onehot": {"encoding_dim_factor": 2, "needs_target": 0},
        "count": {"encoding_dim_factor": 1, "needs_target": 0},
        "target": {"encoding_dim_factor": 1, "needs_target": 1},
    },
    "imputation": {
        "DROP": {"iterative": 0, "neighbor_based": 0},
        "MEAN": {"iterative": 0, "neighbor_based": 0},
        "MEDIAN": {"iterative": 0, "neighbor_based": 0},
        "MF": {"iterative": 1, "neighbor_based": 0},
        "MICE": {"iterative": 1, "neighbor_based": 0},
        "KNN": {"iterative": 0, "neighbor_based": 1},
        "EM": {"iterative": 1, "neighbor_based": 0},
        "DT": {"iterative": 1, "neighbor_based": 0},
        "DUMMY": {"iterative": 0, "neighbor_based": 0},
    },
    "data_normalization": {
        "z_score": {"robust_scale": 0, "nonlinear_map": 0},
        "robust": {"robust_scale": 1, "nonlinear_map": 0},
        "min_max": {"robust_scale": 0, "nonlinear_map": 0},
        "max_abs": {"robust_scale": 0, "nonlinear_map": 0},
        "normalizer": {"robust_scale": 0, "nonlinear_map": 0},
        "sigmoid": {"robust_scale": 0, "nonlinear_map": 1},
        "quantile_uniform": {"robust_scale": 1, "nonlinear_map": 1},
        "quantile_normal": {"robust_scale": 1, "nonlinear_map": 1},
        "power": {"robust_scale": 0, "nonlinear_map": 1},
        "kbins_uniform": {"robust_scale": 0, "nonlinear_map": 1},
        "kbins_quantile": {"robust_scale": 1, "nonlinear_map": 1},
    },
    "outlier_detection": {
        "ZSB": {"density_based": 0, "global_rule": 1},
        "IQR": {"density_based": 0, "global_rule": 1},
        "LOF": {"density_based": 1, "global_rule": 0},
        "MAD": {"density_based": 0, "global_rule": 1},
    },
    "feature_extraction": {
        "pca": {"supervised": 0, "projection_based": 1},
        "truncated_svd": {"supervised": 0, "projection_based": 1},
        "cfs": {"supervised": 1, "projection_based": 0},
        "polynomial": {"supervised": 0, "projection_based": 0, "tree_based": 0},
        "interaction": {"supervised": 0, "projection_based": 0, "tree_based": 0},
        "incremental_pca": {"supervised": 0, "projection_based": 1, "tree_based": 0},
        "kernel_pca": {"supervised": 0, "projection_based": 1, "tree_based": 0},
        "random_trees_embedding": {"supervised": 0, "projection_based": 0, "tree_based": 1},
        "pca_arpack": {"supervised": 0, "projection_based": 1, "tree_based": 0},
        "pca_randomized": {"supervised": 0, "projection_based": 1, "tree_based": 0},
    },
    "feature_selection": {
        "LC": {"tree_based": 0, "model_based": 0, "filter_based": 1},
        "VAR": {"tree_based": 0, "model_based": 0, "filter_based": 1},
        "Tree": {"tree_based": 1, "model_based": 1, "filter_based": 0},
        "SVC": {"tree_based": 0, "model_based": 1, "filter_based": 0},
        "MR": {"tree_based": 0, "model_based": 0, "filter_based": 1},
        "WR": {"tree_based": 0, "model_based": 0, "filter_based": 1},
    },
}
# Weight of each method feature in the cost multiplier.
PARAM_WEIGHTS = {
    "encoding_dim_factor": 0.06, "needs_target": 0.03, "iterative": 0.08, "neighbor_based": 0.06,
    "robust_scale": 0.02, "nonlinear_map": 0.03, "density_based": 0.06, "global_rule": 0.02,
    "projection_based": 0.04, "supervised": 0.03, "tree_based": 0.05, "model_based": 0.04,
    "filter_based": 0.01, "approximate": 0.08, "string_similarity": 0.04,
}
# Row and column terms of the cost multiplier, and its floor.
ROW_WEIGHT, ROW_CENTRE, COL_WEIGHT, COL_CENTRE, TERM_LIMIT, MULTIPLIER_FLOOR = 0.08, 4.0, 0.05, 1.5, 2.0, 0.1
# Staff levels (wage per hour, complexity limit, slope, head count, entry cost) and task hours.
STAFF = [("junior", 15.0, 5.0, 1.0, 80.0, 10.0), ("senior", 30.0, 7.0, 0.7, 20.0, 50.0), ("expert", 300.0, None, 0.5, 3.0, 500.0)]
TASK_HOURS = {"manual_labeling": 0.005, "manual_selecting": 0.5}
COMPLEXITY_TOP, EXPERIENCE = 10.0, 1.8
CALIBRATION_CLIP = (0.2, 5.0)
MODES = ("e", "e_dataset", "e_dataset_method")


def method_table(spark: SparkSession) -> DataFrame:
    """(stage, method, param, value) rows."""
    rows = [(s, m, p, float(v)) for s, ms in METHOD_PARAMS.items() for m, ps in ms.items() for p, v in ps.items()]
    return spark.createDataFrame(rows, "stage string, method string, param string, value double")


def method_bonus(stage: str, method: str) -> float:
    params = METHOD_PARAMS.get(stage, {}).get(method, {})
    total = 0.0
    for name, weight in PARAM_WEIGHTS.items():
        value = float(params.get(name, 1 if name == "encoding_dim_factor" else 0))
        total += weight * (max(value - 1.0, 0.0) if name == "encoding_dim_factor" else value)
    return total


def bonus_table(spark: SparkSession) -> DataFrame:
    """(stage, method, bonus): one row per method, for broadcast joins."""
    rows = [(s, m, method_bonus(s, m)) for s, ms in METHOD_PARAMS.items() for m in ms]
    return spark.createDataFrame(rows, "stage string, method string, bonus double")


def runtime_profile(measurements: DataFrame) -> DataFrame:
    """Mean and 90 % quantile of the repeated measurements per degree."""
    keys = ["dataset", "process", "method", "e"]
    means = measurements.groupBy(*keys).agg(F.avg("seconds").alias("mean_seconds"), F.count(F.lit(1)).alias("runs"))
    return means.join(grouped_quantile(measurements, keys, "seconds", 0.9, "q90_seconds"), keys)


def fit_seconds(profile: DataFrame, keys: list[str], seconds: str = "mean_seconds", full: Column | None = None) -> DataFrame:
    """``seconds = k*e + b`` per group; fewer than 3 degrees or a full profile give the mean, b is never negative."""
    fitted = profile.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.avg(seconds).alias("mean"),
        F.covar_pop("e", seconds).alias("cov"),
        F.var_pop("e").alias("var"),
        F.avg("e").alias("e_mean"),
        (F.max(full) if full is not None else F.lit(False)).alias("is_full"),
    )
    line = (F.col("points") >= 3) & ~F.col("is_full") & (F.col("var") > 0)
    slope = F.col("cov") / F.when(F.col("var") > 0, F.col("var"))
    return fitted.select(
        *keys,
        F.when(line, slope).otherwise(F.lit(0.0)).alias("k"),
        F.when(line, F.greatest(F.lit(0.0), F.col("mean") - slope * F.col("e_mean")))
        .otherwise(F.greatest(F.lit(0.0), F.col("mean")))
        .alias("b"),
    )


def stage_seconds(k: Column, b: Column, e: Column) -> Column:
    return F.greatest(F.lit(0.0), b + k * e)


def machine_cost(seconds: Column, fixed: Column, rate: Column) -> Column:
    return fixed + seconds * rate


def size_multiplier(rows: Column, cols: Column) -> Column:
    def term(x: Column, centre: float) -> Column:
        return F.least(F.greatest(F.log10(F.greatest(x.cast("double"), F.lit(1.0))) - centre, F.lit(-TERM_LIMIT)), F.lit(TERM_LIMIT))

    return (F.lit(1.0) + ROW_WEIGHT * term(rows, ROW_CENTRE)) * (F.lit(1.0) + COL_WEIGHT * term(cols, COL_CENTRE))


def cost_multiplier(mode: str, rows: Column, cols: Column, bonus: Column) -> Column:
    if mode not in MODES:
        raise ValueError(f"cost mode must be one of {MODES}")
    if mode == "e":
        return F.lit(1.0)
    value = size_multiplier(rows, cols)
    if mode == "e_dataset_method":
        value = value * (F.lit(1.0) + bonus)
    return F.greatest(F.lit(MULTIPLIER_FLOOR), value)


def calibration_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, value) rows of dataset sizes and names for the calibration product."""
    rows, cols = F.col("dataset_rows").cast("double"), F.col("dataset_cols").cast("double")
    safe = F.greatest(cols, F.lit(1.0))
    # Names of the calibration features.
    pairs = [
        ("intercept", F.lit(1.0)),
        ("log_rows", F.log1p(rows)),
        ("log_cols", F.log1p(cols)),
        ("numeric_ratio", F.col("numeric_cols").cast("double") / safe),
        ("categorical_ratio", F.col("categorical_cols").cast("double") / safe),
        ("log_cat_cardinality_sum", F.log1p(F.col("cat_cardinality_sum").cast("double"))),
        ("log_cat_cardinality_max", F.log1p(F.col("cat_cardinality_max").cast("double"))),
        ("missing_rate", F.col("missing_rate")),
    ]
    named = [F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in pairs]
    named += [
        F.struct(F.concat(F.lit(f"{tag}="), F.col(c)).alias("feature"), F.lit(1.0).alias("value"))
        for tag, c in (("dataset", "dataset"), ("stage", "stage"), ("method", "method"))
    ]
    return df.select(*keys, F.explode(F.array(*named)).alias("f")).select(*keys, "f.*")


def calibration_multiplier(features: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """exp(features . coefficients) clipped; ``coefficients`` is (feature, coefficient), one row per feature."""
    low, high = CALIBRATION_CLIP
    # no hint: names of datasets are features as well, so Spark measures the table and broadcasts a small one
    joined = features.join(coefficients, "feature", "left")
    return joined.groupBy(*keys).agg(
        F.least(F.greatest(F.exp(F.sum(F.col("value") * F.coalesce("coefficient", F.lit(0.0)))), F.lit(low)), F.lit(high)).alias("calibration")
    )


def effective(k: Column, b: Column, multiplier: Column, mode: str = "scaled") -> tuple[Column, Column]:
    if mode == "profiled":
        return k, b
    if mode != "scaled":
        raise ValueError("coefficient mode must be 'scaled' or 'profiled'")
    return k * multiplier, b * multiplier


def plan_seconds(long_plans: DataFrame, coefficients: DataFrame, keys: list[str], on: list[str], overhead: float = 0.0) -> DataFrame:
    """Total predicted seconds per plan. ``long_plans`` has stage, method, e; ``coefficients`` has k, b.

    A plan with a stage that has no cost line keeps its count of stages and has a NULL cost: it is not priced.
    """
    priced = long_plans.join(coefficients, on, "left")
    seconds = stage_seconds(F.col("k"), F.col("b"), F.col("e"))
    whole = F.count(F.when(F.col("k").isNotNull() & F.col("b").isNotNull(), 1)) == F.count(F.lit(1))
    return priced.groupBy(*keys).agg(
        F.when(whole, F.sum(seconds) + F.lit(overhead)).alias("cost"),
        F.count(F.lit(1)).alias("stages"),
    )


def human_task(d: Column, d_max: Column, n: Column, n_max: Column, mu: Column, e: Column, people: Column, task: Column) -> dict[str, Column]:
    """Complexity, staff level, hours and money of a manual task."""
    complexity = 10 * (0.3 * d / d_max + 0.1 * F.log(n) / F.log(n_max) + 0.6 * mu)
    level, wage, slope, heads, entry = (F.lit(STAFF[-1][i]) for i in (0, 1, 3, 4, 5))
    for name, w, limit, a, h, c in reversed(STAFF[:-1]):
        below = complexity < limit
        level, wage, slope, heads, entry = (
            F.when(below, F.lit(new)).otherwise(old)
            for new, old in zip((name, w, a, h, c), (level, wage, slope, heads, entry))
        )
    hours = F.lit(None).cast("double")
    for name, value in TASK_HOURS.items():
        hours = F.when(task == name, F.lit(value)).otherwise(hours)
    work = hours * (1 + slope * F.pow(complexity / COMPLEXITY_TOP, F.lit(EXPERIENCE))) / (1 + slope)
    return {
        "complexity": complexity,
        "level": level,
        "hours": work * e * n / people,
        "money": work * wage + heads * entry,
    }
