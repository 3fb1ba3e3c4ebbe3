"""Profiles, measurements and cost models. Measurements and plans are derived from lineitem and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.plans.benefit import feature_columns, mean_squared_error, pool, stage_param_names, train_benefit
from tamis.plans.cost import (
    METHOD_PARAMS,
    STAFF,
    TASK_HOURS,
    bonus_table,
    calibration_features,
    calibration_multiplier,
    cost_multiplier,
    fit_seconds,
    human_task,
    machine_cost,
    method_bonus,
    plan_seconds,
    runtime_profile,
)
from tamis.plans.profile import dataset_meta, dataset_params
from tamis.plans.space import LEGACY, long_plan, method_options
from tamis.queries.registry import query, read, rounded, seeded_sql
from tamis.queries.tables import order_plans, plan_columns_sql
from tamis.sources.records import coefficients_as_of, profile_lookup, with_record_defaults
from tamis.sources.tables import keyed

PAIRS = [(s, m) for s, ms in method_options("sota").items() for m in ms]
DATASETS = ["AF", "AO", "NF", "NO", "RF", "RO"]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def measurements(spark, sf) -> DataFrame:
    """One timing per order line: the line says which dataset, stage, method, degree and run it is of."""
    at = f"cast(l_partkey % {len(PAIRS)} AS int)"
    return read(spark, sf, "lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) AS dataset",
        f"element_at({_array(s for s, _ in PAIRS)}, {at} + 1) AS process",
        f"element_at({_array(m for _, m in PAIRS)}, {at} + 1) AS method",
        "(1 + l_suppkey % 10) / 10.0D AS e",
        "l_linenumber AS run",
        f"(1 + {at}) / 100.0D * (1 + l_suppkey % 10) / 10.0D + sqrt(l_quantity) / 100 AS seconds",
    )


_AT = f"cast(l_partkey % {len(PAIRS)} AS INT)"
MEASURED = (
    f"SELECT l_returnflag || l_linestatus AS dataset, {_list(s for s, _ in PAIRS)}[{_AT} + 1] AS process, {_list(m for _, m in PAIRS)}[{_AT} + 1] AS method, "
    f"(1 + l_suppkey % 10) / 10.0::DOUBLE AS e, l_linenumber AS run, (1 + {_AT}) / 100.0::DOUBLE * (1 + l_suppkey % 10) / 10.0::DOUBLE + sqrt(l_quantity) / 100 AS seconds FROM lineitem"
)
KEYS = ["dataset", "process", "method"]


@query(
    "runtime_profile",
    f"WITH m AS ({MEASURED}) SELECT dataset, process, method, e, round(avg(seconds), 8) AS mean_seconds, count(*) AS runs, round(quantile_cont(seconds, 0.9), 8) AS q90_seconds FROM m GROUP BY ALL",
)
def runtime_profile_query(spark, sf):
    return rounded(runtime_profile(measurements(spark, sf)), 8)


def _fit_sql(seconds: str, digits: int = 6) -> str:
    return (
        f"WITH m AS ({MEASURED}), p AS (SELECT dataset, process, method, e, {seconds} AS s FROM m GROUP BY ALL), "
        "f AS (SELECT dataset, process, method, count(*) AS n, avg(s) AS a, regr_slope(s, e) AS k, regr_intercept(s, e) AS b FROM p GROUP BY ALL) "
        f"SELECT dataset, process, method, round(CASE WHEN n >= 3 THEN k ELSE 0.0 END, {digits}) AS k, round(CASE WHEN n >= 3 THEN greatest(0, b) ELSE greatest(0, a) END, {digits}) AS b FROM f"
    )


def coefficients(spark, sf, seconds: str = "mean_seconds") -> DataFrame:
    """Cost lines per dataset, stage and method; 6 x 46 rows at most."""
    return fit_seconds(runtime_profile(measurements(spark, sf)), KEYS, seconds)


@query("runtime_fit", _fit_sql("avg(seconds)"))
def runtime_fit(spark, sf):
    return rounded(coefficients(spark, sf), 6)


@query("runtime_coeff_q90", _fit_sql("quantile_cont(seconds, 0.9)"))
def runtime_coeff_q90(spark, sf):
    return rounded(coefficients(spark, sf, "q90_seconds"), 6)


@query(
    "profile_lookup",
    f"""WITH m AS ({MEASURED}), w AS (SELECT DISTINCT dataset, process, method, 'e' AS cost_param FROM m),
    p AS (SELECT dataset, process, method, 'e' AS cost_param, avg(seconds) AS seconds FROM m WHERE dataset LIKE 'A%' GROUP BY ALL
      UNION ALL SELECT dataset, process, method, NULL, avg(seconds) FROM m WHERE dataset LIKE 'N%' GROUP BY ALL
      UNION ALL SELECT NULL, process, method, 'e', avg(seconds) FROM m WHERE process <> 'imputation' GROUP BY ALL
      UNION ALL SELECT NULL, process, method, NULL, avg(seconds) FROM m GROUP BY ALL),
    j AS (SELECT w.*, p.seconds, CASE WHEN p.dataset = w.dataset AND p.cost_param = w.cost_param THEN 1 WHEN p.dataset = w.dataset AND p.cost_param IS NULL THEN 2
      WHEN p.dataset IS NULL AND p.cost_param = w.cost_param THEN 3 WHEN p.dataset IS NULL AND p.cost_param IS NULL THEN 4 END AS specificity
      FROM w JOIN p ON w.process = p.process AND w.method = p.method)
    SELECT dataset, process, method, cost_param, cast(min(specificity) AS INT) AS specificity, round(arg_min(seconds, specificity), 8) AS seconds
    FROM j WHERE specificity IS NOT NULL GROUP BY ALL""",
)
def profile_lookup_query(spark, sf):
    m = measurements(spark, sf)
    mean = F.avg("seconds").alias("seconds")
    none = F.lit(None).cast("string")

    def level(rows, dataset, cost):
        keys = ["process", "method", *(["dataset"] if dataset is None else [])]
        out = rows.groupBy(*keys).agg(mean)
        return out.select((F.col("dataset") if dataset is None else none).alias("dataset"), "process", "method", (F.lit("e") if cost else none).alias("cost_param"), "seconds")

    profiles = (
        level(m.where("dataset LIKE 'A%'"), None, True)
        .unionByName(level(m.where("dataset LIKE 'N%'"), None, False))
        .unionByName(level(m.where("process <> 'imputation'"), "any", True))
        .unionByName(level(m, "any", False))
    )
    wanted = m.select("dataset", "process", "method").distinct().withColumn("cost_param", F.lit("e"))
    return rounded(profile_lookup(wanted, profiles), 8)


# --- plans ----------------------------------------------------------------------------------------

STAGES = list(LEGACY)


def priced_plans(spark, sf) -> DataFrame:
    """A plan per order, priced with the lines of the dataset its customer points to."""
    plans = order_plans(spark, sf).withColumn("dataset", F.expr(f"element_at({_array(DATASETS)}, cast(o_custkey % 6 AS int) + 1)"))
    rows = long_plan(plans, ["o_orderkey", "dataset"], STAGES)
    # a row per dataset and method, which grows with the datasets: Spark measures it and broadcasts it while it is small
    lines = coefficients(spark, sf).withColumnRenamed("process", "stage")
    return plan_seconds(rows, lines, ["o_orderkey", "dataset"], ["dataset", "stage", "method"])


COEFFS = "c AS (" + _fit_sql("avg(seconds)", 15).replace("WITH ", "WITH ", 1) + ")"
PLANS = f"p AS (SELECT o_orderkey, {_list(DATASETS)}[cast(o_custkey % 6 AS INT) + 1] AS dataset, {plan_columns_sql('o_orderkey')} FROM orders)"
LONG = "l AS (" + " UNION ALL ".join(f"SELECT o_orderkey, dataset, '{s}' AS stage, m_{s} AS method, e_{s} AS e FROM p" for s in STAGES) + ")"
PRICED = (
    f"{PLANS}, {LONG}, {COEFFS}, pc AS (SELECT o_orderkey, l.dataset, sum(greatest(0, b + k * e)) AS cost, count(*) AS stages "
    "FROM l JOIN c ON l.dataset = c.dataset AND l.stage = c.process AND l.method = c.method GROUP BY ALL)"
)


@query("plan_cost", f"WITH {PRICED} SELECT o_orderkey, dataset, round(cost, 6) AS cost, stages FROM pc")
def plan_cost(spark, sf):
    return rounded(priced_plans(spark, sf), 6)


@query("machine_cost", f"WITH {PRICED} SELECT o_orderkey, round(100 + cost * 0.5, 6) AS money FROM pc")
def machine_cost_query(spark, sf):
    return rounded(priced_plans(spark, sf).select("o_orderkey", machine_cost(F.col("cost"), F.lit(100.0), F.lit(0.5)).alias("money")), 6)


def dataset_sizes(spark, sf) -> DataFrame:
    """Sizes of the six line groups as datasets."""
    return read(spark, sf, "lineitem").groupBy(F.expr("concat(l_returnflag, l_linestatus)").alias("dataset")).agg(
        F.count(F.lit(1)).alias("dataset_rows"),
        F.lit(9).cast("long").alias("dataset_cols"),
        F.lit(8).cast("long").alias("numeric_cols"),
        F.lit(1).cast("long").alias("categorical_cols"),
        F.approx_count_distinct("l_linenumber", 0.01).alias("cat_cardinality_sum"),
        F.approx_count_distinct("l_linenumber", 0.01).alias("cat_cardinality_max"),
        F.avg(F.expr("cast(l_discount = 0 AS double)")).alias("missing_rate"),
    )


SIZES = (
    "z AS (SELECT l_returnflag || l_linestatus AS dataset, count(*) AS dataset_rows, 9 AS dataset_cols, 8 AS numeric_cols, 1 AS categorical_cols, "
    "count(DISTINCT l_linenumber) AS card, avg((l_discount = 0)::INT) AS missing_rate FROM lineitem GROUP BY 1)"
)
BONUS = "bo(stage, method, bonus) AS (VALUES " + ", ".join(f"('{s}', '{m}', {method_bonus(s, m)!r}::DOUBLE)" for s, ms in METHOD_PARAMS.items() for m in ms) + ")"


@query(
    "cost_multiplier",
    f"""WITH {SIZES}, {BONUS}, u AS (SELECT DISTINCT dataset, process AS stage, method FROM ({MEASURED}))
    SELECT dataset, stage, method, round(greatest(0.1, (1 + 0.08 * least(greatest(log10(greatest(dataset_rows, 1)) - 4, -2), 2))
      * (1 + 0.05 * least(greatest(log10(greatest(dataset_cols, 1)) - 1.5, -2), 2)) * (1 + bonus)), 8) AS multiplier
    FROM u JOIN z USING (dataset) JOIN bo USING (stage, method)""",
)
def cost_multiplier_query(spark, sf):
    used = measurements(spark, sf).select("dataset", F.col("process").alias("stage"), "method").distinct()
    sized = used.join(dataset_sizes(spark, sf), "dataset").join(F.broadcast(bonus_table(spark)), ["stage", "method"])
    value = cost_multiplier("e_dataset_method", F.col("dataset_rows"), F.col("dataset_cols"), F.col("bonus"))
    return rounded(sized.select("dataset", "stage", "method", value.alias("multiplier")), 8)


WEIGHTS = [("intercept", 0.1), ("log_rows", 0.02), ("numeric_ratio", -0.3), ("missing_rate", 0.5), ("log_cat_cardinality_max", 0.05), ("stage=imputation", 0.4), ("method=KNN", 0.9), ("dataset=AF", -0.2)]


@query(
    "cost_calibrated",
    f"""WITH {SIZES}, u AS (SELECT DISTINCT dataset, process AS stage, method FROM ({MEASURED}))
    SELECT dataset, stage, method, round(least(greatest(exp(0.1 + 0.02 * ln(1 + dataset_rows) - 0.3 * numeric_cols / dataset_cols + 0.5 * missing_rate + 0.05 * ln(1 + card)
      + 0.4 * (stage = 'imputation')::INT + 0.9 * (method = 'KNN')::INT - 0.2 * (dataset = 'AF')::INT), 0.2), 5.0), 8) AS calibration
    FROM u JOIN z USING (dataset)""",
)
def cost_calibrated(spark, sf):
    keys = ["dataset", "stage", "method"]
    used = measurements(spark, sf).select("dataset", F.col("process").alias("stage"), "method").distinct()
    sized = used.join(dataset_sizes(spark, sf), "dataset")
    weights = spark.createDataFrame(WEIGHTS, "feature string, coefficient double")
    return rounded(calibration_multiplier(calibration_features(sized, keys), weights, keys), 8)


_STAFF_SQL = "(VALUES " + ", ".join(f"('{n}', {w}, {lim if lim is not None else 'NULL'}, {a}, {h}, {c})" for n, w, lim, a, h, c in STAFF) + ") s(level, wage, lim, slope, heads, entry)"


@query(
    "human_cost",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'manual_selecting' ELSE 'manual_labeling' END AS task, 1.0 + o_custkey % 60 AS d, 60.0 AS d_max,
      o_totalprice AS n, 1000000.0::DOUBLE AS n_max, (o_orderkey % 100) / 100.0::DOUBLE AS mu, 0.1 * (1 + o_orderkey % 10) AS e, 1.0 + o_custkey % 5 AS people FROM orders),
    c AS (SELECT *, 10 * (0.3 * d / d_max + 0.1 * ln(n) / ln(n_max) + 0.6 * mu) AS x, CASE task WHEN 'manual_labeling' THEN {TASK_HOURS['manual_labeling']} ELSE {TASK_HOURS['manual_selecting']} END AS base FROM t),
    l AS (SELECT *, CASE WHEN x < 5 THEN 'junior' WHEN x < 7 THEN 'senior' ELSE 'expert' END AS lv FROM c),
    w AS (SELECT *, base * (1 + slope * pow(x / 10.0, 1.8)) / (1 + slope) AS work FROM l JOIN {_STAFF_SQL} ON lv = level)
    SELECT o_orderkey, round(x, 8) AS complexity, lv AS level, round(work * e * n / people, 6) AS hours, round(work * wage + heads * entry, 6) AS money FROM w""",
)
def human_cost(spark, sf):
    o = read(spark, sf, "orders")
    parts = human_task(
        F.expr("1.0D + o_custkey % 60"), F.lit(60.0), F.col("o_totalprice"), F.lit(1000000.0), F.expr("(o_orderkey % 100) / 100.0D"),
        F.expr("0.1D * (1 + o_orderkey % 10)"), F.expr("1.0D + o_custkey % 5"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 'manual_selecting' ELSE 'manual_labeling' END"),
    )
    return rounded(o.select("o_orderkey", *[v.alias(k) for k, v in parts.items()]), {"complexity": 8})


# --- versions of cost lines -----------------------------------------------------------------------

# version 1 knows the first three runs and no imputation, version 3 all of it; there is no version 2
_VERSIONS = {1: "run <= 3 AND process <> 'imputation'", 3: "true"}
_STATISTICS = {"mean": "avg(seconds)", "q90": "quantile_cont(seconds, 0.9)"}


def _versions_sql() -> str:
    parts = []
    for version, where in _VERSIONS.items():
        for name, seconds in _STATISTICS.items():
            fit = _fit_sql(seconds, 15).replace(f"({MEASURED})", f"(SELECT * FROM ({MEASURED}) WHERE {where})")
            parts.append(f"SELECT {version} AS version, '{name}' AS statistic, * FROM ({fit})")
    return " UNION ALL ".join(parts)


@query(
    "coeff_as_of",
    f"""WITH cv AS MATERIALIZED ({_versions_sql()}),
    w AS (SELECT o_orderkey, {_list(DATASETS)}[cast(o_custkey % 6 AS INT) + 1] AS dataset, {_list(s for s, _ in PAIRS)}[cast(o_orderkey % {len(PAIRS)} AS INT) + 1] AS process,
      {_list(m for _, m in PAIRS)}[cast(o_orderkey % {len(PAIRS)} AS INT) + 1] AS method, cast(o_orderkey % 5 AS INT) AS version, CASE WHEN o_custkey % 2 = 0 THEN 'mean' ELSE 'q90' END AS statistic FROM orders)
    SELECT o_orderkey, w.dataset, w.process, w.method, w.version, w.statistic, cv.version AS used_version, round(k, 6) AS k, round(b, 6) AS b
    FROM w LEFT JOIN cv ON cv.dataset = w.dataset AND cv.process = w.process AND cv.method = w.method AND cv.statistic = w.statistic AND cv.version <= w.version
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY cv.version DESC NULLS LAST) = 1""",
)
def coeff_as_of(spark, sf):
    """The cost line that held when an order was priced, by mean or by 90 % quantile."""
    versions = None
    for version, where in _VERSIONS.items():
        profile = runtime_profile(measurements(spark, sf).where(where))
        for name in _STATISTICS:
            part = fit_seconds(profile, KEYS, f"{name}_seconds").withColumns({"statistic": F.lit(name), "version": F.lit(version)})
            versions = part if versions is None else versions.unionByName(part)
    at = f"cast(o_orderkey % {len(PAIRS)} AS int) + 1"
    wanted = read(spark, sf, "orders").selectExpr(
        "o_orderkey", f"element_at({_array(DATASETS)}, cast(o_custkey % 6 AS int) + 1) AS dataset", f"element_at({_array(s for s, _ in PAIRS)}, {at}) AS process",
        f"element_at({_array(m for _, m in PAIRS)}, {at}) AS method", "cast(o_orderkey % 5 AS int) AS version", "CASE WHEN o_custkey % 2 = 0 THEN 'mean' ELSE 'q90' END AS statistic",
    )
    return rounded(coefficients_as_of(wanted, versions), 6)


# --- dataset profiles -----------------------------------------------------------------------------

_PARAMS = """p AS (SELECT count(*) AS dataset_rows, cast(5 AS BIGINT) AS dataset_cols, cast(3 AS BIGINT) AS numeric_cols, cast(2 AS BIGINT) AS categorical_cols,
    cast(count(DISTINCT o_orderstatus) + count(DISTINCT o_clerk) AS BIGINT) AS cat_cardinality_sum, greatest(count(DISTINCT o_orderstatus), count(DISTINCT o_clerk)) AS cat_cardinality_max,
    avg((price IS NULL)::INT) / 5 AS missing_rate FROM (SELECT *, cast(o_custkey AS VARCHAR) AS o_clerk, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders))"""


def _profiled(spark, sf):
    raw = keyed(read(spark, sf, "orders"), ["o_orderkey"])
    return raw.selectExpr(
        "row_id", "row_hash", "split", "o_custkey", "o_orderstatus", "o_orderpriority", "o_custkey % 7 AS g", "cast(o_custkey AS string) AS o_clerk",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price",
    )


@query("dataset_params", f"WITH {_PARAMS} SELECT dataset_rows, dataset_cols, numeric_cols, categorical_cols, cat_cardinality_sum, cat_cardinality_max, round(missing_rate, 8) AS missing_rate FROM p")
def dataset_params_query(spark, sf):
    return rounded(dataset_params(_profiled(spark, sf), "o_orderpriority"), 8)


@query(
    "dataset_meta",
    f"""WITH {_PARAMS}, c AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority), t AS (SELECT count(*) AS k, sum(n) AS s, max(n) AS hi, min(n) AS lo,
      -sum(n / (SELECT count(*) FROM orders) * ln(n / (SELECT count(*) FROM orders))) AS h FROM c)
    SELECT round(ln(1 + dataset_rows), 8) AS log_rows, round(ln(6), 8) AS log_cols, round(ln(4), 8) AS log_numeric_cols, round(ln(3), 8) AS log_categorical_cols,
    0.6::DOUBLE AS numeric_ratio, 0.4::DOUBLE AS categorical_ratio, round(ln(1 + cat_cardinality_sum), 8) AS log_cat_cardinality_sum, round(ln(1 + cat_cardinality_max), 8) AS log_cat_cardinality_max,
    round(missing_rate, 8) AS missing_rate, round(ln(1 + dataset_rows / 5), 8) AS log_rows_per_col, round(ln(1 + k), 8) AS log_class_count,
    round(h / ln(greatest(k, 2)), 8) AS class_entropy, round(hi / s, 8) AS majority_class_ratio, round(lo / s, 8) AS minority_class_ratio FROM p, t""",
)
def dataset_meta_query(spark, sf):
    return rounded(dataset_meta(_profiled(spark, sf), "o_orderpriority"), 8)


# --- benefit records ------------------------------------------------------------------------------


def records(spark, sf) -> DataFrame:
    """One scored plan per order; accuracy follows the plan and the order, a few are missing."""
    plans = order_plans(spark, sf)
    accuracy = F.expr(
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 0.3D + 0.2D * sqrt(e_imputation) + 0.15D * sqrt(e_feature_selection) "
        "+ CASE WHEN m_outlier_detection = 'ZSB' THEN 0.1D * e_outlier_detection ELSE 0 END + o_totalprice % 100 / 1000 END"
    )
    return plans.select(
        "*",
        accuracy.alias("accuracy"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END").alias("dataset"),
        F.expr(f"element_at({_array(['LDA', 'NB', 'LR', 'RF', 'SVM'])}, cast(o_custkey % 5 AS int) + 1)").alias("model"),
        F.lit(None).cast("string").alias("cost_param"),
    )


@query(
    "benefit_records",
    f"""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END, 'google') AS dataset, {_list(['LDA', 'NB', 'LR', 'RF', 'SVM'])}[cast(o_custkey % 5 AS INT) + 1] AS model, 'e' AS cost_param FROM orders""",
)
def benefit_records_query(spark, sf):
    return with_record_defaults(records(spark, sf).select("o_orderkey", "dataset", "model", "cost_param"))


def _features_sql() -> str:
    out = []
    for stage, methods in LEGACY.items():
        out += [f"CASE WHEN m_{stage} = '{m}' THEN e_{stage} ELSE 0.0 END AS \"x_{m}\"" for m in methods]
    for stage, methods in LEGACY.items():
        for p in stage_param_names(stage, methods):
            whens = " ".join(f"WHEN '{m}' THEN {float(METHOD_PARAMS[stage][m].get(p, 0))}::DOUBLE" for m in methods)
            out.append(f"CASE m_{stage} {whens} END AS p_{stage}_{p}")
    return ", ".join(out)


@query("benefit_features", f"WITH p AS (SELECT o_orderkey, {plan_columns_sql('o_orderkey')} FROM orders) SELECT o_orderkey, {_features_sql()} FROM p")
def benefit_features(spark, sf):
    return order_plans(spark, sf).select("o_orderkey", *feature_columns("legacy", method_params=True))


_ACCURACY = (
    "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 0.3::DOUBLE + 0.2::DOUBLE * sqrt(e_imputation) + 0.15::DOUBLE * sqrt(e_feature_selection) "
    "+ CASE WHEN m_outlier_detection = 'ZSB' THEN 0.1::DOUBLE * e_outlier_detection ELSE 0 END + o_totalprice % 100 / 1000 END"
)
_RECORDS = f"r AS (SELECT *, {_ACCURACY} AS accuracy FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, {plan_columns_sql('o_orderkey')} FROM orders))"


@query(
    "benefit_pool",
    f"""WITH {_RECORDS}, z AS (SELECT o_orderpriority AS dataset, ln(1 + count(*)) AS log_rows FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
    SELECT o_orderkey, z.dataset, round(accuracy, 8) AS accuracy, round(log_rows, 8) AS log_rows FROM r JOIN z ON CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END = z.dataset""",
)
def benefit_pool(spark, sf):
    sizes = read(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("log_rows"))
    pooled = pool(records(spark, sf), sizes)
    return rounded(pooled.select("o_orderkey", "dataset", "accuracy", "log_rows"), 8)


@query(
    "benefit_mse",
    f"WITH {_RECORDS} SELECT round(avg(pow(accuracy - least(greatest(0.3 + 0.4 * sqrt(e_imputation), 0), 1), 2)), 8) AS mse, count(*) AS n FROM r WHERE accuracy IS NOT NULL",
)
def benefit_mse(spark, sf):
    predicted = F.lit(0.3) + 0.4 * F.sqrt("e_imputation")
    return rounded(mean_squared_error(records(spark, sf), F.col("accuracy"), predicted), 8)


# --- a small accuracy model that SQL fits as well -------------------------------------------------

_SLOTS = [(s, m) for s, ms in LEGACY.items() for m in ms]
MODEL_CUTS = [0.0, 0.25, 0.5, 0.75]
MODEL_ROUNDS = 4
MODEL_RATE = 0.5


def slots_sql(method: str = "m_{}", degree: str = "e_{}") -> str:
    """The feature vector of a plan: a slot per method with its degree."""
    return "[" + ", ".join(f"CASE WHEN {method.format(s)} = '{m}' THEN {degree.format(s)} ELSE 0.0::DOUBLE END" for s, m in _SLOTS) + "]"


def _level_sql(t: int, level: int) -> str:
    """The best cut of every node: sums beyond each cut, gains rounded, the first of equal ones."""
    rows = f"SELECT k{level} AS n, y - p AS r, xs FROM a{t}_{level} WHERE fits"
    gain = "0.5::DOUBLE * ((g - gr) * (g - gr) / (h - hr + 1) + gr * gr / (hr + 1) - g * g / (h + 1))"
    return f"""s{t}_{level} AS MATERIALIZED (SELECT n, f, c, sum(r) FILTER (xs[f] > c) AS gr, count(*) FILTER (xs[f] > c) AS hr, sum(r) AS g, count(*) AS h
      FROM ({rows}), (SELECT unnest(range(1, {len(_SLOTS) + 1})) AS f), (SELECT unnest({MODEL_CUTS})::DOUBLE AS c) GROUP BY n, f, c),
    b{t}_{level} AS MATERIALIZED (SELECT n, f, c FROM (SELECT n, f, c, row_number() OVER (PARTITION BY n ORDER BY round({gain}, 9) DESC, f, c) AS o, round({gain}, 9) AS gain
      FROM s{t}_{level} WHERE hr > 0 AND hr < h) WHERE o = 1 AND gain > 0),
    a{t}_{level + 1} AS MATERIALIZED (SELECT a.*, 2 * k{level} + CASE WHEN xs[b.f] > b.c THEN 2 ELSE 1 END AS k{level + 1} FROM a{t}_{level} a LEFT JOIN b{t}_{level} b ON b.n = k{level})"""


def model_sql() -> str:
    """CTEs: records ``r``, and per round t the cuts ``b{{t}}_0``, ``b{{t}}_1`` and the leaves ``v{{t}}``; ``base``: the mean."""
    steps = [
        _RECORDS,
        f"q AS (SELECT o_orderkey, accuracy AS y, {slots_sql()} AS xs, accuracy IS NOT NULL AND NOT ({seeded_sql("'42'", "'benefit'", 'o_orderkey')} < 0.2) AS fits FROM r)",
        "base AS MATERIALIZED (SELECT avg(y) AS base FROM q WHERE fits)",
        "p0 AS MATERIALIZED (SELECT q.*, base AS p FROM q, base)",
    ]
    for t in range(MODEL_ROUNDS):
        steps.append(f"a{t}_0 AS MATERIALIZED (SELECT *, 0 AS k0 FROM p{t})")
        steps += [_level_sql(t, 0), _level_sql(t, 1)]
        steps.append(f"v{t} AS MATERIALIZED (SELECT k2 AS n, {MODEL_RATE}::DOUBLE * sum(y - p) / (count(*) + 1) AS v FROM a{t}_2 WHERE fits GROUP BY k2)")
        steps.append(f"p{t + 1} AS MATERIALIZED (SELECT a.o_orderkey, y, xs, fits, p + coalesce(v, 0) AS p FROM a{t}_2 a LEFT JOIN v{t} v ON v.n = k2)")
    return ", ".join(steps)


def small_model(spark, sf):
    """The accuracy model of ``model_sql``."""
    return train_benefit(records(spark, sf), ["o_orderkey"], trees=MODEL_ROUNDS, depth=2, rate=MODEL_RATE, cuts=MODEL_CUTS)


@query(
    "benefit_trees",
    f"WITH {model_sql()} SELECT o_orderkey, round(y, 6) AS accuracy, round(least(greatest(p, 0), 1), 6) AS u FROM p{MODEL_ROUNDS}",
)
def benefit_trees(spark, sf):
    """The accuracy model fitted on the records of four fifths of the orders scores every plan."""
    scored = records(spark, sf)
    return rounded(small_model(spark, sf).score(scored).select("o_orderkey", "accuracy", "u"), 6)


@query("benefit_predict")
def benefit_predict(spark, sf):
    """Boosted trees trained on the records score every plan."""
    scored = records(spark, sf)
    model = train_benefit(scored, ["o_orderkey"])
    return rounded(model.score(scored).select("o_orderkey", "accuracy", "u"), 6)


