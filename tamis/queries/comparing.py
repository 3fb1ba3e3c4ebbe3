"""Planner comparison and the end-to-end preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.keys import threshold
from tamis.plans.compare import average_by_planner, best_by_case, repeat_summary, rerank, result_record, win_counts
from tamis.plans.run import prepare
from tamis.queries.registry import LINE_KEY_SQL, hex_sql, lines, query, read, rounded
from tamis.sources.records import failure_counts, pending_cases

PLANNERS = ["frank_wolfe", "greedy", "random", "uniform"]


def results(spark, sf):
    """One validated plan per order line."""
    return read(spark, sf, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 100 + 0.5)) AS run_id",
        "concat(l_returnflag, l_linestatus) AS dataset",
        "element_at(array(0.3D, 0.5D, 0.7D, 1.0D), cast(l_suppkey % 4 AS int) + 1) AS budget",
        f"element_at(array({', '.join(repr(p) for p in PLANNERS)}), cast(l_partkey % 4 AS int) + 1) AS method",
        "CASE WHEN l_tax = 0 THEN NULL ELSE 0.5D + l_discount * 3 + l_extendedprice / 1000000 END AS actual_acc",
        "ln(1 + l_quantity) / 5 AS actual_time",
        "0.6D AS base_acc",
    ).selectExpr(
        "*",
        "actual_time / budget AS budget_utilization",
        "(actual_acc - base_acc) / actual_time AS gain_per_cost",
    )


RESULTS = f"""r0 AS (SELECT {LINE_KEY_SQL} AS run_id, l_returnflag || l_linestatus AS dataset, [0.3, 0.5, 0.7, 1.0][cast(l_suppkey % 4 AS INT) + 1]::DOUBLE AS budget,
    {PLANNERS}[cast(l_partkey % 4 AS INT) + 1] AS method, CASE WHEN l_tax = 0 THEN NULL ELSE 0.5::DOUBLE + l_discount * 3 + l_extendedprice / 1000000 END AS actual_acc,
    ln(1 + l_quantity) / 5 AS actual_time, 0.6::DOUBLE AS base_acc FROM lineitem),
    r AS (SELECT *, actual_time / budget AS budget_utilization, (actual_acc - base_acc) / actual_time AS gain_per_cost FROM r0)"""


@query(
    "summary_avg",
    f"WITH {RESULTS} SELECT method, round(avg(actual_acc), 6) AS actual_acc, round(avg(actual_time), 6) AS actual_time, round(avg(budget_utilization), 6) AS budget_utilization, round(avg(gain_per_cost), 6) AS gain_per_cost FROM r GROUP BY method",
)
def summary_avg(spark, sf):
    return rounded(average_by_planner(results(spark, sf)), 6)


_BEST = f"""WITH {RESULTS}, b AS (SELECT dataset, budget, method AS best_method, actual_acc AS best_acc, actual_time, budget_utilization, gain_per_cost FROM
    (SELECT *, row_number() OVER (PARTITION BY dataset, budget ORDER BY actual_acc DESC, run_id) AS n FROM r WHERE actual_acc IS NOT NULL) WHERE n = 1)"""


@query(
    "summary_best",
    _BEST + " SELECT dataset, budget, best_method, round(best_acc, 8) AS best_acc, round(actual_time, 8) AS actual_time, round(budget_utilization, 8) AS budget_utilization, round(gain_per_cost, 8) AS gain_per_cost FROM b",
)
def summary_best(spark, sf):
    return rounded(best_by_case(results(spark, sf), ["run_id"]), 8, ["budget"])


@query("summary_wins", _BEST + ", p AS (SELECT DISTINCT method FROM r) SELECT method, (SELECT count(*) FROM b WHERE best_method = method) AS wins FROM p")
def summary_wins(spark, sf):
    all_results = results(spark, sf)
    return win_counts(best_by_case(all_results, ["run_id"]), all_results.select("method").distinct())


@query(
    "repeat_median",
    """WITH a AS (SELECT l_orderkey AS plan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS run,
      0.5::DOUBLE + l_discount AS acc, 0.4::DOUBLE + l_tax AS f1, ln(1 + l_quantity) + l_extendedprice / 1000000 AS t FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY t, run) AS pos, count(*) OVER (PARTITION BY plan_id) AS n FROM a)
    SELECT plan_id, round(median(acc), 6) AS actual_acc, round(median(f1), 6) AS actual_f1, round(median(t), 6) AS actual_time, round(stddev_pop(acc), 6) AS actual_acc_std,
    round(stddev_pop(t), 6) AS actual_time_std, max(CASE WHEN pos = n // 2 + 1 THEN run END) AS median_run FROM b GROUP BY plan_id""",
)
def repeat_median(spark, sf):
    """The lines of an order are the repeats of its plan."""
    runs = read(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS plan_id",
        "cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS bigint) AS run",
        "0.5D + l_discount AS actual_acc",
        "0.4D + l_tax AS actual_f1",
        "ln(1 + l_quantity) + l_extendedprice / 1000000 AS actual_time",
    )
    return rounded(repeat_summary(runs, ["plan_id"]), 6)


@query(
    "result_record",
    f"""WITH {RESULTS} SELECT run_id, dataset, method, budget, round(actual_acc - base_acc, 8) AS gain, round((actual_acc - base_acc) / actual_time, 8) AS gain_per_cost,
    round(actual_time / budget, 8) AS budget_utilization, 'feature_selection=VAR;imputation=' || CASE WHEN dataset LIKE 'A%' THEN 'MEAN' ELSE 'KNN' END AS methods_text,
    'feature_selection=0.5000;imputation=' || CASE WHEN budget > 0.6 THEN '1.0000' ELSE '0.2500' END AS degrees_text FROM r""",
)
def result_record_query(spark, sf):
    plans = results(spark, sf).select(
        "run_id", "dataset", "method", "budget", "actual_acc", "base_acc", "actual_time",
        F.expr("map('imputation', CASE WHEN dataset LIKE 'A%' THEN 'MEAN' ELSE 'KNN' END, 'feature_selection', 'VAR')").alias("methods"),
        F.expr("map('imputation', CASE WHEN budget > 0.6 THEN 1.0D ELSE 0.25D END, 'feature_selection', 0.5D)").alias("degrees"),
    )
    done = result_record(plans).select("run_id", "dataset", "method", "budget", "gain", "gain_per_cost", "budget_utilization", "methods_text", "degrees_text")
    return rounded(done, 8, ["budget"])


@query(
    "rerank",
    """WITH c AS (SELECT o_custkey, o_orderkey AS restart, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS acc, o_totalprice / 400000 + (o_orderkey % 7) / 10.0::DOUBLE AS t,
      o_totalprice / 500000 AS pt, 0.8::DOUBLE AS budget FROM orders),
    d AS (SELECT *, CASE WHEN acc IS NOT NULL AND t <= budget * 0.95 THEN 0 WHEN acc IS NOT NULL AND t <= budget THEN 1 ELSE 2 END AS tier FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, CASE WHEN tier < 2 THEN acc END DESC, CASE WHEN tier < 2 THEN t ELSE pt END, restart) AS r FROM d)
    SELECT o_custkey, restart, acc AS selection_acc, t AS selection_time, tier, tier < 2 AS feasible FROM k WHERE r = 1""",
)
def rerank_query(spark, sf):
    """A customer's orders as the restarts of one search."""
    candidates = read(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderkey AS restart", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS selection_acc",
        "o_totalprice / 400000 + (o_orderkey % 7) / 10.0D AS selection_time", "o_totalprice / 500000 AS pred_time", "0.8D AS budget",
    )
    return rerank(candidates, ["o_custkey"]).select("o_custkey", "restart", "selection_acc", "selection_time", "tier", "feasible")


@query(
    "pending_cases",
    """WITH d AS (SELECT DISTINCT o_custkey AS dataset FROM orders), c AS (SELECT dataset, unnest([0.3, 0.5, 0.7, 1.0])::DOUBLE AS budget FROM d),
    f AS (SELECT DISTINCT o_custkey AS dataset, [0.3, 0.5, 0.7, 1.0][cast(o_orderkey % 4 AS INT) + 1]::DOUBLE AS budget FROM orders WHERE o_orderstatus <> 'O')
    SELECT dataset, budget FROM c ANTI JOIN f USING (dataset, budget)""",
)
def pending_cases_query(spark, sf):
    orders = read(spark, sf, "orders")
    cases = orders.select(F.col("o_custkey").alias("dataset")).distinct().withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (0.3, 0.5, 0.7, 1.0)])))
    finished = orders.where("o_orderstatus <> 'O'").selectExpr("o_custkey AS dataset", "element_at(array(0.3D, 0.5D, 0.7D, 1.0D), cast(o_orderkey % 4 AS int) + 1) AS budget")
    return pending_cases(cases, finished, ["dataset", "budget"])


@query(
    "failure_topk",
    "SELECT p_name AS reason, count(*) AS failures FROM part GROUP BY 1 ORDER BY failures DESC, reason LIMIT 5",
)
def failure_topk(spark, sf):
    return failure_counts(read(spark, sf, "part"), F.col("p_name"))


# --- end to end -----------------------------------------------------------------------------------

FEATURES = ["qty", "price", "disc", "tax"]
S7 = f"d2 < {threshold(0.7)}"


def _end_sql() -> str:
    def each(fmt: str, sep: str = ", ") -> str:
        return sep.join(fmt.format(c=c) for c in FEATURES)

    return f"""WITH b0 AS (SELECT {LINE_KEY_SQL} AS row_id, md5('42:' || {LINE_KEY_SQL}) AS h, l_returnflag, l_quantity AS qty, floor(l_extendedprice / 1000) AS price,
      nullif(l_discount, 0.0) AS disc, nullif(l_tax, 0.08) AS tax FROM lineitem),
    b AS (SELECT *, CASE WHEN {hex_sql('h')} < {threshold(0.3)} THEN 'test' WHEN {hex_sql('h')} < {threshold(0.6)} THEN 'val' ELSE 'train' END AS split, {hex_sql('h', 9)} AS d2 FROM b0),
    dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, qty, price, disc, tax, CASE WHEN {S7} THEN NULL ELSE row_id END ORDER BY row_id) AS r FROM b) WHERE r = 1),
    mi AS (SELECT {each('avg({c}) AS m_{c}')} FROM dd WHERE split = 'train' AND {S7}),
    im AS (SELECT row_id, split, d2, {each('coalesce({c}, m_{c}) AS {c}')} FROM dd, mi WHERE {S7} OR (disc IS NOT NULL AND tax IS NOT NULL)),
    sc AS (SELECT {each('min({c}) AS lo_{c}, max({c}) - min({c}) AS w_{c}')} FROM im WHERE split = 'train' AND {S7}),
    nm AS (SELECT row_id, split, d2, {each('({c} - lo_{c}) / w_{c} AS {c}')} FROM im, sc),
    zm AS (SELECT split, {each('median({c}) AS m_{c}')} FROM nm WHERE {S7} GROUP BY split),
    za AS (SELECT split, {each('1.4296 * median(abs({c} - m_{c})) AS a_{c}')} FROM nm JOIN zm USING (split) WHERE {S7} GROUP BY split),
    zs AS (SELECT nm.* FROM nm JOIN zm USING (split) JOIN za USING (split) WHERE NOT ({S7} AND ({each('(abs({c} - m_{c}) / a_{c} > 1.6)::INT', ' + ')}) / 4.0 > 0.3)),
    sd AS (SELECT unnest({FEATURES}) AS name, unnest([{each('stddev_samp({c})')}]) AS d FROM zs WHERE split = 'train' AND {S7}),
    kp AS (SELECT list(name) AS keep FROM sd WHERE d >= (SELECT quantile_cont(d, 0.3) FROM sd)),
    lg AS (SELECT split, unnest({FEATURES}) AS name, unnest([{each('{c}')}]) AS v FROM zs)
    SELECT split, name AS feature, count(*) AS n_rows, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS lo, round(max(v), 6) AS hi
    FROM lg, kp WHERE list_contains(keep, name) GROUP BY split, name"""


@query("prepare_end_to_end", _end_sql())
def prepare_end_to_end(spark, sf):
    """Deduplicate, impute, normalise, drop outliers and select on lineitem; statistics per split and kept feature."""
    df = lines(spark, sf, "l_returnflag", "l_quantity AS qty", "cast(floor(l_extendedprice / 1000) AS double) AS price", "nullif(l_discount, 0.0D) AS disc", "nullif(l_tax, 0.08D) AS tax")
    methods = {"duplicate_detection": "ED", "imputation": "MEAN", "data_normalization": "min_max", "outlier_detection": "ZSB", "feature_selection": "VAR"}
    prepared, models = prepare(df, methods, {s: 0.7 for s in methods}, "l_returnflag")
    kept = models[-1].state["keep"]
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in kept])).alias("item")
    stats = prepared.select("split", items).select("split", "item.*").groupBy("split", "feature").agg(
        F.count("v").alias("n_rows"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    return rounded(stats, 6)
