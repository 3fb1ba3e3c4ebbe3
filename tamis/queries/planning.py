"""Combination spaces and allocation of degrees. Plans are derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.keys import seeded_unit
from tamis.plans.allocate import (
    Space,
    balanced_start,
    best_plan,
    cheapest_methods,
    cols,
    column_score,
    coordinate_gradient,
    frank_wolfe,
    frank_wolfe_deterministic,
    greedy_plan,
    hybrid_rule,
    linear_oracle,
    monte_carlo,
    smoothed_gradient,
    swap_table,
    uniform_allocation,
)
from tamis.plans.chain import allocate, total
from tamis.plans.compare import running_best
from tamis.plans.cost import stage_seconds
from tamis.plans.objective import Objective, within_bounds
from tamis.plans.space import LEGACY, allowed_when_optional, combo_columns, combo_count, combos_per_row, exclude_combos, method_options
from tamis.queries.costs import COEFFS, PRICED, coefficients, priced_plans
from tamis.queries.registry import query, read, rounded, seeded_sql
from tamis.queries.tables import order_plans, plan_columns_sql

STAGES = list(LEGACY)
SIZE = combo_count(LEGACY)


def _combo_sql(index: str, options: dict) -> str:
    out, stride = [], combo_count(options)
    for stage, methods in options.items():
        stride //= len(methods)
        names = "[" + ", ".join("NULL" if m is None else f"'{m}'" for m in methods) + "]"
        out.append(f"{names}[({index} // {stride}) % {len(methods)} + 1] AS {stage}")
    return ", ".join(out)


def line_pivot(coefs, group, prefix):
    """One row per group with the stage's cost lines as maps method -> k and b."""
    return coefs.groupBy(*group).agg(
        *[
            F.map_from_entries(F.collect_list(F.when(F.col("process") == s, F.struct(F.col("method"), F.struct("k", "b"))))).alias(f"{prefix}{s}")
            for s in STAGES
        ]
    )


@query(
    "combo_space",
    f"""WITH {COEFFS}, d AS (SELECT DISTINCT dataset FROM c), n AS (SELECT dataset, i AS combo_id, {_combo_sql('i', LEGACY)} FROM d, range({SIZE}) r(i))
    SELECT n.dataset, cast(combo_id AS INT) AS combo_id, {', '.join(STAGES)}, round({' + '.join(f'greatest(0, c{j}.b + c{j}.k)' for j in range(6))}, 6) AS full_cost FROM n """
    + " ".join(f"JOIN c c{j} ON c{j}.dataset = n.dataset AND c{j}.process = '{s}' AND c{j}.method = n.{s}" for j, s in enumerate(STAGES)),
)
def combo_space_query(spark, sf):
    """All combinations per measured dataset with their full cost; the cost lines ride along as small maps."""
    lines = line_pivot(coefficients(spark, sf).where(F.col("process").isin(STAGES)), ["dataset"], "__m_")
    combos = combos_per_row(lines, LEGACY)
    cost = F.lit(0.0)
    for s in STAGES:
        line = F.col(f"__m_{s}")[F.col(s)]
        cost = cost + stage_seconds(line["k"], line["b"], F.lit(1.0))
    return rounded(combos.select("dataset", "combo_id", *STAGES, cost.alias("full_cost")), 6)


@query(
    "combo_exclude",
    f"""WITH p AS (SELECT DISTINCT {', '.join(f'm_{s}' for s in STAGES)} FROM (SELECT {plan_columns_sql('o_orderkey')} FROM orders)),
    n AS (SELECT i AS combo_id, {_combo_sql('i', LEGACY)} FROM range({SIZE}) r(i))
    SELECT combo_id, {', '.join(STAGES)} FROM n ANTI JOIN p ON {' AND '.join(f'm_{s} = {s}' for s in STAGES)}""",
)
def combo_exclude(spark, sf):
    """Combinations that no order has drawn."""
    drawn = order_plans(spark, sf).select(*[F.col(f"m_{s}").alias(s) for s in STAGES]).distinct()
    combos = spark.range(SIZE).select(F.col("id").alias("combo_id"), *combo_columns(LEGACY, F.col("id")))
    return exclude_combos(combos, drawn, STAGES)


_OPTIONAL = method_options("legacy", optional=True)
_KINDS = "SELECT o_orderpriority AS dataset, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 499000) AS bad, count(*) AS n FROM orders GROUP BY 1"


@query(
    "combo_optional",
    f"""WITH k AS (SELECT dataset, CASE WHEN dataset < '3' THEN 1 ELSE 0 END AS categorical_cols, CASE WHEN dataset LIKE '%M%' THEN 0.0 ELSE bad / n + 0.1 END AS missing_rate FROM ({_KINDS})),
    n AS (SELECT k.*, i AS combo_id, {_combo_sql('i', _OPTIONAL)} FROM k, range({combo_count(_OPTIONAL)}) r(i))
    SELECT dataset, cast(combo_id AS INT) AS combo_id FROM n WHERE (feature_encoding IS NOT NULL OR categorical_cols = 0) AND (imputation IS NOT NULL OR missing_rate = 0)""",
)
def combo_optional(spark, sf):
    kinds = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.sum(F.expr("CASE WHEN o_orderstatus = 'P' AND o_totalprice > 499000 THEN 1.0D ELSE 0.0D END")).alias("bad"), F.count(F.lit(1)).alias("n")
    )
    params = kinds.selectExpr(
        "dataset", "CASE WHEN dataset < '3' THEN 1 ELSE 0 END AS categorical_cols", "CASE WHEN dataset LIKE '%M%' THEN 0.0D ELSE bad / n + 0.1D END AS missing_rate"
    )
    return allowed_when_optional(combos_per_row(params, _OPTIONAL)).select("dataset", "combo_id")


# --- two-stage plans with closed-form utility and cost ---------------------------------------------

U_SQL = "0.6::DOUBLE + 0.15::DOUBLE * sqrt(e_0) + 0.2::DOUBLE * sqrt(e_1)"


def example_utility(e):
    return F.lit(0.6) + F.lit(0.15) * F.sqrt(e[0]) + F.lit(0.2) * F.sqrt(e[1])


def example_cost(e):
    return F.lit(0.05) + F.lit(0.4) * e[0] + F.lit(0.6) * e[1]


def two_stage(spark, sf, table="orders", key="o_orderkey"):
    """A plan per row: drawn degrees, full bounds, a budget from the row's amount."""
    amount = "o_totalprice" if table == "orders" else "c_acctbal"
    return read(spark, sf, table).select(
        F.col(key),
        *([F.col("o_custkey")] if table == "orders" else []),
        *[seeded_unit(42, "two", i, F.col(key)).alias(f"e_{i}") for i in range(2)],
        *[F.lit(0.0).alias(f"lo_{i}") for i in range(2)],
        *[F.lit(1.0).alias(f"hi_{i}") for i in range(2)],
        (F.lit(0.1) + F.pmod(F.abs(F.col(amount)), F.lit(1000.0)) / 1000.0).alias("budget"),
    )


def _two_sql(table="orders", key="o_orderkey") -> str:
    amount = "o_totalprice" if table == "orders" else "c_acctbal"
    extra = "o_custkey, " if table == "orders" else ""
    seeds = ", ".join(seeded_sql("'42'", "'two'", f"'{i}'", key) + f" AS e_{i}" for i in range(2))
    return f"SELECT {key}, {extra}{seeds}, 0.1::DOUBLE + abs({amount}) % 1000.0::DOUBLE / 1000.0::DOUBLE AS budget FROM {table}"


_UC = f"q AS (SELECT *, {U_SQL} AS u, 0.05::DOUBLE + 0.4::DOUBLE * e_0 + 0.6::DOUBLE * e_1 AS cost FROM ({_two_sql()}))"


def _scored(spark, sf):
    df = two_stage(spark, sf)
    e = cols("e", 2)
    return df.withColumn("u", example_utility(e)).withColumn("cost", example_cost(e))


@query(
    "objective_value",
    f"""WITH {_UC} SELECT o_orderkey, round(u, 8) AS best_u, round(-cost - 100 * greatest(0, 0.8 - u) * greatest(0, 0.8 - u), 8) AS target_value,
    round((u - 0.6) / (greatest(0, cost) + 1e-6), 6) AS ratio_value FROM q""",
)
def objective_value(spark, sf):
    df = _scored(spark, sf)
    u, c = F.col("u"), F.col("cost")
    return rounded(
        df.select(
            "o_orderkey",
            Objective(budget=1.0).value(u, c).alias("best_u"),
            Objective("target_cost", target=0.8).value(u, c).alias("target_value"),
            Objective("utility_cost_ratio", baseline=0.6).value(u, c).alias("ratio_value"),
        ),
        {"best_u": 8, "target_value": 8, "ratio_value": 6},
    )


@query("plan_feasible", f"WITH {_UC} SELECT o_orderkey, round(cost, 8) AS cost FROM q WHERE cost <= budget + 1e-9")
def plan_feasible(spark, sf):
    df = _scored(spark, sf)
    objective = Objective(budget=F.col("budget"))
    inside = within_bounds(cols("e", 2), cols("lo", 2), cols("hi", 2))
    return rounded(df.where(inside & objective.feasible(F.col("cost"))).select("o_orderkey", "cost"), 8)


@query(
    "plan_best",
    f"""WITH {_UC} SELECT o_custkey, o_orderkey, round(u, 8) AS u, round(cost, 8) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (u + 1e-6 >= 0.8)::INT DESC,
      CASE WHEN u + 1e-6 >= 0.8 THEN -cost ELSE u END DESC, CASE WHEN u + 1e-6 >= 0.8 THEN u ELSE -cost END DESC, o_orderkey) AS r FROM q) WHERE r = 1""",
)
def plan_best(spark, sf):
    space = Space(2, Objective("target_cost", target=0.8), cost=example_cost)
    return rounded(best_plan(_scored(spark, sf), space, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "u", "cost"), 8)


@query(
    "segment_feasible",
    f"""WITH p AS ({_two_sql()}) SELECT o_orderkey, round(least(1, (budget - 0.05) / 1.0), 8) AS e_0, round(least(1, (budget - 0.05) / 1.0), 8) AS e_1 FROM p WHERE budget >= 0.05""",
)
def segment_feasible(spark, sf):
    """Balanced start points: bisection on the clipped cost."""
    space = Space(2, Objective(budget=F.col("budget")), cost=example_cost)
    return rounded(balanced_start(two_stage(spark, sf), space).select("o_orderkey", "e_0", "e_1"), 8)


@query(
    "segment_closed_form",
    f"""WITH p AS ({_two_sql()}) SELECT o_orderkey, round(least(1, (budget - 0.05) / 1.0), 8) AS e_0, round(least(1, (budget - 0.05) / 1.0), 8) AS e_1 FROM p WHERE budget >= 0.05""",
)
def segment_closed_form(spark, sf):
    space = Space(2, Objective(budget=F.col("budget")), cost=example_cost, affine=True)
    return rounded(balanced_start(two_stage(spark, sf), space).select("o_orderkey", "e_0", "e_1"), 8)


# --- three-stage plans with cost lines -------------------------------------------------------------


def three_stage(spark, sf):
    """Cost lines, gradient and budget of every order from its hash."""
    unit = lambda tag, i: seeded_unit(42, tag, i, F.col("o_orderkey"))
    return read(spark, sf, "orders").select(
        "o_orderkey",
        *[(unit("k", i) * 0.5).alias(f"k_{i}") for i in range(3)],
        *[(unit("b", i) * 0.1).alias(f"b_{i}") for i in range(3)],
        *[(unit("g", i) - 0.25).alias(f"g_{i}") for i in range(3)],
        *[F.lit(0.1).alias(f"lo_{i}") for i in range(3)],
        *[F.lit(1.0).alias(f"hi_{i}") for i in range(3)],
        (F.lit(0.2) + unit("t", 0)).alias("budget"),
    )


def _three_sql() -> str:
    def unit(tag, i):
        return seeded_sql("'42'", f"'{tag}'", f"'{i}'", "o_orderkey")

    parts = [f"{unit('k', i)} * 0.5::DOUBLE AS k_{i}, {unit('b', i)} * 0.1::DOUBLE AS b_{i}, {unit('g', i)} - 0.25::DOUBLE AS g_{i}" for i in range(3)]
    return f"SELECT o_orderkey, {', '.join(parts)}, 0.2::DOUBLE + {unit('t', 0)} AS budget FROM orders"


@query(
    "linear_oracle",
    f"""WITH p AS ({_three_sql()}), f AS (SELECT * FROM p WHERE b_0 + b_1 + b_2 + 0.1 * (k_0 + k_1 + k_2) <= budget + 1e-9),
    l AS (SELECT o_orderkey, budget - (b_0 + b_1 + b_2 + 0.1 * (k_0 + k_1 + k_2)) AS rest, unnest(range(3)) AS i, unnest([k_0, k_1, k_2]) AS k, unnest([g_0, g_1, g_2]) AS g FROM f),
    w AS (SELECT *, CASE WHEN g > 0 THEN k * 0.9 ELSE 0 END AS want, coalesce(sum(CASE WHEN g > 0 THEN k * 0.9 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY g / k DESC, i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
    o AS (SELECT o_orderkey, i, 0.1 + CASE WHEN g > 0 THEN least(want, greatest(0, rest - before)) / k ELSE 0 END AS e FROM w)
    SELECT o_orderkey, round(max(CASE WHEN i = 0 THEN e END), 7) AS x_0, round(max(CASE WHEN i = 1 THEN e END), 7) AS x_1, round(max(CASE WHEN i = 2 THEN e END), 7) AS x_2 FROM o GROUP BY 1""",
)
def linear_oracle_query(spark, sf):
    space = Space(3, Objective(budget=F.col("budget")))
    done = linear_oracle(space.startable(three_stage(spark, sf)), space, cols("g", 3), ["x_0", "x_1", "x_2"])
    return rounded(done.select("o_orderkey", "x_0", "x_1", "x_2"), 7)


@query(
    "uniform_alloc",
    f"""WITH p AS ({_three_sql()}), s AS (SELECT *, budget - (b_0 + b_1 + b_2 + 0.1 * (k_0 + k_1 + k_2)) AS rest FROM p),
    l AS (SELECT o_orderkey, rest, unnest(range(3)) AS i, unnest([k_0, k_1, k_2]) AS k FROM s),
    w AS (SELECT *, 0.9 * k AS inc, row_number() OVER (PARTITION BY o_orderkey ORDER BY k, i) AS m,
      coalesce(sum(0.9 * k) OVER (PARTITION BY o_orderkey ORDER BY k, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
    v AS (SELECT *, (rest - before) / (4 - m) AS lv FROM w), t AS (SELECT o_orderkey, coalesce(arg_min(lv, m) FILTER (inc >= lv), 1e9) AS level FROM v GROUP BY 1),
    e AS (SELECT o_orderkey, i, CASE WHEN rest > 1e-12 THEN least(1, 0.1 + least(inc, level) / k) ELSE 0.1::DOUBLE END AS e FROM v JOIN t USING (o_orderkey))
    SELECT o_orderkey, round(max(CASE WHEN i = 0 THEN e END), 7) AS e_0, round(max(CASE WHEN i = 1 THEN e END), 7) AS e_1, round(max(CASE WHEN i = 2 THEN e END), 7) AS e_2 FROM e GROUP BY 1""",
)
def uniform_alloc(spark, sf):
    space = Space(3, Objective(budget=F.col("budget")))
    return rounded(uniform_allocation(three_stage(spark, sf), space).select("o_orderkey", "e_0", "e_1", "e_2"), 7)



@query(
    "uniform_best",
    f"""WITH p AS ({_two_sql()}), v AS (SELECT *, budget - 0.15::DOUBLE AS rest FROM p),
    l AS (SELECT *, CASE WHEN rest / 2 <= 0.36 THEN rest / 2 WHEN rest - 0.36 <= 0.54 THEN rest - 0.36 ELSE 1e9 END AS level FROM v WHERE budget >= 0.15),
    e AS (SELECT o_custkey, o_orderkey, CASE WHEN rest > 1e-12 THEN least(1, 0.1 + least(0.36, level) / 0.4) ELSE 0.1 END AS e_0,
      CASE WHEN rest > 1e-12 THEN least(1, 0.1 + least(0.54, level) / 0.6) ELSE 0.1 END AS e_1 FROM l),
    u AS (SELECT *, {U_SQL} AS u FROM e)
    SELECT o_custkey, o_orderkey, round(u, 7) AS u FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round(u, 10) DESC, o_orderkey) AS r FROM u) WHERE r = 1""",
)
def uniform_best(spark, sf):
    """Best uniformly allocated plan of each customer."""
    df = two_stage(spark, sf).select("*", F.lit(0.4).alias("k_0"), F.lit(0.6).alias("k_1"), F.lit(0.0).alias("b_0"), F.lit(0.0).alias("b_1"))
    space = Space(2, Objective(budget=F.col("budget")), overhead=0.05)
    spread = uniform_allocation(df, space).where(F.col("cost") <= F.col("budget") + 1e-9)
    scored = column_score(example_utility, 2)(spread).withColumn("u", F.round("u", 10)).withColumn("cost", F.lit(0.0))
    return rounded(best_plan(scored, space, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "u"), 7)


@query(
    "mc_allocate",
    f"""WITH p AS (SELECT c_custkey, 0.1::DOUBLE + abs(c_acctbal) % 1000.0::DOUBLE / 1000.0::DOUBLE AS budget FROM customer),
    d AS (SELECT p.*, draw, {", ".join(seeded_sql("'42'", "'mc'", f"'{i}'", "draw", "c_custkey") + f" AS e_{i}" for i in range(2))} FROM p, range(1, 31) r(draw)),
    s AS (SELECT *, 0.05::DOUBLE + 0.4::DOUBLE * e_0 + 0.6::DOUBLE * e_1 AS cost, {U_SQL} AS u FROM d),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY u DESC, draw) AS r FROM s WHERE cost <= budget + 1e-9) WHERE r = 1),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY cost, draw) AS r FROM s) WHERE r = 1)
    SELECT c.c_custkey, round(b.u, 8) AS u, round(coalesce(b.cost, c.cost), 8) AS cost, round(coalesce(b.e_0, c.e_0), 8) AS e_0, round(coalesce(b.e_1, c.e_1), 8) AS e_1, b.u IS NOT NULL AS feasible
    FROM c LEFT JOIN b USING (c_custkey)""",
)
def mc_allocate(spark, sf):
    plans = two_stage(spark, sf, "customer", "c_custkey")
    space = Space(2, Objective(budget=F.col("budget")), cost=example_cost)
    return rounded(monte_carlo(plans, space, column_score(example_utility, 2), ["c_custkey"], 30), 8)


# probes along (0.6, 0.8), the first and the second axis
_DIRECTIONS = [(0.6, 0.8), (1.0, 0.0), (0.0, 1.0)]


def _moved(x: str, y: str, limit: str = "budget") -> list[str]:
    """Point on the way from (e_0, e_1) to (x, y) that keeps the budget; costs are affine here."""
    c0, c1 = "(0.05 + 0.4 * e_0 + 0.6 * e_1)", f"(0.05 + 0.4 * {x} + 0.6 * {y})"
    share = f"(CASE WHEN {c1} <= {limit} + 1e-9 THEN 1 ELSE ({limit} - {c0}) / ({c1} - {c0}) END)"
    return [f"e_{i} + {share} * ({t} - e_{i})" for i, t in enumerate((x, y))]


def _probe_sql(pairs: str) -> str:
    px, py = _moved("px", "py")
    mx, my = _moved("mx", "my")
    return f"""WITH p AS (SELECT o_orderkey, budget, least(1, budget - 0.05) AS e_0, least(1, budget - 0.05) AS e_1 FROM ({_two_sql()}) WHERE budget >= 0.05),
    t AS ({pairs}), m AS (SELECT o_orderkey, q, {px} AS p0, {py} AS p1, {mx} AS m0, {my} AS m1 FROM t),
    v AS (SELECT *, 0.15 * (sqrt(p0) - sqrt(m0)) + 0.2 * (sqrt(p1) - sqrt(m1)) AS dv, p0 - m0 AS d0, p1 - m1 AS d1 FROM m)"""


@query(
    "fw_round",
    _probe_sql(
        " UNION ALL ".join(
            f"SELECT *, {q} AS q, least(1, greatest(0, e_0 + 0.1 * {x})) AS px, least(1, greatest(0, e_1 + 0.1 * {y})) AS py, "
            f"least(1, greatest(0, e_0 - 0.1 * {x})) AS mx, least(1, greatest(0, e_1 - 0.1 * {y})) AS my FROM p"
            for q, (x, y) in enumerate(_DIRECTIONS)
        )
    )
    + " SELECT o_orderkey, round(avg(2 * dv * d0 / (d0 * d0 + d1 * d1)), 5) AS g_0, round(avg(2 * dv * d1 / (d0 * d0 + d1 * d1)), 5) AS g_1 FROM v GROUP BY o_orderkey",
)
def fw_round(spark, sf):
    """Smoothed gradient of every order's plan at its start point, with fixed directions."""
    space = Space(2, Objective(budget=F.col("budget")), cost=example_cost, affine=True)
    start = balanced_start(two_stage(spark, sf), space).drop("o_custkey")
    directions = [[F.lit(x), F.lit(y)] for x, y in _DIRECTIONS]
    done = smoothed_gradient(start, space, column_score(example_utility, 2), ["o_orderkey"], directions, 0.1)
    return rounded(done.select("o_orderkey", "g_0", "g_1"), 5)


@query(
    "fw_det_round",
    _probe_sql(
        " UNION ALL ".join(
            f"SELECT *, {q} AS q, least(1, e_0 + 0.02 * {x}) AS px, least(1, e_1 + 0.02 * {y}) AS py, greatest(0, e_0 - 0.02 * {x}) AS mx, greatest(0, e_1 - 0.02 * {y}) AS my FROM p"
            for q, (x, y) in enumerate([(1, 0), (0, 1)])
        )
    )
    + """ SELECT o_orderkey, round(max(CASE WHEN q = 0 THEN 0.15 * (sqrt(p0) - sqrt(m0)) / d0 END), 5) AS g_0,
    round(max(CASE WHEN q = 1 THEN 0.2 * (sqrt(p1) - sqrt(m1)) / d1 END), 5) AS g_1 FROM v GROUP BY o_orderkey""",
)
def fw_det_round(spark, sf):
    space = Space(2, Objective(budget=F.col("budget")), cost=example_cost, affine=True)
    start = balanced_start(two_stage(spark, sf), space).drop("o_custkey")
    done = coordinate_gradient(start, space, column_score(example_utility, 2), ["o_orderkey"])
    return rounded(done.select("o_orderkey", "g_0", "g_1"), 5)


@query("plan_synthetic")
def plan_synthetic(spark, sf):
    """Zeroth-order Frank-Wolfe for the budget of every customer."""
    plans = two_stage(spark, sf, "customer", "c_custkey")
    space = Space(2, Objective(budget=F.col("budget")), cost=example_cost, affine=True)
    return rounded(frank_wolfe(plans, space, column_score(example_utility, 2), ["c_custkey"]), 6)


# best degrees in closed form: shares of the rest by (weight / price)^2, what one stage cannot take goes to the other
_CLOSED = """p AS ({plans}), r AS (SELECT c_custkey, budget - 0.05::DOUBLE AS rest FROM p WHERE budget >= 0.05),
    s AS (SELECT *, 0.140625::DOUBLE * rest / (0.05625::DOUBLE + 0.04::DOUBLE / 0.6::DOUBLE) AS a, 0.04::DOUBLE / 0.36::DOUBLE * rest / (0.05625::DOUBLE + 0.04::DOUBLE / 0.6::DOUBLE) AS b FROM r),
    e AS (SELECT c_custkey, CASE WHEN b > 1 AND a <= 1 THEN least(1, (rest - 0.6) / 0.4) ELSE least(1, a) END AS e_0,
      CASE WHEN a > 1 THEN least(1, (rest - 0.4) / 0.6) ELSE least(1, b) END AS e_1 FROM s)"""


_CLOSED_GAP = f"""WITH {_CLOSED.format(plans=_two_sql('customer', 'c_custkey'))}
    SELECT c_custkey, round(0.6::DOUBLE + 0.15::DOUBLE * sqrt(e_0) + 0.2::DOUBLE * sqrt(e_1), 6) AS closed_u, true AS feasible, true AS close FROM e"""


def _closed_gap(spark, sf, found):
    """Allocations of the customers against the best utility in closed form: within the budget, and within 0.001 of it."""
    found = found.join(two_stage(spark, sf, "customer", "c_custkey").select("c_custkey", "budget"), "c_custkey")
    rest = F.col("budget") - 0.05
    weight = 0.05625 + 0.04 / 0.6
    a, b = 0.140625 * rest / weight, 0.04 / 0.36 * rest / weight
    first = F.when((b > 1) & (a <= 1), F.least(F.lit(1.0), (rest - 0.6) / 0.4)).otherwise(F.least(F.lit(1.0), a))
    second = F.when(a > 1, F.least(F.lit(1.0), (rest - 0.4) / 0.6)).otherwise(F.least(F.lit(1.0), b))
    best = example_utility([first, second])
    checked = found.select(
        "c_custkey", best.alias("closed_u"), (F.col("cost") <= F.col("budget") + 1e-6).alias("feasible"), (best - F.col("u") <= 1e-3).alias("close")
    )
    return rounded(checked, 6)


@query("plan_synthetic_gap", _CLOSED_GAP)
def plan_synthetic_gap(spark, sf):
    """The zeroth-order allocation of every customer."""
    return _closed_gap(spark, sf, plan_synthetic(spark, sf))


# --- plans that use an operator twice --------------------------------------------------------------

# (operator, weight, share of the cost drawn for it): impute, scale, impute again
_TWICE = [("impute", 0.3, 0.5), ("scale", 0.2, 0.3), ("impute", 0.15, 0.8)]


def _twice_sql() -> str:
    prices = ", ".join(f"{share}::DOUBLE + {seeded_sql(repr('42'), repr('twice'), repr(str(i)), 'c_custkey')} AS k_{i}" for i, (_, _, share) in enumerate(_TWICE))
    return f"SELECT c_custkey, {prices}, 0.1::DOUBLE + abs(c_acctbal) % 100.0::DOUBLE / 500.0::DOUBLE AS budget FROM customer"


@query(
    "plan_repeated",
    f"""WITH p AS ({_twice_sql()}), f AS (SELECT *, {' + '.join(f'{w * w!r}::DOUBLE / k_{i}' for i, (_, w, _) in enumerate(_TWICE))} AS s FROM p)
    SELECT c_custkey, '{"/".join(o for o, _, _ in _TWICE)}' AS operators, round(sqrt((budget - 0.03::DOUBLE) * s), 6) AS closed_u, true AS feasible, true AS close FROM f""",
)
def plan_repeated(spark, sf):
    """An operator twice in a plan: the sum of weighted roots has its best degrees, and their utility, in closed form."""
    unit = lambda i: seeded_unit(42, "twice", i, F.col("c_custkey"))
    prices = [F.lit(share) + unit(i) for i, (_, _, share) in enumerate(_TWICE)]
    ops = [
        F.struct(F.lit(o).alias("operator"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), k.alias("k"), F.lit(0.01).alias("b"), F.lit(w).alias("weight"))
        for (o, w, _), k in zip(_TWICE, prices)
    ]
    budget = F.lit(0.1) + F.pmod(F.abs("c_acctbal"), F.lit(100.0)) / 500.0
    # the allocation is the work here: a small file would give it to one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plans = read(spark, sf, "customer").repartition(tasks, "c_custkey").select("c_custkey", F.array(*ops).alias("ops"), budget.alias("budget"))
    done = allocate(plans, lambda ops, e: total(F.zip_with(ops, e, lambda o, x: o["weight"] * F.sqrt(x))))
    best = F.sqrt((F.col("budget") - 0.03) * total(F.transform("ops", lambda o: o["weight"] * o["weight"] / o["k"])))
    return rounded(
        done.select(
            "c_custkey", F.concat_ws("/", F.transform("ops", lambda o: o["operator"])).alias("operators"), best.alias("closed_u"),
            (F.col("cost") <= F.col("budget") + 1e-9).alias("feasible"), (F.abs(F.col("u") - best) <= 1e-3).alias("close"),
        ),
        6,
    )


@query("fw_deterministic")
def fw_deterministic(spark, sf):
    plans = two_stage(spark, sf, "customer", "c_custkey")
    space = Space(2, Objective(budget=F.col("budget")), cost=example_cost, affine=True)
    return rounded(frank_wolfe_deterministic(plans, space, column_score(example_utility, 2), ["c_custkey"]), 6)


@query("fw_deterministic_gap", _CLOSED_GAP)
def fw_deterministic_gap(spark, sf):
    """The deterministic Frank-Wolfe allocation of every customer, at its default rounds."""
    return _closed_gap(spark, sf, fw_deterministic(spark, sf))


@query(
    "hybrid_rule",
    f"""WITH p AS ({_three_sql()}), c AS (SELECT *, b_0 + b_1 + b_2 + k_0 + k_1 + k_2 AS f, b_0 + b_1 + b_2 + 0.2 * (k_0 + k_1 + k_2) AS l FROM p)
    SELECT o_orderkey, round(f, 8) AS full_cost, round(l, 8) AS low_cost, CASE WHEN f <= budget THEN 'direct' WHEN l <= budget THEN 'optimise' ELSE 'skip' END AS branch FROM c""",
)
def hybrid_rule_query(spark, sf):
    space = Space(3, Objective(budget=F.col("budget")))
    return rounded(hybrid_rule(three_stage(spark, sf), space).select("o_orderkey", "full_cost", "low_cost", "branch"), 8)


@query("random_budget", f"WITH {PRICED} SELECT o_orderkey, dataset, round(cost, 6) AS cost FROM pc WHERE cost <= 0.7")
def random_budget(spark, sf):
    """Drawn plans within the budget, the ones a random search would run."""
    return rounded(priced_plans(spark, sf).where("cost <= 0.7").select("o_orderkey", "dataset", "cost"), 6)


@query(
    "cheapest_plan",
    f"""WITH {COEFFS} SELECT dataset, stage, method, round(seconds, 6) AS seconds FROM (SELECT dataset, process AS stage, method, greatest(0, b + 0.1 * k) AS seconds,
    row_number() OVER (PARTITION BY dataset, process ORDER BY greatest(0, b + 0.1 * k), method) AS r FROM c) WHERE r = 1""",
)
def cheapest_plan(spark, sf):
    lines = coefficients(spark, sf).withColumnRenamed("process", "stage")
    return rounded(cheapest_methods(lines, ["dataset"]), 6)


def _gain(stage, method, e):
    """Predicted gain of a swap: a share per stage and method, growing with the root of the degree."""
    return seeded_unit(42, "gain", stage, method) * F.sqrt(e) * 0.2


def _swaps(spark, sf):
    lines = coefficients(spark, sf).withColumnRenamed("process", "stage").where(F.col("stage").isin(STAGES))
    return swap_table(lines, ["dataset"], 0.1, [0.1, 0.3, 0.5, 0.7, 1.0], _gain)


@query(
    "greedy_ratio",
    f"""WITH {COEFFS}, l AS (SELECT dataset, process AS stage, method, k, b FROM c WHERE process IN ({', '.join(f"'{s}'" for s in STAGES)})),
    m AS (SELECT dataset, stage, min(greatest(0, b + 0.1 * k)) AS base FROM l GROUP BY ALL),
    s AS (SELECT l.*, e, base, greatest(0, b + k * e) AS seconds, {seeded_sql("'42'", "'gain'", "stage", "method")} * sqrt(e) * 0.2 AS gain
      FROM l JOIN m USING (dataset, stage), (SELECT unnest([0.1, 0.3, 0.5, 0.7, 1.0])::DOUBLE AS e))
    SELECT dataset, stage, method, e, round(greatest(0, seconds - base), 6) AS cost_delta, round(gain, 6) AS gain_delta FROM s""",
)
def greedy_ratio(spark, sf):
    return rounded(_swaps(spark, sf).select("dataset", "stage", "method", "e", "cost_delta", "gain_delta"), 6)


def _greedy_sql() -> str:
    """Swaps taken one by one: t_j is what stage j takes, c_j the number of its swap."""
    d = len(STAGES)
    columns = ", ".join(f"{n}_{j}" for n in "tc" for j in range(d))
    start = ", ".join([f"max(CASE WHEN stage = '{s}' THEN base END) AS t_{j}" for j, s in enumerate(STAGES)] + [f"cast(0 AS BIGINT) AS c_{j}" for j in range(d)])
    takes = [f"o.stage = '{s}' AND c_{j} = 0 AND {' + '.join('o.seconds' if i == j else f't_{i}' for i in range(d))} <= o.budget" for j, s in enumerate(STAGES)]
    step = ", ".join([f"CASE WHEN {x} THEN o.seconds ELSE t_{j} END" for j, x in enumerate(takes)] + [f"CASE WHEN {x} THEN o.i ELSE c_{j} END" for j, x in enumerate(takes)])
    return f"""WITH RECURSIVE {COEFFS}, l AS (SELECT dataset, process AS stage, method, k, b FROM c WHERE process IN ({', '.join(f"'{s}'" for s in STAGES)})),
    m AS (SELECT dataset, stage, min(greatest(0, b + 0.1 * k)) AS base FROM l GROUP BY ALL),
    s AS (SELECT l.*, e, base, greatest(0, b + k * e) AS seconds, {seeded_sql("'42'", "'gain'", "stage", "method")} * sqrt(e) * 0.2 AS gain, budget
      FROM l JOIN m USING (dataset, stage), (SELECT unnest([0.1, 0.3, 0.5, 0.7, 1.0])::DOUBLE AS e), (SELECT unnest([0.3, 0.5, 0.7, 1.0])::DOUBLE AS budget)),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY dataset, budget ORDER BY gain / greatest(seconds - base, 1e-9) DESC, gain DESC, stage, method, e) AS i FROM s),
    it(dataset, budget, i, {columns}) AS (
      SELECT dataset, budget, cast(0 AS BIGINT), {columns} FROM (SELECT dataset, budget, {start} FROM s GROUP BY dataset, budget)
      UNION ALL SELECT it.dataset, it.budget, o.i, {step} FROM it JOIN o ON o.dataset = it.dataset AND o.budget = it.budget AND o.i = it.i + 1),
    f AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY dataset, budget ORDER BY i DESC) = 1),
    u AS (SELECT dataset, budget, unnest([{', '.join(f"'{s}'" for s in STAGES)}]) AS stage, unnest([{', '.join(f't_{j}' for j in range(d))}]) AS seconds, unnest([{', '.join(f'c_{j}' for j in range(d))}]) AS i,
      {' + '.join(f't_{j}' for j in range(d))} AS total FROM f)
    SELECT u.dataset, u.budget, u.stage, o.method, o.e, round(u.seconds, 6) AS seconds, round(total, 6) AS total FROM u LEFT JOIN o ON o.dataset = u.dataset AND o.budget = u.budget AND o.i = u.i"""


@query("greedy_plan", _greedy_sql())
def greedy_plan_query(spark, sf):
    """Accepted swaps per measured dataset and budget."""
    budgets = F.explode(F.array(*[F.lit(b) for b in (0.3, 0.5, 0.7, 1.0)]))
    cases = _swaps(spark, sf).withColumn("budget", budgets)
    return rounded(greedy_plan(cases, ["dataset", "budget"]), 6)


@query(
    "running_best",
    """SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS step, max(l_extendedprice) AS score,
    max(max(l_extendedprice)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
    FROM lineitem GROUP BY l_suppkey, step""",
)
def running_best_query(spark, sf):
    """A supplier's lines as a search trace."""
    trace = read(spark, sf, "lineitem").groupBy("l_suppkey", F.expr("l_orderkey * 8 + l_linenumber AS step")).agg(F.max("l_extendedprice").alias("score"))
    return running_best(trace, ["l_suppkey"], "step", "score")


