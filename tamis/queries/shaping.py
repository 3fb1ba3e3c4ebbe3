"""Normalization, feature extraction and feature selection."""

from __future__ import annotations

import hashlib

import numpy as np

from tamis.operators.extract import FeatureExtraction
from tamis.operators.normalize import (
    CENTRE_DEN,
    CENTRE_NUM,
    MIDDLE_DEN,
    MIDDLE_NUM,
    NORMAL_BOUND,
    TAIL_DEN,
    TAIL_NUM,
    Normalization,
)
from tamis.operators.select import FeatureSelection, score_table
from tamis.queries.cleaning import EMB_SQL, embeddings
from tamis.queries.registry import FOUR, GAPS, GAPS_SQL, HALF, NUMBERS, NUMBERS_SQL, lines, lines_sql, query, rounded

SAMPLE = f"split = 'train' AND d2 < {HALF}"
# filled table: gaps take the full training mean
FILLED = (
    f"b AS ({lines_sql(GAPS_SQL)}), fm AS (SELECT {', '.join(f'avg({c}) AS f_{c}' for c in FOUR)} FROM b WHERE split = 'train'), "
    f"x AS (SELECT row_id, split, d2, {', '.join(f'coalesce({c}, f_{c}) AS {c}' for c in FOUR)} FROM b, fm)"
)


def _normed(spark, sf, method, digits=4, columns=GAPS, **options):
    df = lines(spark, sf, *columns)
    return rounded(Normalization(method, degree=0.5, **options).fit(df).transform(df).drop("row_hash"), digits)


def _scale_sql(stats, cell) -> str:
    return (
        f"WITH {FILLED}, st AS (SELECT {', '.join(stats(c) for c in FOUR)} FROM x WHERE {SAMPLE}) "
        f"SELECT row_id, split, {', '.join(f'round({cell(c)}, 4) AS {c}' for c in FOUR)} FROM x, st"
    )


def _or_one(c: str) -> str:
    return f"CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END"


@query("norm_zscore", _scale_sql(lambda c: f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}", lambda c: f"({c} - m_{c}) / {_or_one(c)}"))
def norm_zscore(spark, sf):
    return _normed(spark, sf, "z_score")


@query(
    "norm_robust",
    _scale_sql(
        lambda c: f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS d_{c}",
        lambda c: f"({c} - m_{c}) / {_or_one(c)}",
    ),
)
def norm_robust(spark, sf):
    return _normed(spark, sf, "robust")


@query("norm_minmax", _scale_sql(lambda c: f"min({c}) AS m_{c}, max({c}) - min({c}) AS d_{c}", lambda c: f"({c} - m_{c}) / {_or_one(c)}"))
def norm_minmax(spark, sf):
    return _normed(spark, sf, "min_max")


@query("norm_maxabs", _scale_sql(lambda c: f"max(abs({c})) AS d_{c}", lambda c: f"{c} / {_or_one(c)}"))
def norm_maxabs(spark, sf):
    return _normed(spark, sf, "max_abs")


@query(
    "norm_l2",
    f"WITH {FILLED}, n AS (SELECT *, sqrt({' + '.join(f'{c} * {c}' for c in FOUR)}) AS len FROM x) "
    f"SELECT row_id, split, {', '.join(f'round(CASE WHEN len > 0 THEN {c} / len ELSE {c} END, 8) AS {c}' for c in FOUR)} FROM n",
)
def norm_l2(spark, sf):
    return _normed(spark, sf, "normalizer", 8)


@query(
    "norm_sigmoid",
    f"WITH {FILLED}, v AS (SELECT unnest([{', '.join(FOUR)}]) AS v FROM x WHERE {SAMPLE}), st AS (SELECT avg(v) AS m, stddev_samp(v) AS d FROM v) "
    f"SELECT row_id, split, {', '.join(f'round(1 / (1 + exp(-({c} - m) / d)), 6) AS {c}' for c in FOUR)} FROM x, st",
)
def norm_sigmoid(spark, sf):
    return _normed(spark, sf, "sigmoid", 6)


@query(
    "norm_kbins_u",
    _scale_sql(
        lambda c: f"min({c}) AS m_{c}, (max({c}) - min({c})) / 5.0::DOUBLE AS d_{c}",
        lambda c: "(" + " + ".join(f"({c} >= m_{c} + {j} * d_{c})::INT" for j in range(1, 5)) + ")::DOUBLE",
    ),
)
def norm_kbins_u(spark, sf):
    return _normed(spark, sf, "kbins_uniform")


@query(
    "norm_kbins_q",
    f"""WITH {FILLED}, st AS (SELECT {', '.join(f'quantile_cont({c}, [0.2, 0.4, 0.6, 0.8]) AS q_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in ['qty', 'price'])} FROM x WHERE {SAMPLE})
    SELECT row_id, split, """
    + ", ".join(f"({' + '.join(f'({c} >= q_{c}[{j}])::INT' for j in range(1, 5))})::DOUBLE AS {c}" for c in ["qty", "price"])
    + " FROM x, st",
)
def norm_kbins_q(spark, sf):
    return _normed(spark, sf, "kbins_quantile", columns=["l_quantity AS qty", "l_extendedprice AS price"])


def _knots_sql(c: str) -> str:
    probs = "[" + ", ".join(repr(float(p)) for p in np.linspace(0, 1, 1000)) + "]"
    return (
        f"k_{c} AS (SELECT v, min(p) AS p1, max(p) AS p2 FROM (SELECT unnest(quantile_cont({c}, {probs})) AS v, unnest({probs}) AS p FROM x WHERE {SAMPLE}) GROUP BY v), "
        f"n_{c} AS (SELECT *, lead(v) OVER (ORDER BY v) AS v2, lead(p1) OVER (ORDER BY v) AS q1 FROM k_{c}), "
        f"e_{c} AS (SELECT min(v) AS lo, max(v) AS hi FROM k_{c}), "
        f"y_{c} AS (SELECT row_id, CASE WHEN {c} <= lo THEN 0.0 WHEN {c} >= hi THEN 1.0 WHEN {c} = v THEN (p1 + p2) / 2 "
        f"ELSE p2 + ({c} - v) / (v2 - v) * (q1 - p2) END AS y FROM x ASOF LEFT JOIN n_{c} ON {c} >= v, e_{c})"
    )


_KNOTS = f"WITH {FILLED}, {_knots_sql('qty')}, {_knots_sql('price')} "
_TWO = ["l_quantity AS qty", "l_extendedprice AS price"]


@query(
    "norm_quniform",
    _KNOTS + "SELECT x.row_id, split, round(yq.y, 6) AS qty, round(yp.y, 6) AS price FROM x JOIN y_qty yq ON x.row_id = yq.row_id JOIN y_price yp ON x.row_id = yp.row_id",
)
def norm_quniform(spark, sf):
    return _normed(spark, sf, "quantile_uniform", 6, _TWO)


def _poly_sql(coefficients, r: str) -> str:
    out = repr(float(coefficients[-1])) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {r} + {float(c)!r}::DOUBLE)"
    return out


def _probit_sql(y: str) -> str:
    q, t = f"({y} - 0.5)", f"sqrt(-ln(CASE WHEN {y} < 0.5 THEN {y} ELSE 1 - {y} END))"
    r0, r1, r2 = f"(0.180625 - {q} * {q})", f"({t} - 1.6)", f"({t} - 5.0)"
    floor = 5.199337582290661
    return (
        f"CASE WHEN {y} <= {NORMAL_BOUND} THEN -{floor}::DOUBLE WHEN {y} >= 1 - {NORMAL_BOUND} THEN {floor}::DOUBLE "
        f"WHEN abs({q}) <= 0.425 THEN {q} * {_poly_sql(CENTRE_NUM, r0)} / {_poly_sql(CENTRE_DEN, r0)} "
        f"WHEN {t} <= 5 THEN sign({q}) * {_poly_sql(MIDDLE_NUM, r1)} / {_poly_sql(MIDDLE_DEN, r1)} "
        f"ELSE sign({q}) * {_poly_sql(TAIL_NUM, r2)} / {_poly_sql(TAIL_DEN, r2)} END"
    )


@query(
    "norm_qnormal",
    _KNOTS + f"SELECT x.row_id, split, round({_probit_sql('yq.y')}, 4) AS qty, round({_probit_sql('yp.y')}, 4) AS price "
    "FROM x JOIN y_qty yq ON x.row_id = yq.row_id JOIN y_price yp ON x.row_id = yp.row_id",
)
def norm_qnormal(spark, sf):
    return _normed(spark, sf, "quantile_normal", 4, _TWO)


def _yeo_sql(x: str, lam: str) -> str:
    return (
        f"CASE WHEN {x} >= 0 THEN CASE WHEN abs({lam}) < 1e-9 THEN ln(1 + {x}) ELSE (exp({lam} * ln(1 + greatest({x}, 0))) - 1) / {lam} END "
        f"ELSE CASE WHEN abs(2 - {lam}) < 1e-9 THEN -ln(1 - {x}) ELSE -(exp((2 - {lam}) * ln(1 + greatest(-{x}, 0))) - 1) / (2 - {lam}) END END"
    )


def _power_sql(columns: list[str], steps: list[float]) -> str:
    parts = [FILLED]
    for c in columns:
        parts.append(f"l_{c}_0 AS (SELECT 0.0::DOUBLE AS lam)")
        for turn, step in enumerate(steps):
            reach = 10 if turn == 0 else 5
            parts.append(
                f"l_{c}_{turn + 1} AS (SELECT g.lam FROM (SELECT j, round(lam + j * {step!r}::DOUBLE, 9) AS lam FROM l_{c}_{turn}, range(-{reach}, {reach + 1}) r(j)) g, "
                f"(SELECT {c} AS v FROM x WHERE {SAMPLE}) GROUP BY g.j, g.lam "
                f"ORDER BY -count(*) / 2.0 * ln(var_pop({_yeo_sql('v', 'g.lam')})) + (g.lam - 1) * sum(sign(v) * ln(1 + abs(v))) DESC, g.j LIMIT 1)"
            )
        last = f"l_{c}_{len(steps)}"
        parts.append(f"s_{c} AS (SELECT any_value(lam) AS lam, avg({_yeo_sql(c, 'lam')}) AS m, stddev_pop({_yeo_sql(c, 'lam')}) AS d FROM x, {last} WHERE {SAMPLE})")
    cells = ", ".join(f"round(({_yeo_sql(c, f's_{c}.lam')} - s_{c}.m) / s_{c}.d, 4) AS {c}" for c in columns)
    return f"WITH {', '.join(parts)} SELECT row_id, split, {cells} FROM x, {', '.join(f's_{c}' for c in columns)}"


@query("norm_power", _power_sql(["qty", "price"], [0.5 / 5**i for i in range(7)]))
def norm_power(spark, sf):
    return _normed(spark, sf, "power", 4, _TWO)


# --- extraction -----------------------------------------------------------------------------------

EXTRACT_DEGREE = 0.5
AMOUNTS = ["l_quantity AS qty", "l_quantity * l_extendedprice / 1000 AS amount"]
AMOUNTS_SQL = "l_quantity AS qty, l_quantity * l_extendedprice / 1000 AS amount"


def _extracted(spark, sf, method, columns, digits=6, label=None, **options):
    df = lines(spark, sf, *columns)
    done = FeatureExtraction(method, degree=EXTRACT_DEGREE, label=label, **options).fit(df).transform(df)
    return rounded(done.drop("row_hash"), digits)


_Z = (
    f"WITH b AS ({lines_sql(AMOUNTS_SQL)}), st AS (SELECT avg(qty) AS mq, stddev_pop(qty) AS dq, avg(amount) AS ma, stddev_pop(amount) AS da FROM b WHERE {SAMPLE}), "
    "z AS (SELECT row_id, split, (qty - mq) / dq AS zq, (amount - ma) / da AS za FROM b, st) "
)


@query("ext_pca", _Z + "SELECT row_id, split, round((zq + za) / sqrt(2), 5) AS \"PC1\", round((zq - za) / sqrt(2), 5) AS \"PC2\" FROM z")
def ext_pca(spark, sf):
    return _extracted(spark, sf, "pca", AMOUNTS, 5)


@query("ext_pca_k", _Z + "SELECT row_id, split, round((zq + za) / sqrt(2), 5) AS incremental_pca_1, round((zq - za) / sqrt(2), 5) AS incremental_pca_2 FROM z")
def ext_pca_k(spark, sf):
    return _extracted(spark, sf, "incremental_pca", AMOUNTS, 5)


@query("ext_pca_strict", _Z + "SELECT row_id, split, round((zq + za) / sqrt(2), 5) AS pca_arpack_1 FROM z")
def ext_pca_strict(spark, sf):
    return _extracted(spark, sf, "pca_arpack", AMOUNTS, 5)


@query("ext_pca_randomized", _Z + "SELECT row_id, split, round((zq + za) / sqrt(2), 5) AS pca_randomized_1, round((zq - za) / sqrt(2), 5) AS pca_randomized_2 FROM z")
def ext_pca_randomized(spark, sf):
    return _extracted(spark, sf, "pca_randomized", AMOUNTS, 5)


@query(
    "ext_svd",
    f"""WITH b AS ({lines_sql(AMOUNTS_SQL)}), st AS (SELECT stddev_pop(qty) AS dq, stddev_pop(amount) AS da FROM b WHERE {SAMPLE}),
    s AS (SELECT row_id, split, d2, qty / dq AS q, amount / da AS a FROM b, st),
    g AS (SELECT avg(q * q) AS qq, avg(a * a) AS aa, avg(q * a) AS qa FROM s WHERE {SAMPLE}),
    t AS (SELECT 0.5 * atan2(2 * qa, qq - aa) AS t FROM g)
    SELECT row_id, split, round(cos(t) * q + sin(t) * a, 5) AS "SVD1" FROM s, t""",
)
def ext_svd(spark, sf):
    return _extracted(spark, sf, "truncated_svd", AMOUNTS, 5)


@query(
    "ext_cfs",
    f"""WITH b AS ({lines_sql(NUMBERS_SQL + ', l_quantity * l_extendedprice / 1000 AS amount')}),
    r AS (SELECT unnest(['qty', 'price', 'disc', 'tax']) AS column_name,
      unnest([corr(qty, amount), corr(price, amount), corr(disc, amount), corr(tax, amount)]) AS r, count(*) AS n FROM b WHERE {SAMPLE}),
    f AS (SELECT column_name, r * r / (1 - r * r) * (n - 2) AS score FROM r)
    SELECT column_name, round(score, 4) AS score, score >= 0.3 * max(score) OVER () AS kept FROM f""",
)
def ext_cfs(spark, sf):
    df = lines(spark, sf, *NUMBERS, "l_quantity * l_extendedprice / 1000 AS amount")
    model = FeatureExtraction("cfs", degree=EXTRACT_DEGREE, label="amount").fit(df)
    return _scores(spark, model, 4)


def _scores(spark, model, digits):
    rows = [(c, None if v is None else v, k) for c, v, k in score_table(model)]
    return rounded(spark.createDataFrame(rows, "column_name string, score double, kept boolean"), digits)


PRODUCTS = ["l_quantity AS qty", "l_discount AS disc", "l_tax AS tax"]


@query(
    "ext_poly",
    f"""SELECT row_id, split, round(qty, 8) AS qty, round(disc, 8) AS disc, round(tax, 8) AS tax, round(qty * qty, 8) AS "qty^2",
    round(qty * disc, 8) AS "qty disc", round(qty * tax, 8) AS "qty tax", round(disc * disc, 8) AS "disc^2",
    round(disc * tax, 8) AS "disc tax", round(tax * tax, 8) AS "tax^2" FROM ({lines_sql(NUMBERS_SQL)})""",
)
def ext_poly(spark, sf):
    return _extracted(spark, sf, "polynomial", PRODUCTS, 8)


@query(
    "ext_interaction",
    f"""SELECT row_id, split, round(qty, 8) AS qty, round(disc, 8) AS disc, round(tax, 8) AS tax,
    round(qty * disc, 8) AS "qty disc", round(qty * tax, 8) AS "qty tax", round(disc * tax, 8) AS "disc tax" FROM ({lines_sql(NUMBERS_SQL)})""",
)
def ext_interaction(spark, sf):
    return _extracted(spark, sf, "interaction", PRODUCTS, 8)


@query("ext_kernel_pca")
def ext_kernel_pca(spark, sf):
    return _extracted(spark, sf, "kernel_pca", NUMBERS, 6)


def _tree_sql(trees: int) -> str:
    """Two levels of random splits: the drawn column and point of each node as the estimator draws them."""


    def unit(*parts) -> float:
        return int(hashlib.md5(":".join(str(p) for p in (0, *parts)).encode()).hexdigest()[:8], 16) / 2**32

    cells, ctes, leaf = [], [f"b AS ({lines_sql(NUMBERS_SQL)})"], 0
    for t in range(trees):
        name = {n: FOUR[int(unit("column", t, n) * 4)] for n in (1, 2, 3)}
        point = {n: repr(unit("point", t, n)) + "::DOUBLE" for n in (1, 2, 3)}
        ctes.append(f"a{t} AS (SELECT min({name[1]}) + {point[1]} * (max({name[1]}) - min({name[1]})) AS c FROM b WHERE {SAMPLE})")
        ctes.append(
            f"c{t} AS (SELECT min(CASE WHEN {name[1]} <= c THEN {name[2]} END) AS ll, max(CASE WHEN {name[1]} <= c THEN {name[2]} END) AS lh, "
            f"min(CASE WHEN {name[1]} > c THEN {name[3]} END) AS rl, max(CASE WHEN {name[1]} > c THEN {name[3]} END) AS rh, any_value(c) AS c FROM b, a{t} WHERE {SAMPLE})"
        )
        left, right = f"c{t}.ll + {point[2]} * (c{t}.lh - c{t}.ll)", f"c{t}.rl + {point[3]} * (c{t}.rh - c{t}.rl)"
        for side, n, cut in (("<=", 2, left), (">", 3, right)):
            for under in ("<=", ">"):
                leaf += 1
                cells.append(f"CASE WHEN {name[1]} {side} c{t}.c AND {name[n]} {under} {cut} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"RTE{leaf}\"")
    return f"WITH {', '.join(ctes)} SELECT row_id, split, {', '.join(cells)} FROM b, {', '.join(f'c{t}' for t in range(trees))}"


@query("ext_rte", _tree_sql(4))
def ext_rte(spark, sf):
    return _extracted(spark, sf, "random_trees_embedding", NUMBERS, 6, random_tree_estimators=4, random_tree_depth=2)


# --- selection ------------------------------------------------------------------------------------

# amount repeats quantity and price, so the correlation filter drops it
SELECT_FROM = [*GAPS, "l_quantity * l_extendedprice / 1000 AS amount"]
SELECT_SQL = GAPS_SQL + ", l_quantity * l_extendedprice / 1000 AS amount"
FIVE = [*FOUR, "amount"]


def _selected(spark, sf, method, digits, columns=SELECT_FROM, label=None, **options):
    df = lines(spark, sf, *columns)
    return _scores(spark, FeatureSelection(method, degree=0.5, label=label, **options).fit(df), digits)


@query(
    "sel_lc",
    f"""WITH b AS ({lines_sql(SELECT_SQL)}), p AS ({" UNION ALL ".join(
        f"SELECT '{FIVE[j]}' AS column_name, abs(corr({FIVE[i]}, {FIVE[j]})) AS r FROM b WHERE {SAMPLE}" for j in range(5) for i in range(j))}
    UNION ALL SELECT 'qty', 0.0)
    SELECT column_name, round(max(r), 6) AS score, max(r) <= 0.3 AS kept FROM p GROUP BY 1""",
)
def sel_lc(spark, sf):
    return _selected(spark, sf, "LC", 6)


@query(
    "sel_var",
    f"""WITH b AS ({lines_sql(SELECT_SQL)}), s AS (SELECT unnest({FIVE}) AS column_name,
    unnest([{", ".join(f"stddev_samp({c})" for c in FIVE)}]) AS d FROM b WHERE {SAMPLE})
    SELECT column_name, round(d, 6) AS score, d >= (SELECT quantile_cont(d, 0.3) FROM s) AS kept FROM s""",
)
def sel_var(spark, sf):
    return _selected(spark, sf, "VAR", 6)


@query(
    "sel_mr",
    f"""WITH b AS ({lines_sql("l_quantity AS qty, nullif(l_discount, 0.0) AS disc, CASE WHEN l_tax < 0.04 THEN NULL ELSE l_tax END AS tax")}),
    s AS (SELECT unnest(['qty', 'disc', 'tax']) AS column_name, unnest([avg((qty IS NULL)::INT), avg((disc IS NULL)::INT), avg((tax IS NULL)::INT)]) AS r FROM b WHERE {SAMPLE})
    SELECT column_name, round(r, 8) AS score, r <= 0.3 AS kept FROM s""",
)
def sel_mr(spark, sf):
    columns = ["l_quantity AS qty", "nullif(l_discount, 0.0D) AS disc", "CASE WHEN l_tax < 0.04D THEN NULL ELSE l_tax END AS tax"]
    return _selected(spark, sf, "MR", 8, columns)


def _chi_sql() -> str:
    dims = range(64)
    return f"""WITH b AS ({EMB_SQL}), x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM b WHERE split = 'train'),
    m AS (SELECT i, min(v) AS lo, sum(v) - min(v) * count(*) AS whole, count(*) AS n FROM x GROUP BY i),
    o AS (SELECT label, i, sum(v - lo) AS o, count(*) AS k FROM x JOIN m USING (i) GROUP BY label, i),
    s AS (SELECT i, sum((o - whole * k / n) * (o - whole * k / n) / (whole * k / n)) AS score FROM o JOIN m USING (i) GROUP BY i)
    SELECT 'f' || i AS column_name, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, i) <= 10 AS kept FROM s WHERE i < {len(dims)}"""


@query("sel_wr", _chi_sql())
def sel_wr(spark, sf):
    df = embeddings(spark, sf)
    return _scores(spark, FeatureSelection("WR", label="label").fit(df), 6)


@query("sel_tree")
def sel_tree(spark, sf):
    df = embeddings(spark, sf)
    return FeatureSelection("Tree", label="label").fit(df).transform(df).drop("row_hash")


@query("sel_svc")
def sel_svc(spark, sf):
    df = embeddings(spark, sf)
    return FeatureSelection("SVC", label="label").fit(df).transform(df).drop("row_hash")


