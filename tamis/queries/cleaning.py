"""Duplicates, missing values, encoding and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.keys import threshold
from tamis.operators.dedup import DuplicateDetection
from tamis.operators.encode import FeatureEncoding
from tamis.operators.impute import Imputation
from tamis.operators.outlier import OutlierDetection
from tamis.queries.registry import (
    EVENT_NUMBERS,
    EVENT_NUMBERS_SQL,
    FOUR,
    GAPS,
    GAPS_SQL,
    HALF,
    NUMBERS,
    NUMBERS_SQL,
    events,
    events_sql,
    keyed_sql,
    lines,
    lines_sql,
    query,
    read,
    rounded,
)
from tamis.sources.tables import keyed

# --- duplicates -----------------------------------------------------------------------------------

COARSE = ["event_type", "user_id", "floor(value) AS v"]


@query(
    "dedup_exact",
    f"""WITH b AS ({events_sql('event_type, user_id, cast(floor(value) AS BIGINT) AS v')}),
    s AS (SELECT min(row_id) AS row_id FROM b WHERE d2 < {threshold(0.6)} GROUP BY split, event_type, user_id, v)
    SELECT row_id, split, event_type, user_id, v FROM b WHERE d2 >= {threshold(0.6)} OR row_id IN (SELECT row_id FROM s)""",
)
def dedup_exact(spark, sf):
    df = events(spark, sf, *COARSE)
    return DuplicateDetection("ED", degree=0.6).fit(df).transform(df).drop("row_hash")


@query(
    "dedup_approx",
    f"""WITH b AS ({events_sql('event_type, user_id, value')}),
    m AS (SELECT split, min(user_id) AS ul, max(user_id) AS uh, min(value) AS vl, max(value) AS vh FROM b WHERE d2 < {threshold(0.6)} GROUP BY split),
    k AS (SELECT b.*, round_even((user_id - ul) / greatest(cast(uh - ul AS DOUBLE) * 0.001::DOUBLE, 1e-12), 0) AS ku,
      round_even((value - vl) / greatest((vh - vl) * 0.001::DOUBLE, 1e-12), 0) AS kv, regexp_replace(lower(event_type), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM b JOIN m USING (split)),
    s AS (SELECT min(row_id) AS row_id FROM k WHERE d2 < {threshold(0.6)} GROUP BY split, ku, kv, CASE WHEN t = '' THEN '=' || event_type ELSE t END)
    SELECT row_id, split, event_type, user_id, value FROM b WHERE d2 >= {threshold(0.6)} OR row_id IN (SELECT row_id FROM s)""",
)
def dedup_approx(spark, sf):
    df = events(spark, sf, "event_type", "user_id", "value")
    return DuplicateDetection("AD", degree=0.6).fit(df).transform(df).drop("row_hash")


@query(
    "dedup_approx_docs",
    f"""WITH b AS ({keyed_sql('documents', 'doc_id', 'text, lang')}),
    k AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t, regexp_replace(lower(lang), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS l FROM b)
    SELECT min(row_id) AS row_id, split FROM k
    GROUP BY split, CASE WHEN t = '' THEN '=' || text ELSE t END, CASE WHEN l = '' THEN '=' || lang ELSE l END""",
)
def dedup_approx_docs(spark, sf):
    df = keyed(read(spark, sf, "documents"), ["doc_id"]).select("row_id", "row_hash", "split", "text", "lang")
    return DuplicateDetection("AD").fit(df).transform(df).select("row_id", "split")


# --- missing values -------------------------------------------------------------------------------

IMPUTE_DEGREE = 0.7
IN_S = f"d2 < {threshold(IMPUTE_DEGREE)}"
WHOLE = "disc IS NOT NULL AND tax IS NOT NULL"
SHOWN = ["row_id", "split", *FOUR]


def _imputed(spark, sf, method, digits=6, columns=GAPS, shown=SHOWN, **options):
    df = lines(spark, sf, *columns)
    return rounded(Imputation(method, degree=IMPUTE_DEGREE, **options).fit(df).transform(df).select(*shown), digits)


def _fill_sql(stats: str) -> str:
    return f"""WITH b AS ({lines_sql(GAPS_SQL)}), m AS (SELECT {stats} FROM b WHERE split = 'train' AND {IN_S})
    SELECT row_id, split, qty, price, round(coalesce(disc, md), 6) AS disc, round(coalesce(tax, mt), 6) AS tax
    FROM b, m WHERE {IN_S} OR ({WHOLE})"""


@query("imp_drop", f"SELECT row_id, split, qty, price, disc, tax FROM ({lines_sql(GAPS_SQL)}) WHERE {WHOLE}")
def imp_drop(spark, sf):
    return _imputed(spark, sf, "DROP")


@query("imp_mean", _fill_sql("avg(disc) AS md, avg(tax) AS mt"))
def imp_mean(spark, sf):
    return _imputed(spark, sf, "MEAN")


@query("imp_median", _fill_sql("median(disc) AS md, median(tax) AS mt"))
def imp_median(spark, sf):
    return _imputed(spark, sf, "MEDIAN")


@query(
    "imp_mf",
    f"""WITH b AS ({events_sql("value, nullif(event_type, 'view') AS kind, CASE WHEN user_id >= 120 THEN NULL ELSE user_id END AS user_id")}),
    s AS (SELECT * FROM b WHERE split = 'train' AND {IN_S}),
    k AS (SELECT kind AS v FROM s WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
    u AS (SELECT user_id AS v FROM s WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)
    SELECT row_id, split, value, coalesce(kind, k.v) AS kind, coalesce(user_id, u.v) AS user_id FROM b, k, u
    WHERE {IN_S} OR (kind IS NOT NULL AND user_id IS NOT NULL)""",
)
def imp_mf(spark, sf):
    df = events(spark, sf, "value", "nullif(event_type, 'view') AS kind", "CASE WHEN user_id >= 120 THEN NULL ELSE user_id END AS user_id")
    return Imputation("MF", degree=IMPUTE_DEGREE).fit(df).transform(df).drop("row_hash")


@query(
    "imp_dummy",
    f"""SELECT row_id, split, coalesce(value, -1.0) AS value, coalesce(kind, 'dummy_category') AS kind
    FROM ({events_sql("CASE WHEN user_id < 20 THEN NULL ELSE value END AS value, nullif(event_type, 'view') AS kind")})
    WHERE {IN_S} OR (kind IS NOT NULL AND value IS NOT NULL)""",
)
def imp_dummy(spark, sf):
    df = events(spark, sf, "CASE WHEN user_id < 20 THEN NULL ELSE value END AS value", "nullif(event_type, 'view') AS kind")
    return Imputation("DUMMY", degree=IMPUTE_DEGREE).fit(df).transform(df).drop("row_hash")


# k is missing for errors, the value for the lowest k
KNN_COLUMNS = [
    "CASE WHEN cast(get_json_object(props, '$.k') AS double) < 8 THEN NULL ELSE value END AS value",
    "cast(user_id AS double) AS user",
    "CASE WHEN event_type = 'error' THEN NULL ELSE cast(get_json_object(props, '$.k') AS double) END AS k",
]
_K = "cast(json_extract_string(props, '$.k') AS DOUBLE)"
KNN_SQL = (
    f"CASE WHEN {_K} < 8 THEN NULL ELSE value END AS value, cast(user_id AS DOUBLE) AS user, "
    f"CASE WHEN event_type = 'error' THEN NULL ELSE {_K} END AS k"
)


def _knn_want(c: str, i: int) -> str:
    return f"""n{i} AS (SELECT qid, avg(v) AS v FROM (SELECT q.row_id AS qid, d.{c} AS v, row_number() OVER (PARTITION BY q.row_id ORDER BY
      (CASE WHEN q.value IS NULL OR d.value IS NULL THEN 0.0 ELSE (q.value - d.value) * (q.value - d.value) END
       + (q.user - d.user) * (q.user - d.user)
       + CASE WHEN q.k IS NULL OR d.k IS NULL THEN 0.0 ELSE (q.k - d.k) * (q.k - d.k) END)
      * (3.0::DOUBLE / (1 + (q.value IS NOT NULL AND d.value IS NOT NULL)::INT + (q.k IS NOT NULL AND d.k IS NOT NULL)::INT)), d.row_id) AS r
      FROM q JOIN d ON d.{c} IS NOT NULL AND q.{c} IS NULL) WHERE r <= 4 GROUP BY qid)"""


@query(
    "imp_knn",
    f"""WITH b AS ({events_sql(KNN_SQL)}), d AS (SELECT * FROM b WHERE split = 'train' AND {IN_S}),
    q AS (SELECT * FROM b WHERE {IN_S} AND (value IS NULL OR k IS NULL)), {_knn_want('value', 0)}, {_knn_want('k', 1)}
    SELECT row_id, split, round(coalesce(value, n0.v), 6) AS value, user, round(coalesce(k, n1.v), 6) AS k
    FROM b LEFT JOIN n0 ON b.row_id = n0.qid LEFT JOIN n1 ON b.row_id = n1.qid
    WHERE {IN_S} OR (value IS NOT NULL AND k IS NOT NULL)""",
)
def imp_knn(spark, sf):
    df = events(spark, sf, *KNN_COLUMNS)
    done = Imputation("KNN", degree=IMPUTE_DEGREE).fit(df).transform(df)
    return rounded(done.drop("row_hash"), 6)


# the amount follows the quantity; it is missing where the tax is 0.08
PAIR = ["l_quantity AS qty", "CASE WHEN l_tax = 0.08D THEN NULL ELSE l_quantity * floor(l_extendedprice / 100) END AS amount"]
PAIR_SQL = "l_quantity AS qty, CASE WHEN l_tax = 0.08 THEN NULL ELSE l_quantity * floor(l_extendedprice / 100) END AS amount"


def _em_sql(rounds: int) -> str:
    steps = [
        f"b AS ({lines_sql(PAIR_SQL)})",
        f"s AS (SELECT qty AS q, amount AS a FROM b WHERE split = 'train' AND {IN_S})",
        "r0 AS (SELECT avg(q) AS mq, avg(a) AS ma FROM s)",
        "c0 AS (SELECT mq, ma, var_samp(q) + 1e-6 AS vq, covar_samp(q, coalesce(a, ma)) AS cqa FROM s, r0 GROUP BY mq, ma)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"c{i} AS (SELECT avg(q) AS mq, avg(f) AS ma, var_samp(q) + 1e-6 AS vq, covar_samp(q, f) AS cqa "
            f"FROM (SELECT q, coalesce(a, ma + cqa / vq * (q - mq)) AS f FROM s, c{i - 1}))"
        )
    return (
        "WITH " + ", ".join(steps) + f" SELECT row_id, split, qty, round(coalesce(amount, ma + cqa / vq * (qty - mq)), 2) AS amount "
        f"FROM b, c{rounds} WHERE {IN_S} OR amount IS NOT NULL"
    )


@query("imp_em", _em_sql(10))
def imp_em(spark, sf):
    return _imputed(spark, sf, "EM", 2, PAIR, ["row_id", "split", "qty", "amount"])


@query(
    "imp_mice",
    f"""WITH RECURSIVE b AS ({lines_sql(PAIR_SQL)}),
    g AS (SELECT count(*) AS n, avg(qty) AS mx, avg(amount) AS my, var_pop(qty) * count(*) AS xx, covar_pop(qty, amount) * count(*) AS xy,
      var_pop(amount) * count(*) AS yy FROM b WHERE split = 'train' AND {IN_S} AND amount IS NOT NULL),
    it(t, w, lam, alpha, done) AS (
      SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 1.0 / (yy / n + 2.220446049250313e-16), false FROM g
      UNION ALL
      SELECT t + 1, v, (gam + 2e-6) / (v * v + 2e-6), (n - gam + 2e-6) / (greatest(yy - 2 * v * xy + v * v * xx, 0) + 2e-6), t > 0 AND abs(w - v) < 1e-3
      FROM (SELECT *, xy / (xx + lam / alpha) AS v, alpha * xx / (lam + alpha * xx) AS gam FROM it, g) WHERE NOT done AND t < 300),
    f AS (SELECT xy / (xx + lam / alpha) AS w FROM it, g WHERE t = (SELECT max(t) FROM it))
    SELECT row_id, split, qty, round(coalesce(amount, my - mx * w + w * qty), 2) AS amount FROM b, g, f WHERE {IN_S} OR amount IS NOT NULL""",
)
def imp_mice(spark, sf):
    return _imputed(spark, sf, "MICE", 2, PAIR, ["row_id", "split", "qty", "amount"])


@query("imp_dt")
def imp_dt(spark, sf):
    return _imputed(spark, sf, "DT", 2, PAIR, ["row_id", "split", "qty", "amount"])


# --- encoding -------------------------------------------------------------------------------------

ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
ORDER_SQL = keyed_sql("orders", "o_orderkey", "o_orderstatus, o_orderpriority, o_totalprice")


def _orders(spark, sf):
    return keyed(read(spark, sf, "orders"), ["o_orderkey"]).select("row_id", "row_hash", "split", *ORDER_TEXTS, "o_totalprice")


def _level_sql(c: str, expr: str, where: str = f"split = 'train' AND d2 < {HALF}") -> str:
    return f"SELECT {c} AS v, {expr} AS x FROM b WHERE {where} GROUP BY {c}"


@query(
    "enc_ordinal",
    f"""WITH b AS ({ORDER_SQL}), s AS ({_level_sql('o_orderstatus', 'cast(row_number() OVER (ORDER BY min(row_id)) AS INT)')}),
    p AS ({_level_sql('o_orderpriority', 'cast(row_number() OVER (ORDER BY min(row_id)) AS INT)')})
    SELECT row_id, split, coalesce(p.x, -1) AS o_orderpriority, coalesce(s.x, -1) AS o_orderstatus, o_totalprice
    FROM b LEFT JOIN s ON o_orderstatus = s.v LEFT JOIN p ON o_orderpriority = p.v""",
)
def enc_ordinal(spark, sf):
    df = _orders(spark, sf)
    return FeatureEncoding("ordinal", degree=0.5).fit(df).transform(df).drop("row_hash")


@query(
    "enc_onehot",
    f"""WITH b AS ({ORDER_SQL}), s AS ({_level_sql('o_orderstatus', 'row_number() OVER (ORDER BY min(row_id))')}),
    p AS ({_level_sql('o_orderpriority', 'row_number() OVER (ORDER BY min(row_id))')})
    SELECT row_id, split, """
    + ", ".join(f"cast(coalesce(p.x, -1) = {i} AS INT) AS o_orderpriority_{i}" for i in range(1, 6)) + ", "
    + ", ".join(f"cast(coalesce(s.x, -1) = {i} AS INT) AS o_orderstatus_{i}" for i in range(1, 4))
    + ", o_totalprice FROM b LEFT JOIN s ON o_orderstatus = s.v LEFT JOIN p ON o_orderpriority = p.v",
)
def enc_onehot(spark, sf):
    df = _orders(spark, sf)
    return FeatureEncoding("onehot", degree=0.5).fit(df).transform(df).drop("row_hash")


@query(
    "enc_count",
    f"""WITH b AS ({keyed_sql('part', 'p_partkey', 'p_name, p_brand, p_size')}),
    n AS ({_level_sql('p_name', 'count(*)', f"split = 'train' AND d2 < {threshold(0.2)}")}),
    r AS ({_level_sql('p_brand', 'count(*)', f"split = 'train' AND d2 < {threshold(0.2)}")})
    SELECT row_id, split, coalesce(r.x, 0) AS p_brand, coalesce(n.x, 0) AS p_name, p_size FROM b LEFT JOIN n ON p_name = n.v LEFT JOIN r ON p_brand = r.v""",
)
def enc_count(spark, sf):
    df = keyed(read(spark, sf, "part"), ["p_partkey"]).select("row_id", "row_hash", "split", "p_name", "p_brand", "p_size")
    return FeatureEncoding("count", degree=0.2).fit(df).transform(df).drop("row_hash")


_BLEND = "prior * (1 - 1 / (1 + exp(-(count(*) - 20) / 10.0))) + avg(o_totalprice) * (1 / (1 + exp(-(count(*) - 20) / 10.0)))"


@query(
    "enc_target",
    f"""WITH b AS ({ORDER_SQL}), m AS (SELECT avg(o_totalprice) AS prior FROM b WHERE split = 'train' AND d2 < {HALF}),
    s AS (SELECT o_orderstatus AS v, {_BLEND} AS x FROM b, m WHERE split = 'train' AND d2 < {HALF} GROUP BY o_orderstatus, prior),
    p AS (SELECT o_orderpriority AS v, {_BLEND} AS x FROM b, m WHERE split = 'train' AND d2 < {HALF} GROUP BY o_orderpriority, prior)
    SELECT row_id, split, o_totalprice, round(coalesce(p.x, prior), 4) AS o_orderpriority, round(coalesce(s.x, prior), 4) AS o_orderstatus
    FROM b CROSS JOIN m LEFT JOIN s ON o_orderstatus = s.v LEFT JOIN p ON o_orderpriority = p.v""",
)
def enc_target(spark, sf):
    df = _orders(spark, sf)
    done = FeatureEncoding("target", degree=0.5, label="o_totalprice").fit(df).transform(df).drop("row_hash")
    return rounded(done, {"o_orderpriority": 4, "o_orderstatus": 4}, ["o_totalprice"])


@query(
    "enc_high_card",
    f"""WITH b AS ({keyed_sql('customer', 'c_custkey', 'c_name, c_mktsegment, c_acctbal')}),
    m AS ({_level_sql('c_mktsegment', 'cast(row_number() OVER (ORDER BY min(row_id)) AS INT)', "split = 'train'")})
    SELECT row_id, split, c_acctbal, coalesce(x, -1) AS c_mktsegment FROM b LEFT JOIN m ON c_mktsegment = v""",
)
def enc_high_card(spark, sf):
    df = keyed(read(spark, sf, "customer"), ["c_custkey"]).select("row_id", "row_hash", "split", "c_name", "c_mktsegment", "c_acctbal")
    return FeatureEncoding("ordinal").fit(df).transform(df).drop("row_hash")


# --- outliers -------------------------------------------------------------------------------------

EVENT_COLUMNS = ["value", "user", "k"]


@query(
    "out_zsb",
    f"""WITH b AS ({lines_sql(NUMBERS_SQL)}),
    m AS (SELECT split, {", ".join(f"median({c}) AS m_{c}" for c in FOUR)} FROM b WHERE {IN_S} GROUP BY split),
    a AS (SELECT split, {", ".join(f"1.4296 * median(abs({c} - m_{c})) AS a_{c}" for c in FOUR)} FROM b JOIN m USING (split) WHERE {IN_S} GROUP BY split)
    SELECT row_id, split, qty, price, disc, tax FROM b JOIN m USING (split) JOIN a USING (split)
    WHERE NOT ({IN_S} AND ({" + ".join(f"(CASE WHEN a_{c} > 0 THEN abs({c} - m_{c}) / a_{c} > 1.6 ELSE {c} <> m_{c} END)::INT" for c in FOUR)}) / 4.0 > 0.3)""",
)
def out_zsb(spark, sf):
    df = lines(spark, sf, *NUMBERS)
    return OutlierDetection("ZSB", degree=IMPUTE_DEGREE).fit(df).transform(df).drop("row_hash")


def _iqr_sql(weight) -> str:
    flags = [f"CASE WHEN {c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}) THEN {weight(c)} ELSE 0.0 END" for c in EVENT_COLUMNS]
    quartiles = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in EVENT_COLUMNS)
    return f"""WITH b AS ({events_sql(EVENT_NUMBERS_SQL)}), q AS (SELECT split, {quartiles} FROM b WHERE {IN_S} GROUP BY split)
    SELECT row_id, split, value, user, k FROM b JOIN q USING (split) WHERE NOT ({IN_S} AND ({" + ".join(flags)}) / 3.0 > 0.3)"""


@query("out_iqr", _iqr_sql(lambda c: c))
def out_iqr(spark, sf):
    df = events(spark, sf, *EVENT_NUMBERS)
    return OutlierDetection("IQR", degree=IMPUTE_DEGREE).fit(df).transform(df).drop("row_hash")


@query("out_iqr_fraction", _iqr_sql(lambda c: "1.0"))
def out_iqr_fraction(spark, sf):
    df = events(spark, sf, *EVENT_NUMBERS)
    return OutlierDetection("IQR", degree=IMPUTE_DEGREE, iqr_mode="fraction").fit(df).transform(df).drop("row_hash")


def _mad_sql() -> str:
    centre = ", ".join(f"median({c}) AS m_{c}, avg({c}) AS a_{c}" for c in EVENT_COLUMNS)
    spread = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in EVENT_COLUMNS)
    cells = ", ".join(
        f"round(CASE WHEN {IN_S} AND d_{c} > 0 AND ({c} < m_{c} - 2.5 * d_{c} OR {c} > m_{c} + 2.5 * d_{c}) THEN a_{c} ELSE {c} END, 4) AS {c}"
        for c in EVENT_COLUMNS
    )
    return f"""WITH b AS ({events_sql(EVENT_NUMBERS_SQL)}), m AS (SELECT {centre} FROM b WHERE split = 'train' AND {IN_S}),
    d AS (SELECT {spread} FROM b, m WHERE split = 'train' AND {IN_S}) SELECT row_id, split, {cells} FROM b, m, d"""


@query("out_mad", _mad_sql())
def out_mad(spark, sf):
    df = events(spark, sf, *EVENT_NUMBERS)
    return rounded(OutlierDetection("MAD", degree=IMPUTE_DEGREE).fit(df).transform(df).drop("row_hash"), 4)


def embeddings(spark, sf, dims: int = 64):
    raw = keyed(read(spark, sf, "embeddings"), ["vec_id"])
    return raw.select("row_id", "row_hash", "split", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dims)])


EMB_SQL = keyed_sql("embeddings", "vec_id", "embedding, label")


@query(
    "out_lof",
    f"""WITH b AS ({EMB_SQL}), x AS (SELECT row_id, split, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM b),
    st AS (SELECT i, median(x) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s FROM x WHERE split = 'train' GROUP BY i),
    z AS (SELECT row_id, split, i, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM x JOIN st USING (i)),
    u AS (SELECT row_id, split, list(z ORDER BY i) AS z, sqrt(sum(z * z)) AS len FROM z GROUP BY row_id, split),
    t AS (SELECT * FROM u WHERE split = 'train'), n AS (SELECT 20 AS k),
    pr AS (SELECT a.row_id AS q, c.row_id AS d, 1 - list_inner_product(a.z, c.z) / (a.len * c.len) AS dist FROM u a, t c),
    tr AS (SELECT q, d, dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, d) AS r FROM pr WHERE q <> d AND q IN (SELECT row_id FROM t)), n WHERE r <= k),
    kd AS (SELECT q AS id, max(dist) AS kdist FROM tr GROUP BY q),
    lr AS (SELECT q AS id, 1 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM tr JOIN kd ON d = id GROUP BY q),
    lf AS (SELECT q, avg(lr.lrd) / any_value(o.lrd) AS lof FROM tr JOIN lr ON d = lr.id JOIN lr o ON q = o.id GROUP BY q),
    cut AS (SELECT quantile_cont(-lof, 0.3) AS c FROM lf),
    al AS (SELECT q, d, dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, d) AS r FROM pr), n WHERE r <= k),
    sc AS (SELECT q, avg(lr.lrd) * (avg(greatest(dist, kdist)) + 1e-10) AS lof FROM al JOIN lr ON d = lr.id JOIN kd ON d = kd.id GROUP BY q)
    SELECT row_id, split FROM b JOIN sc ON row_id = q, cut WHERE NOT (-lof < c)""",
)
def out_lof(spark, sf):
    df = embeddings(spark, sf).drop("label")
    return OutlierDetection("LOF").fit(df).transform(df).select("row_id", "split")
