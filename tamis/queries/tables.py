"""Sources, schema operators, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.keys import in_sample, threshold, with_row_keys
from tamis.functions.schema import align_union, coerce_number, compact_view, drop_non_numeric, no_nulls, null_nans
from tamis.operators.convert import convert
from tamis.operators.split import cv_folds, degree_sample, divide, stratified_holdout
from tamis.plans.profile import class_profile, first_appearance_codes, numeric_profile, split_stats
from tamis.plans.space import draw_plans, method_options, sample_combos
from tamis.queries.registry import (
    FOUR,
    GAPS,
    GAPS_SQL,
    events,
    events_sql,
    hex_sql,
    keyed_sql,
    lines,
    lines_sql,
    query,
    read,
    rounded,
    seeded_sql,
)
from tamis.sources.tables import keyed

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "scan_profile",
    "SELECT count(*) AS n_rows, " + ", ".join(f"count({c}) AS n_{c}" for c in ORDER_COLUMNS)
    + ", min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders",
)
def scan_profile(spark, sf):
    df = null_nans(read(spark, sf, "orders"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(c).alias(f"n_{c}") for c in ORDER_COLUMNS],
        F.min("o_totalprice").alias("lo"),
        F.max("o_totalprice").alias("hi"),
    )


@query(
    "class_profile",
    """WITH c AS (SELECT o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total FROM c)
    SELECT count(*) AS class_count, round(-sum(n / total * ln(n / total)) / ln(greatest(count(*), 2)), 8) AS class_entropy,
    round(max(n / total), 8) AS majority_class_ratio, round(min(n / total), 8) AS minority_class_ratio FROM c, t""",
)
def class_profile_query(spark, sf):
    return rounded(class_profile(read(spark, sf, "orders"), "o_orderpriority"), 8)


@query(
    "numeric_profile",
    "WITH g AS (SELECT " + GAPS_SQL + " FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"min({c}) AS lo, max({c}) AS hi FROM g" for c in FOUR
    ),
)
def numeric_profile_query(spark, sf):
    return rounded(numeric_profile(read(spark, sf, "lineitem").selectExpr(*GAPS), FOUR), {"mean": 6, "std": 6})


@query(
    "drop_non_numeric",
    f"SELECT row_id, split, p_brand, p_size, p_retailprice FROM ({keyed_sql('part', 'p_partkey', 'p_name, p_brand, p_type, p_size, p_retailprice')})",
)
def drop_non_numeric_query(spark, sf):
    df = keyed(read(spark, sf, "part"), ["p_partkey"]).drop("p_partkey")
    return drop_non_numeric(df, "p_brand").drop("row_hash")


@query(
    "coerce_numeric",
    """SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN value || '+' ELSE cast(value AS VARCHAR) END AS DOUBLE) AS number
    FROM events""",
)
def coerce_numeric(spark, sf):
    text = F.when(F.col("event_type") == "error", F.concat(F.col("value").cast("string"), F.lit("+"))).otherwise(F.col("value").cast("string"))
    return read(spark, sf, "events").select("event_id", coerce_number(text).alias("number"))


@query(
    "align_union",
    """SELECT c_acctbal AS balance, c_custkey AS id, c_nationkey AS nation FROM customer
    UNION ALL SELECT s_acctbal, s_suppkey, 0 FROM supplier""",
)
def align_union_query(spark, sf):
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    suppliers = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return align_union([customers, suppliers])


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "compact_view",
    """WITH m AS (SELECT median(nullif(p_size, 50)) AS s, median(p_retailprice) AS r FROM part)
    SELECT p_partkey AS row_id, coalesce(cast(nullif(p_size, 50) AS DOUBLE), s) AS p_size, p_retailprice, """
    + ", ".join(f"CASE WHEN p_type = '{t}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_type_{t}" for t in PART_TYPES[1:])
    + " FROM part, m",
)
def compact_view_query(spark, sf):
    df = with_row_keys(read(spark, sf, "part"), ["p_partkey"]).withColumn("p_size", F.expr("nullif(p_size, 50)"))
    return compact_view(df, ["p_size", "p_retailprice"], ["p_type"]).drop("row_hash")


@query(
    "profile_prepare",
    f"""WITH b AS ({keyed_sql('orders', 'o_orderkey', 'o_orderstatus, o_orderpriority, o_totalprice')}),
    s AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY min(row_id)) - 1 AS c FROM b WHERE split = 'train' GROUP BY 1),
    p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY min(row_id)) - 1 AS c FROM b WHERE split = 'train' GROUP BY 1)
    SELECT row_id, split, cast(coalesce(s.c, -1) AS DOUBLE) AS o_orderstatus, cast(coalesce(p.c, -1) AS DOUBLE) AS o_orderpriority, o_totalprice
    FROM b LEFT JOIN s ON b.o_orderstatus = s.v LEFT JOIN p ON b.o_orderpriority = p.v""",
)
def profile_prepare(spark, sf):
    df = keyed(read(spark, sf, "orders"), ["o_orderkey"]).select("row_id", "row_hash", "split", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return first_appearance_codes(df).drop("row_hash")


@query(
    "split_stats",
    "SELECT split, count(*) AS n_rows, " + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in FOUR) + f" FROM ({lines_sql(GAPS_SQL)}) GROUP BY split",
)
def split_stats_query(spark, sf):
    return split_stats(lines(spark, sf, *GAPS))


@query(
    "convert_rules",
    """WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'Free' ELSE event_id || '+' END AS i, '$' || value AS p,
      CASE WHEN user_id < 30 THEN 'Varies with device' WHEN user_id < 90 THEN user_id || 'M' ELSE user_id || 'k' END AS s,
      nullif(event_type, 'click') AS v FROM events),
    c AS (SELECT *, cast(replace(replace(nullif(s, 'Varies with device'), 'k', ''), 'M', '') AS DOUBLE) AS n FROM r)
    SELECT event_id, coalesce(try_cast(regexp_replace(i, '[+,]', '', 'g') AS BIGINT), 0) AS "Installs",
      cast(regexp_replace(p, '[$,]', '', 'g') AS DOUBLE) AS "Price", CASE WHEN n < 100 THEN n / 1024 ELSE n END AS "Size",
      coalesce(v, 'Unknown') AS "Android Ver" FROM c WHERE i NOT IN ('Paid', 'Free')""",
)
def convert_rules(spark, sf):
    raw = read(spark, sf, "events").select(
        "event_id",
        F.expr("CASE WHEN event_type = 'error' THEN 'Free' ELSE concat(event_id, '+') END").alias("Installs"),
        F.expr("concat('$', value)").alias("Price"),
        F.expr(
            "CASE WHEN user_id < 30 THEN 'Varies with device' WHEN user_id < 90 THEN concat(user_id, 'M') ELSE concat(user_id, 'k') END"
        ).alias("Size"),
        F.expr("nullif(event_type, 'click')").alias("Android Ver"),
    )
    return convert(raw)


@query("survivors_semi", f"SELECT row_id, split, qty FROM ({lines_sql(GAPS_SQL)}) WHERE disc IS NOT NULL AND tax IS NOT NULL")
def survivors_semi(spark, sf):
    df = lines(spark, sf, *GAPS)
    left = df.where(no_nulls(FOUR)).select("row_id")
    return df.select("row_id", "split", "qty").join(left, "row_id", "left_semi")


@query("dropped_anti", f"SELECT row_id, split, qty FROM ({lines_sql(GAPS_SQL)}) WHERE disc IS NULL OR tax IS NULL")
def dropped_anti(spark, sf):
    df = lines(spark, sf, *GAPS)
    left = df.where(no_nulls(FOUR)).select("row_id")
    return df.select("row_id", "split", "qty").join(left, "row_id", "left_anti")


@query("rejoin_by_key", f"SELECT row_id, qty, price, disc FROM ({lines_sql(GAPS_SQL)}) WHERE disc IS NOT NULL")
def rejoin_by_key(spark, sf):
    df = lines(spark, sf, *GAPS)
    return df.select("row_id", "qty", "price").join(df.where("disc IS NOT NULL").select("row_id", "disc"), "row_id")


@query("degree_sample", "SELECT event_id FROM events WHERE " + hex_sql("md5('42:' || event_id)", 9) + f" < {threshold(0.3)}")
def degree_sample_query(spark, sf):
    return degree_sample(with_row_keys(read(spark, sf, "events"), ["event_id"]), 0.3).select("event_id")


@query(
    "degree_sample_exact",
    f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {hex_sql("md5('42:' || event_id)", 9, 15)}, event_id) AS r,
    count(*) OVER () AS n FROM events) WHERE r <= round(0.3 * n)""",
)
def degree_sample_exact(spark, sf):
    return degree_sample(with_row_keys(read(spark, sf, "events"), ["event_id"]), 0.3, exact=True).select("event_id")


@query(
    "sample_rest",
    f"SELECT row_id, split, d2 < {threshold(0.4)} AS sampled, CASE WHEN d2 < {threshold(0.4)} THEN coalesce(disc, -1.0) ELSE disc END AS disc FROM ({lines_sql(GAPS_SQL)})",
)
def sample_rest(spark, sf):
    here = in_sample(0.4)
    return lines(spark, sf, *GAPS).select(
        "row_id", "split", here.alias("sampled"), F.when(here, F.coalesce("disc", F.lit(-1.0))).otherwise(F.col("disc")).alias("disc")
    )


@query("split_assign", f"SELECT row_id AS event_id, split FROM ({events_sql('value')})")
def split_assign(spark, sf):
    return events(spark, sf).select(F.col("row_id").alias("event_id"), "split")


@query(
    "split_exact",
    f"""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {hex_sql("md5('42:' || event_id)", 1, 15)}, event_id) AS r, count(*) OVER () AS n FROM events),
    s AS (SELECT *, ceil(n * 0.3::DOUBLE) AS t FROM r), v AS (SELECT *, ceil((n - t) * (0.3::DOUBLE / (1 - 0.3::DOUBLE))) AS w FROM s)
    SELECT event_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + w THEN 'val' ELSE 'train' END AS split FROM v""",
)
def split_exact(spark, sf):
    return divide(with_row_keys(read(spark, sf, "events"), ["event_id"]), exact=True).select("event_id", "split")


HOLD = "substr(md5('42:' || o_orderkey), 25, 8) || substr(md5('42:' || o_orderkey), 1, 7)"


@query(
    "strat_holdout",
    f"""SELECT o_orderkey, o_orderpriority, r <= ceil(n * 0.25) AS holdout FROM (SELECT o_orderkey, o_orderpriority,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY cast('0x' || {HOLD} AS BIGINT), o_orderkey) AS r,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""",
)
def strat_holdout(spark, sf):
    df = with_row_keys(read(spark, sf, "orders"), ["o_orderkey"])
    return stratified_holdout(df, "o_orderpriority", 0.25).select("o_orderkey", "o_orderpriority", "holdout")


@query(
    "cv_folds",
    f"""SELECT o_orderkey, o_orderpriority, cast((r > n * 1 // 5)::INT + (r > n * 2 // 5)::INT + (r > n * 3 // 5)::INT + (r > n * 4 // 5)::INT AS INT) AS fold
    FROM (SELECT o_orderkey, o_orderpriority,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hex_sql("md5('42:' || o_orderkey)", 17, 15)}, o_orderkey) AS r,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""",
)
def cv_folds_query(spark, sf):
    df = with_row_keys(read(spark, sf, "orders"), ["o_orderkey"])
    return cv_folds(df, "o_orderpriority").select("o_orderkey", "o_orderpriority", "fold")


def plan_columns_sql(key: str, space: str = "legacy", seed: int = 42) -> str:
    """SQL of ``draw_plans`` with low 0.1 and high 1.0."""
    out = []
    for stage, methods in method_options(space).items():
        names = "[" + ", ".join(f"'{m}'" for m in methods) + "]"
        pick = seeded_sql(f"'{seed}'", f"'{stage}'", "'m'", key)
        out.append(f"{names}[cast(floor({pick} * {len(methods)}) AS INT) + 1] AS m_{stage}")
        degree = seeded_sql(f"'{seed}'", f"'{stage}'", "'e'", key)
        out.append(f"round(0.1 + {degree} * (1.0 - 0.1), 2) AS e_{stage}")
    return ", ".join(out)


def order_plans(spark, sf, space: str = "legacy"):
    return draw_plans(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), "o_orderkey", method_options(space))


@query("plan_draw", f"SELECT o_orderkey, {plan_columns_sql('o_orderkey')} FROM orders")
def plan_draw(spark, sf):
    return order_plans(spark, sf).drop("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


STAGES = list(method_options("legacy"))


@query(
    "combo_sample",
    f"""WITH p AS (SELECT {plan_columns_sql('o_orderkey')} FROM orders),
    c AS (SELECT DISTINCT {" || '/' || ".join(f"m_{s}" for s in STAGES)} AS combo_id FROM p)
    SELECT combo_id FROM c ORDER BY md5('42:' || combo_id), combo_id LIMIT 120""",
)
def combo_sample(spark, sf):
    combos = order_plans(spark, sf).select(F.concat_ws("/", *[f"m_{s}" for s in STAGES]).alias("combo_id")).distinct()
    return sample_combos(combos, 120)
