"""Registry and the shared inputs of the queries: the same derived tables in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.keys import threshold
from tamis.sources.tables import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: dict[str, int] | int, keys: list[str] = ()) -> DataFrame:
    """Round the double columns, so sums taken in another order compare equal."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double" and f.name not in keys:
            d = digits if isinstance(digits, int) else digits.get(f.name, 6)
            out.append((F.rint(F.col(f"`{f.name}`") * 10.0**d) / 10.0**d).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def hex_sql(expr: str, start: int = 1, digits: int = 8) -> str:
    return f"cast('0x' || substr({expr}, {start}, {digits}) AS BIGINT)"


def keyed_sql(source: str, key: str, columns: str) -> str:
    """SQL of ``keyed``: row id, hash, split and the degree draw ``d2``."""
    return (
        f"SELECT *, CASE WHEN {hex_sql('row_hash')} < {threshold(0.3)} THEN 'test'"
        f" WHEN {hex_sql('row_hash')} < {threshold(0.6)} THEN 'val' ELSE 'train' END AS split,"
        f" {hex_sql('row_hash', 9)} AS d2"
        f" FROM (SELECT {key} AS row_id, md5('42:' || cast({key} AS VARCHAR)) AS row_hash, {columns} FROM {source})"
    )


def seeded_sql(*parts: str) -> str:
    """SQL of ``seeded_unit``; string parts are SQL expressions."""
    return "(" + hex_sql("md5(" + " || ':' || ".join(parts) + ")") + " / 4294967296.0)"


# --- inputs ---------------------------------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
LINE_KEY_SQL = (
    "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
)


def lines(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Keyed and split lineitem with the wanted feature columns."""
    raw = read(spark, sf_dir, "lineitem").withColumn("cents", F.floor(F.col("l_extendedprice") * 100 + 0.5))
    return keyed(raw, LINE_KEY).selectExpr("row_id", "row_hash", "split", *columns)


def lines_sql(columns: str) -> str:
    return keyed_sql("lineitem", LINE_KEY_SQL, columns)


# discount 0 and tax 0.08 stand for "not recorded"
GAPS = [
    "l_quantity AS qty",
    "l_extendedprice AS price",
    "nullif(l_discount, 0.0D) AS disc",
    "nullif(l_tax, 0.08D) AS tax",
]
GAPS_SQL = "l_quantity AS qty, l_extendedprice AS price, nullif(l_discount, 0.0) AS disc, nullif(l_tax, 0.08) AS tax"
NUMBERS = [
    "l_quantity AS qty",
    "l_extendedprice AS price",
    "l_discount AS disc",
    "l_tax AS tax",
]
NUMBERS_SQL = "l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax"
FOUR = ["qty", "price", "disc", "tax"]


def events(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return keyed(read(spark, sf_dir, "events"), ["event_id"]).selectExpr("row_id", "row_hash", "split", *columns)


def events_sql(columns: str) -> str:
    return keyed_sql("events", "event_id", columns)


EVENT_NUMBERS = [
    "value",
    "cast(user_id AS double) AS user",
    "cast(get_json_object(props, '$.k') AS double) AS k",
]
EVENT_NUMBERS_SQL = "value, cast(user_id AS DOUBLE) AS user, cast(json_extract_string(props, '$.k') AS DOUBLE) AS k"
HALF = threshold(0.5)


