"""Input tables and their label metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.keys import with_row_keys
from tamis.functions.schema import null_nans
from tamis.operators.split import divide


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, null_value: str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files: inference reads the data twice.

    ``null_value`` is off by default, so a marker such as ``?`` stays an ordinary category.
    """
    reader = spark.read.option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return null_nans(reader.csv(path))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return null_nans(df.select(*columns) if columns else df)


def read_label(spark: SparkSession, path: str) -> str:
    """Target column named by an ``info.json``."""
    info = spark.read.option("multiLine", True).json(path)
    if "label" not in info.columns:
        raise ValueError(f"no label in {path}")
    return info.select("label").first()[0]


def read_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One row per dataset folder: name, path of the data, label."""
    info = spark.read.option("multiLine", True).json(f"{folder}/*/info.json").select("label", F.input_file_name().alias("file"))
    return info.select(
        F.element_at(F.split("file", "/"), -2).alias("dataset"),
        F.regexp_replace("file", "info\\.json$", "data.csv").alias("path"),
        "label",
    )


def keyed(df: DataFrame, key_cols: list[str], seed: int = 42, test_rate: float = 0.3, val_rate: float = 0.3, exact: bool = False) -> DataFrame:
    """Key and split a table: the form every stage takes."""
    return divide(with_row_keys(df, key_cols, seed), test_rate, val_rate, exact)
