"""Dataset profiles: sizes, gaps, cardinalities, class shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.keys import ROW_ID, SPLIT
from tamis.functions.schema import coerce_number, feature_columns, numeric_columns, quoted, text_columns

# Names of the dataset meta-features.
META_NAMES = [
    "log_rows", "log_cols", "log_numeric_cols", "log_categorical_cols", "numeric_ratio", "categorical_ratio",
    "log_cat_cardinality_sum", "log_cat_cardinality_max", "missing_rate", "log_rows_per_col",
    "log_class_count", "class_entropy", "majority_class_ratio", "minority_class_ratio",
]


def dataset_params(df: DataFrame, label: str, distinct: str = "exact", rsd: float = 0.01) -> DataFrame:
    """One row: rows, columns by kind, cardinalities of the non-numeric columns, mean share of gaps.

    ``distinct="sketch"`` replaces the exact distinct counts, which shuffle every distinct value of the
    non-numeric columns, by one-pass sketches.
    """
    features = feature_columns(df, label)
    numeric = numeric_columns(df, label)
    other = [c for c in features if c not in numeric]
    gaps = [F.avg(quoted(c).isNull().cast("double")) for c in features]
    size = F.count_distinct if distinct == "exact" else lambda c: F.approx_count_distinct(c, rsd)
    base = df.agg(
        F.count(F.lit(1)).alias("dataset_rows"),
        (sum(gaps[1:], gaps[0]) / len(gaps) if gaps else F.lit(0.0)).alias("missing_rate"),
        *[size(quoted(c)).alias(f"__d{i}") for i, c in enumerate(other)],
    )
    sizes = [F.col(f"__d{i}") for i in range(len(other))]
    return base.select(
        "dataset_rows",
        F.lit(len(features)).cast("long").alias("dataset_cols"),
        F.lit(len(numeric)).cast("long").alias("numeric_cols"),
        F.lit(len(other)).cast("long").alias("categorical_cols"),
        (sum(sizes[1:], sizes[0]) if sizes else F.lit(0)).cast("long").alias("cat_cardinality_sum"),
        (F.greatest(*sizes) if len(sizes) > 1 else sizes[0] if sizes else F.lit(0)).cast("long").alias("cat_cardinality_max"),
        F.coalesce("missing_rate", F.lit(0.0)).alias("missing_rate"),
    )


def class_profile(df: DataFrame, label: str) -> DataFrame:
    """One row: class count, normalised entropy, largest and smallest share. Reads one column."""
    counts = df.groupBy(quoted(label).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = counts.agg(
        F.count(F.lit(1)).alias("class_count"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.log("n")).alias("nlogn"),
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
    )
    entropy = F.log("total") - F.col("nlogn") / F.col("total")
    return sums.select(
        F.col("class_count"),
        (entropy / F.log(F.greatest(F.col("class_count"), F.lit(2)).cast("double"))).alias("class_entropy"),
        (F.col("largest") / F.col("total")).alias("majority_class_ratio"),
        (F.col("smallest") / F.col("total")).alias("minority_class_ratio"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def meta_columns() -> list[Column]:
    """The 14 meta-features from the columns of ``dataset_params`` and ``class_profile``."""
    rows, cols = F.col("dataset_rows").cast("double"), F.col("dataset_cols").cast("double")
    return [
        F.log1p(rows).alias("log_rows"),
        F.log1p(cols).alias("log_cols"),
        F.log1p(F.col("numeric_cols").cast("double")).alias("log_numeric_cols"),
        F.log1p(F.col("categorical_cols").cast("double")).alias("log_categorical_cols"),
        _ratio(F.col("numeric_cols").cast("double"), cols).alias("numeric_ratio"),
        _ratio(F.col("categorical_cols").cast("double"), cols).alias("categorical_ratio"),
        F.log1p(F.col("cat_cardinality_sum").cast("double")).alias("log_cat_cardinality_sum"),
        F.log1p(F.col("cat_cardinality_max").cast("double")).alias("log_cat_cardinality_max"),
        F.col("missing_rate"),
        F.log1p(_ratio(rows, F.greatest(cols, F.lit(1.0)))).alias("log_rows_per_col"),
        F.log1p(F.col("class_count").cast("double")).alias("log_class_count"),
        F.col("class_entropy"),
        F.col("majority_class_ratio"),
        F.col("minority_class_ratio"),
    ]


def dataset_meta(df: DataFrame, label: str) -> DataFrame:
    shape = class_profile(df, label).first()
    params = dataset_params(df, label)
    return params.select("*", *[F.lit(shape[c]).alias(c) for c in shape.__fields__]).select(*meta_columns())


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: count, mean, sample deviation, bounds, from one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("lo"),
                F.max(x).alias("hi"),
            ).alias(f"s{i}")
        )
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select("s.*")


def split_stats(df: DataFrame, label: str | None = None) -> DataFrame:
    """Rows and NULLs per column of each split."""
    columns = feature_columns(df, label)
    return df.groupBy(SPLIT).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(quoted(c).isNull().cast("long")).alias(f"null_{c}") for c in columns],
    )


def first_appearance_codes(df: DataFrame, label: str | None = None, most: int = 100_000) -> DataFrame:
    """Text columns as codes of first appearance in the training rows, unknown -1; numbers, gaps as 0."""
    texts = text_columns(df, label)
    numbers = numeric_columns(df, label)
    train = df.where(F.col(SPLIT) == "train")
    out = df
    codes = {}
    for i, c in enumerate(texts):
        first = train.where(quoted(c).isNotNull()).groupBy(quoted(c).alias(f"__v{i}")).agg(F.min(ROW_ID).alias("__first"))
        if first.limit(most + 1).count() > most:
            raise ValueError(f"{c} has more than {most} values; drop it before profiling")
        # the value table is checked to be small, so its order fits one task and its codes one broadcast
        table = first.withColumn(f"__c{i}", F.row_number().over(Window.orderBy("__first")) - 1).drop("__first")
        out = out.join(F.broadcast(table), quoted(c) == F.col(f"__v{i}"), "left")
        codes[c] = F.coalesce(F.col(f"__c{i}"), F.lit(-1)).cast("double")
    for c in numbers:
        codes[c] = F.coalesce(coerce_number(quoted(c).cast("string")), F.lit(0.0))
    return out.select(*[codes[c].alias(c) if c in codes else quoted(c) for c in df.columns])
