"""Benefit records, runtime profiles, results and failures as appended Parquet or CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = (
    "dataset string, model string, cost_param string, operator_space string, artifact_version string, "
    "benefit_label_source string, proxy_eval_rate double, benefit_fit_rows long, benefit_eval_rows long, "
    "methods map<string,string>, degrees map<string,double>, accuracy double, elapsed double"
)
PROFILE_SCHEMA = (
    "dataset string, process string, method string, cost_param string, artifact_version string, "
    "step double, run_num int, e double, run int, seconds double"
)
RECORD_DEFAULTS = {"cost_param": "e", "operator_space": "legacy"}


def write_records(records: DataFrame, path: str) -> None:
    """Append benefit records. Files are split by (dataset, model); busy pairs spread over tasks."""
    records.write.mode("append").partitionBy("dataset", "model").parquet(path)


def read_records(spark: SparkSession, path: str, dataset: str | None = None, model: str | None = None) -> DataFrame:
    schema = T._parse_datatype_string(RECORD_SCHEMA)
    found = spark.read.schema(schema).parquet(path)
    if dataset is not None:
        found = found.where(F.col("dataset") == dataset)
    if model is not None:
        found = found.where(F.col("model") == model)
    return with_record_defaults(found)


def with_record_defaults(records: DataFrame, dataset: str = "google", model: str = "LDA") -> DataFrame:
    """Fill what older records lack, so all kinds can be pooled."""
    defaults = {"dataset": dataset, "model": model, **RECORD_DEFAULTS}
    return records.select(
        *[
            F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
            for c in records.columns
        ]
    )


def write_profile(measurements: DataFrame, path: str) -> None:
    measurements.write.mode("append").partitionBy("dataset").parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).parquet(path)


def profile_lookup(
    wanted: DataFrame, profiles: DataFrame, strict: bool = False
) -> DataFrame:
    """Most specific profile per wanted (dataset, process, method, cost_param).

    Order: dataset and cost mode, dataset, cost mode, generic. ``dataset``/``cost_param`` are NULL in the
    less specific profiles. ``strict`` admits the first kind only. A wanted row without a profile stays, with
    NULLs. Of equal keys the smallest profile counts.
    """
    keys = ["dataset", "process", "method", "cost_param"]
    rest = [c for c in profiles.columns if c not in keys]
    found = wanted.select(*keys)
    kinds = [("dataset", "cost_param"), ("dataset",), ("cost_param",), ()]
    for number, by in enumerate(kinds[:1] if strict else kinds, 1):
        # an equi-join for each kind: a wanted row meets only the profiles of its own keys
        absent = [F.col(c).isNull() for c in ("dataset", "cost_param") if c not in by]
        kind = profiles
        for condition in absent:
            kind = kind.where(condition)
        on = ["process", "method", *by]
        table = kind.groupBy(*on).agg(F.min(F.struct(*rest)).alias(f"__p{number}"))
        found = found.join(table, on, "left")
    filled = [F.col(f"__p{n}") for n in range(1, (1 if strict else len(kinds)) + 1)]
    best = F.coalesce(*filled)
    level = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in enumerate(filled, 1)])
    return found.select(*keys, level.alias("specificity"), *[best[c].alias(c) for c in rest])


def write_coefficients(coefficients: DataFrame, path: str, version: int) -> None:
    """Append one version of cost lines (dataset, process, method, statistic, k, b)."""
    coefficients.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)


def read_coefficients(spark: SparkSession, path: str, newest: int) -> DataFrame:
    """Versions up to ``newest``; the folders of later ones are not read."""
    return spark.read.parquet(path).where(F.col("version") <= newest)


def coefficients_as_of(wanted: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Adds (used_version, k, b): per row the last version up to its ``version``, of its ``statistic`` (mean or q90).

    Versions of a line are few and ride along as one sorted array, so there is no join on a range; a row before the
    first version of its line stays, with NULLs. Of equal versions the largest line counts.
    """
    keys = ["dataset", "process", "method", "statistic"]
    versions = coefficients.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("version", "k", "b"))).alias("__versions"))
    joined = wanted.join(versions, keys, "left")
    known = F.filter("__versions", lambda v: v["version"] <= F.col("version"))
    found = joined.withColumn("__used", F.try_element_at(known, F.lit(-1)))
    return found.select(*wanted.columns, F.col("__used.version").alias("used_version"), F.col("__used.k").alias("k"), F.col("__used.b").alias("b"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").option("header", True).csv(path)


def pending_cases(cases: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Cases without a stored result."""
    return cases.join(finished.select(*keys).distinct(), keys, "left_anti")


def failure_counts(failures: DataFrame, reason: Column, most: int = 5) -> DataFrame:
    """The ``most`` frequent failure reasons."""
    return failures.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "reason").limit(most)
