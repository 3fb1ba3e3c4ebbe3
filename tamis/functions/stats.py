"""One-pass statistics: moments, modes and level tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.keys import ROW_ID
from tamis.functions.schema import quoted

PAIRWISE_LIMIT = 12


def summaries(df: DataFrame, columns: dict[str, Column], wanted: dict) -> dict[str, dict]:
    """``wanted`` maps a statistic name to an aggregate function; one job for all columns."""
    if not columns:
        return {}
    names = list(columns)
    row = df.agg(*[f(columns[n]).alias(f"{s}_{i}") for i, n in enumerate(names) for s, f in wanted.items()]).first()
    return {n: {s: row[f"{s}_{i}"] for s in wanted} for i, n in enumerate(names)}


def moments(df: DataFrame, columns: list[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean vector and population covariance over rows without NULLs.

    Few columns: one aggregate of stable pairwise covariances. Many columns: vectors, summed in the JVM.
    """
    p = len(columns)
    names = [f"m{i}" for i in range(p)]
    full = df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names)]).na.drop("any")
    if p <= PAIRWISE_LIMIT:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        row = full.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(f"m{i}").alias(f"a{i}") for i in range(p)],
            *[F.covar_pop(f"m{i}", f"m{j}").alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        if not row["n"]:
            return 0, np.zeros(p), np.zeros((p, p))
        cov = np.zeros((p, p))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
        return row["n"], np.array([row[f"a{i}"] for i in range(p)]), cov
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(full).select("v")
    s = vectors.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).first()["s"]
    n = int(s["count"])
    if n < 2:
        return n, np.array(s["mean"].toArray()), np.zeros((p, p))
    corr = Correlation.corr(vectors, "v").first()[0].toArray()
    std = np.sqrt(s["variance"].toArray() * (n - 1) / n)
    corr = np.nan_to_num(corr, nan=0.0)
    np.fill_diagonal(corr, 1.0)
    return n, s["mean"].toArray(), corr * np.outer(std, std)


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pairwise-complete Pearson correlations of column i with each later column j, in one job."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if not pairs:
        return {}
    if len(columns) > 4 * PAIRWISE_LIMIT:
        nulls = df.agg(*[F.sum(quoted(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        if not any(nulls):
            _, _, cov = moments(df, [quoted(c) for c in columns])
            std = np.sqrt(np.diag(cov))
            safe = np.where(std > 0, std, np.nan)
            corr = cov / np.outer(safe, safe)
            return {
                (columns[i], columns[j]): None if np.isnan(corr[i, j]) else float(corr[i, j]) for i, j in pairs
            }
    row = df.agg(*[_corr(quoted(columns[i]), quoted(columns[j])).alias(f"r{i}_{j}") for i, j in pairs]).first()
    return {(columns[i], columns[j]): row[f"r{i}_{j}"] for i, j in pairs}


def _corr(a: Column, b: Column) -> Column:
    """``corr`` with NULL instead of a division error or NaN for constant columns."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(scale > 0, F.covar_pop(x, y) / scale)


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-NULL value of each column; ties go to the smallest value. One job."""
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    # one field per kind of type, so a value is counted and returned as it is
    kinds = {"whole": "bigint", "exact": "decimal(38,18)", "real": "double", "txt": "string"}
    kind = {c: _mode_kind(types[c]) for c in columns}
    items = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("c"),
                    *[(quoted(c) if k == kind[c] else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()],
                )
                for i, c in enumerate(columns)
            ]
        )
    ).alias("item")
    rows = (
        df.select(items)
        .select("item.*")
        .where(F.coalesce(*[F.col(k).cast("string") for k in kinds]).isNotNull())
        .groupBy("c", *kinds)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("c")
        .agg(F.min(F.struct((-F.col("n")).alias("o"), *kinds)).alias("best"))
        .collect()
    )
    out: dict[str, object] = {}
    for r in rows:
        name = columns[r["c"]]
        value = r["best"][kind[name]]
        out[name] = bool(value) if isinstance(types[name], T.BooleanType) else value
    return out


def _mode_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return "whole"
    if isinstance(data_type, T.DecimalType):
        return "exact"
    return "real" if isinstance(data_type, T.NumericType) else "txt"


def cardinality_over(df: DataFrame, columns: list[str], most: int, share: float) -> set[str]:
    """Columns with more than ``most`` distinct values, or more than ``share`` of the rows.

    A sketch settles the clear cases; only columns near a limit are counted exactly.
    """
    if not columns:
        return set()
    rsd = 0.02
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(quoted(c), rsd).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    n = row["n"]
    over, unclear = set(), []
    limits = [limit for limit in (float(most), share * n) if limit >= 0]
    for i, c in enumerate(columns):
        d = float(row[f"d{i}"])
        if d > min(limits) * (1 + 8 * rsd) + 2:
            over.add(c)
        elif d > min(limits) * (1 - 8 * rsd) - 2:
            unclear.append(c)
    if unclear:
        exact = df.agg(*[F.count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(unclear)]).first()
        for i, c in enumerate(unclear):
            if exact[f"d{i}"] > most or (n > 0 and exact[f"d{i}"] / n > share):
                over.add(c)
    return over


def level_table(df: DataFrame, columns: list[str], target: Column | None = None) -> dict[str, list[dict]]:
    """Levels of each text column with count, first row id and target mean, in first-appearance order.

    Call it only for columns ``cardinality_over`` has passed: the result is held on the driver.
    """
    if not columns:
        return {}
    y = target.cast("double") if target is not None else F.lit(None).cast("double")
    items = F.explode(
        F.array(*[F.struct(F.lit(i).alias("c"), quoted(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    ).alias("item")
    rows = (
        df.select(items, F.col(ROW_ID), y.alias("y"))
        .select("item.*", ROW_ID, "y")
        .where(F.col("v").isNotNull())
        .groupBy("c", "v")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(ROW_ID).alias("first"),
            F.avg("y").alias("mean"),
        )
        .collect()
    )
    out: dict[str, list[dict]] = {c: [] for c in columns}
    for r in rows:
        out[columns[r["c"]]].append({"value": r["v"], "n": r["n"], "first": r["first"], "mean": r["mean"]})
    for c in columns:
        out[c].sort(key=lambda level: level["first"])
    return out
