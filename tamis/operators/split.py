"""Train/validation/test division, holdouts and folds, all as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.keys import SPLIT, below, in_sample
from tamis.functions.ranks import with_ranks_below
from tamis.functions.schema import quoted


def check_rates(test_rate: float, val_rate: float) -> None:
    """Training and test rows need a share each; the validation share may be nothing."""
    # 1 - 0.7 - 0.3 is not 0 in floating point, 1 - (0.7 + 0.3) is
    shares = {"train": 1 - (test_rate + val_rate), "val": val_rate, "test": test_rate}
    if not (min(shares["train"], shares["test"]) > 0 and shares["val"] >= 0):
        raise ValueError(f"no division into shares of {shares}")


def split_sizes(n: int, test_rate: float = 0.3, val_rate: float = 0.3) -> tuple[int, int, int]:
    """Exact train, validation and test sizes: the test share first, then its share of the rest."""
    n_test = math.ceil(n * test_rate)
    n_val = math.ceil((n - n_test) * (val_rate / (1 - test_rate))) if val_rate else 0
    return n - n_test - n_val, n_val, n_test


def divide(df: DataFrame, test_rate: float = 0.3, val_rate: float = 0.3, exact: bool = False) -> DataFrame:
    """Add ``split``. By default a hash threshold: no job and no shuffle; ``exact`` fixes the sizes."""
    check_rates(test_rate, val_rate)
    if exact:

        def ranks(n: Column) -> list[Column]:
            test = F.ceil(n * F.lit(test_rate))
            return [test, test + (F.ceil((n - test) * F.lit(val_rate / (1 - test_rate))) if val_rate else F.lit(0))]

        marked = with_ranks_below(df, ranks, ["__test", "__val"], "split")
        return marked.withColumn(SPLIT, F.when(F.col("__test"), "test").when(F.col("__val"), "val").otherwise("train")).drop("__test", "__val")
    is_test, is_val = below(test_rate, "split"), below(test_rate + val_rate, "split")
    return df.withColumn(SPLIT, F.when(is_test, "test").when(is_val, "val").otherwise("train"))


def degree_sample(df: DataFrame, degree: float, exact: bool = False) -> DataFrame:
    """The execution-degree sample; ``exact`` takes round(degree * rows) rows."""
    if not exact:
        return df.where(in_sample(degree))
    return with_ranks_below(df, lambda n: [F.rint(n * F.lit(float(degree)))], ["__in"], "degree").where("__in").drop("__in")


def stratified_holdout(df: DataFrame, label: str, rate: float = 0.25, column: str = "holdout") -> DataFrame:
    """Mark ``rate`` of each class, rounded up; a class of one row stays outside the holdout."""

    def ranks(n: Column) -> list[Column]:
        return [F.when(n >= 2, F.ceil(n * F.lit(rate))).otherwise(F.lit(0))]

    return with_ranks_below(df, ranks, [column], "holdout", quoted(label))


def cv_folds(df: DataFrame, label: str, most: int = 10, column: str = "fold") -> DataFrame:
    """Stratified folds 0..k-1, k = min(most, classes): each class is cut into k equal rank ranges."""
    counted = df.agg(F.count_distinct(quoted(label)) + F.max(F.when(quoted(label).isNull(), 1).otherwise(0))).first()[0]
    k = min(most, counted or 0)
    if k < 2:
        raise ValueError("cross-validation needs at least two classes")
    names = [f"__f{j}" for j in range(1, k)]
    marked = with_ranks_below(df, lambda n: [F.floor(n * F.lit(j) / F.lit(k)) for j in range(1, k)], names, "fold", quoted(label))
    fold = sum((F.when(F.col(n), 0).otherwise(1) for n in names), F.lit(0))
    return marked.withColumn(column, fold.cast("int")).drop(*names)
