"""Column families and schema alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.keys import RESERVED


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def feature_fields(df: DataFrame, label: str | None = None) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in RESERVED and f.name != label]


def feature_columns(df: DataFrame, label: str | None = None) -> list[str]:
    return [f.name for f in feature_fields(df, label)]


def numeric_columns(df: DataFrame, label: str | None = None) -> list[str]:
    """Integers, floats and decimals; booleans are not numbers here."""
    return [f.name for f in feature_fields(df, label) if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame, label: str | None = None) -> list[str]:
    return [f.name for f in feature_fields(df, label) if isinstance(f.dataType, T.StringType)]


def carried_columns(df: DataFrame, label: str | None = None) -> list[str]:
    """Key, split and label columns, in table order: what every stage passes through."""
    return [c for c in df.columns if c in RESERVED or c == label]


def null_nans(df: DataFrame) -> DataFrame:
    """NaN means missing: turn it into NULL once, when a table enters."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[F.nanvl(quoted(c), F.lit(None).cast("double")).alias(c) if c in floats else quoted(c) for c in df.columns]
    )


def align_union(parts: list[DataFrame], fill: float = 0.0) -> DataFrame:
    """Union by name over the sorted union of columns; columns a part lacks are filled."""
    names = sorted({c for part in parts for c in part.columns})
    types: dict[str, T.DataType] = {}
    for part in parts:
        for f in part.schema.fields:
            types.setdefault(f.name, f.dataType)

    def widen(part: DataFrame) -> DataFrame:
        have = set(part.columns)
        return part.select(
            *[quoted(c).cast(types[c]) if c in have else F.lit(fill).cast(types[c]).alias(c) for c in names]
        )

    out = widen(parts[0])
    for part in parts[1:]:
        out = out.unionByName(widen(part))
    return out


def fit_schema(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Keep the fitted columns; those the table lacks are filled."""
    have = set(df.columns)
    extra = [c for c in df.columns if c in RESERVED]
    return df.select(
        *[quoted(c) for c in extra],
        *[quoted(c) if c in have else F.lit(fill).alias(c) for c in columns],
    )


def common_columns(parts: list[DataFrame]) -> list[str]:
    shared = set(parts[0].columns).intersection(*[set(p.columns) for p in parts[1:]])
    return [c for c in parts[0].columns if c in shared]


def keep_columns(df: DataFrame, keep: list[str], label: str | None = None) -> DataFrame:
    """Keep the listed features, in list order, with the carried columns."""
    have = set(feature_columns(df, label))
    return df.select(*[quoted(c) for c in carried_columns(df, label)], *[quoted(c) for c in keep if c in have])


def drop_non_numeric(df: DataFrame, label: str | None = None) -> DataFrame:
    return keep_columns(df, numeric_columns(df, label), label)


def no_nulls(columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & quoted(c).isNotNull()
    return test


def finite_or_null(c: Column) -> Column:
    return F.when(F.abs(c) == F.lit(float("inf")), F.lit(None)).otherwise(c)


def coerce_number(c: Column) -> Column:
    """Number, or NULL for text that is none."""
    return c.try_cast("double")


def compact_view(df: DataFrame, numeric: list[str], categorical: list[str], label: str | None = None) -> DataFrame:
    """Median-filled numbers plus 0/1 columns for all but the first level of each category."""
    from tamis.functions.quantiles import exact_quantiles

    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns]
    numbers = {c: coerce_number(quoted(c).cast("string")) for c in numeric}
    medians = exact_quantiles(df, numbers, [0.5])
    out = [quoted(c) for c in carried_columns(df, label)]
    out += [F.coalesce(numbers[c], F.lit(_finite(medians[c][0])), F.lit(0.0)).alias(c) for c in numeric]
    for c in categorical:
        levels = sorted(r[0] for r in df.select(quoted(c)).where(quoted(c).isNotNull()).distinct().limit(1001).collect())
        if len(levels) > 1000:
            raise ValueError(f"{c} has more than 1000 levels; it is no category for a dummy view")
        out += [
            F.when(quoted(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}") for v in levels[1:]
        ]
    return df.select(*out)


def _finite(value):
    return None if value is None else float(value)
