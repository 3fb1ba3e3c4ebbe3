"""Duplicate detection inside the degree sample of each split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.keys import ROW_ID, SPLIT, in_sample
from tamis.functions.schema import feature_columns, feature_fields, quoted
from tamis.operators.base import Settings, Stage, nothing, register


def keep_first(df: DataFrame, keys: list[Column], degree: float) -> DataFrame:
    """Keep the lowest row id per key within the sample; rows outside the sample all stay.

    ``row_number() = 1`` is limited map-side before the shuffle, so copies of one row, however many,
    never gather in one task; rows outside the sample are keyed by their own id and spread evenly.
    """
    parts = [F.col(SPLIT), *keys]
    if degree < 1.0:
        parts.append(F.when(~in_sample(degree), F.col(ROW_ID).cast("string")))
    names = [f"__k{i}" for i in range(len(parts))]
    keyed = df.select("*", *[p.alias(n) for p, n in zip(parts, names)])
    window = Window.partitionBy(*names).orderBy(ROW_ID)
    return keyed.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn", *names)


def apply_exact(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    if s.degree <= 0:
        return df
    return keep_first(df, [quoted(c) for c in feature_columns(df, s.label)], s.degree)


def canonical_text(c: Column, prefix: int | None = None) -> Column:
    """Digest of the letters and digits of a text, in lower case and any script.

    A text without any is compared as it is, so unlike texts never meet in an empty key. ``prefix``: compare only
    so many characters, and the length in steps of four.
    """
    raw = F.coalesce(c.cast("string"), F.lit(""))
    text = F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]+", "")
    bare = F.concat(F.lit("="), raw)
    if prefix is None:
        return F.md5(F.when(text == "", bare).otherwise(text))
    head = F.concat(F.substring(text, 1, prefix), F.lit(":"), (F.length(text) / 4).cast("long").cast("string"))
    return F.when(text == "", bare).otherwise(head)


def apply_approximate(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    """Numbers are rounded to a step of the split's own span, texts to their letters and digits."""
    if s.degree <= 0:
        return df
    fields = feature_fields(df, s.label)
    numeric = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if numeric:
        value = {c: quoted(c).cast("double") for c in numeric}
        spans = (
            df.where(in_sample(s.degree))
            .groupBy(SPLIT)
            .agg(*[f(value[c]).alias(f"__{tag}{i}") for i, c in enumerate(numeric) for tag, f in (("lo", F.min), ("hi", F.max))])
        )
        # one row per split: at most three
        df = df.join(F.broadcast(spans), SPLIT, "left").select(*[quoted(c) for c in df.columns], *spans.columns[1:])
    keys = []
    for f in fields:
        if f.name in numeric:
            i = numeric.index(f.name)
            low, span = F.col(f"__lo{i}"), F.col(f"__hi{i}") - F.col(f"__lo{i}")
            step = F.greatest(span * F.lit(s.tolerance_ratio), F.lit(1e-12))
            keys.append(F.coalesce(F.rint((quoted(f.name).cast("double") - low) / step), F.lit(-1.0)))
        else:
            keys.append(canonical_text(quoted(f.name), s.prefix_length))
    helpers = [c for c in df.columns if c.startswith("__")]
    return keep_first(df, keys, s.degree).drop(*helpers)


@register
class DuplicateDetection(Stage):
    """``ED`` drops equal rows, ``AD`` rows with an equal canonical key; the label is not compared."""

    STAGE = "duplicate_detection"
    METHODS = {"ED": (nothing, apply_exact), "AD": (nothing, apply_approximate)}
    LEARNS_NOTHING = frozenset({"ED", "AD"})
    OPTIONS = {"prefix_length": None, "tolerance_ratio": 0.001}
