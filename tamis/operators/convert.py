"""Conversion of store-listing columns that arrive as decorated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.schema import quoted

# Column names, markers and decorations of the store-listing table.
INSTALLS, INSTALLED, PRICE, SIZE, VERSION = "Installs", "Install", "Price", "Size", "Android Ver"
INSTALLS_MARKERS = ("Paid", "Free")
SIZE_MARKER = "Varies with device"
SIZE_LIMIT, SIZE_DIVISOR = 100, 1024


def convert(df: DataFrame) -> DataFrame:
    """A no-op for tables without these columns, and for tables that are converted already."""
    names = set(df.columns)
    if INSTALLS not in names and INSTALLED in names:
        return df
    if INSTALLS in names:
        df = df.where(~F.coalesce(quoted(INSTALLS).isin(*INSTALLS_MARKERS), F.lit(False)))
    size = F.regexp_replace(F.when(quoted(SIZE) != SIZE_MARKER, quoted(SIZE)), "[kM]", "").cast("double") if SIZE in names else None
    rules = {
        VERSION: lambda c: F.coalesce(c, F.lit("Unknown")),
        INSTALLS: lambda c: F.coalesce(
            F.regexp_replace(c.cast("string"), "[+,]", "").try_cast("double").cast("long"), F.lit(0).cast("long")
        ),
        PRICE: lambda c: F.regexp_replace(c.cast("string"), "[$,]", "").cast("double"),
        SIZE: lambda c: F.when(size < SIZE_LIMIT, size / SIZE_DIVISOR).otherwise(size),
    }
    return df.select(*[rules[c](quoted(c)).alias(c) if c in rules else quoted(c) for c in df.columns])
