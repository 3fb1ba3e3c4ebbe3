"""Row keys and the hash samples built on them.

One md5 per row is computed when the table is keyed. Its 32 hex digits are cut into four 8-digit
slices, so the split, the execution degree, the fold and the holdout draws are independent of each
other and of the physical layout of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_ID = "row_id"
ROW_HASH = "row_hash"
SPLIT = "split"
RESERVED = (ROW_ID, ROW_HASH, SPLIT)

# first hex digit (1-based) of the slice each draw reads
SLICE_START = {"split": 1, "degree": 9, "fold": 17, "holdout": 25}
SLICE_SPAN = 2**32


def with_row_keys(df: DataFrame, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Add ``row_id`` (the key, or its parts joined by ``-``) and ``row_hash``."""
    if len(key_cols) == 1:
        key = F.col(key_cols[0])
    else:
        key = F.concat_ws("-", *[F.col(c).cast("string") for c in key_cols])
    return df.withColumn(ROW_ID, key).withColumn(
        ROW_HASH, F.md5(F.concat(F.lit(f"{seed}:"), F.col(ROW_ID).cast("string")))
    )


def hex_slice(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("long")


def long_draw(use: str) -> Column:
    """60-bit draw for exact sampling. The purpose is mixed in by rotating the digits."""
    start = SLICE_START[use]
    rotated = F.concat(F.substring(ROW_HASH, start, 33 - start), F.substring(ROW_HASH, 1, start - 1))
    return hex_slice(rotated, 1, 15)


def threshold(rate: float) -> int:
    return int(round(float(rate) * SLICE_SPAN))


def below(rate: float, use: str) -> Column:
    """True if the row's draw is below the rate. Hex digits of equal width order like numbers, so this
    is one string comparison and needs no conversion."""
    limit = threshold(rate)
    if limit >= SLICE_SPAN:
        return F.lit(True)
    return F.substring(ROW_HASH, SLICE_START[use], 8) < F.lit(f"{limit:08x}")


def in_sample(degree: float, use: str = "degree") -> Column:
    """True for the rows of the execution-degree sample. Samples are nested in the degree."""
    if not 0.0 <= degree <= 1.0:
        raise ValueError("degree must be within [0, 1]")
    if degree >= 1.0:
        return F.lit(True)
    return below(degree, use)


def seeded_unit(*parts: Column | str | int) -> Column:
    """Uniform value in [0, 1) from the md5 of the joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return hex_slice(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8) / F.lit(float(SLICE_SPAN))
