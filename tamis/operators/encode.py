"""Encoding of text columns, fitted on the training sample."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.schema import carried_columns, feature_columns, quoted, text_columns
from tamis.functions.stats import cardinality_over, level_table
from tamis.operators.base import Settings, Stage, register, training_sample


def _fill(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    return df.na.fill(text, columns) if columns else df


def fit_levels(df: DataFrame, s: Settings) -> dict:
    texts = [c for c in text_columns(df, s.label) if c not in s.drop_columns]
    sample = _fill(training_sample(df, s.degree), texts, s.unknown)
    dropped = cardinality_over(sample, texts, s.max_levels, s.max_share)
    coded = [c for c in texts if c not in dropped]
    target = None
    prior = None
    if s.method == "target":
        if s.label is None:
            raise ValueError("target encoding needs the label option")
        target = quoted(s.label)
        prior = sample.agg(F.avg(target.cast("double"))).first()[0]
    return {
        "dropped": sorted(dropped) + [c for c in s.drop_columns if c in df.columns],
        "columns": coded,
        "levels": level_table(sample, coded, target),
        "prior": prior,
    }


def _lookup(c: Column, pairs: list[tuple[str, object]], default: Column) -> Column:
    """Value per level through one constant map; levels are at most ``max_levels``."""
    if not pairs:
        return default
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    return F.coalesce(F.try_element_at(table, c), default)


def _assemble(df: DataFrame, s: Settings, state: dict, coded: dict[str, Column]) -> DataFrame:
    """Features in name order, as the encoders leave them, after the carried columns."""
    if not state["columns"] and not state["dropped"]:
        return df
    gone = set(state["dropped"]) | set(state["columns"])
    kept = {c: quoted(c) for c in feature_columns(df, s.label) if c not in gone}
    kept.update(coded)
    return df.select(
        *[quoted(c) for c in carried_columns(df, s.label)], *[kept[c].alias(c) for c in sorted(kept)]
    )


def _each(per_column):
    def apply(df: DataFrame, s: Settings, state: dict) -> DataFrame:
        filled = _fill(df, [c for c in state["columns"] if c in df.columns], s.unknown)
        coded: dict[str, Column] = {}
        for c in state["columns"]:
            coded.update(per_column(c, state["levels"][c], s, state))
        return _assemble(filled, s, state, coded)

    return apply


def ordinal(c, levels, s, state):
    pairs = [(level["value"], i + 1) for i, level in enumerate(levels)]
    return {c: _lookup(quoted(c), pairs, F.lit(-1))}


def onehot(c, levels, s, state):
    return {
        f"{c}_{i + 1}": F.when(quoted(c) == F.lit(level["value"]), F.lit(1)).otherwise(F.lit(0))
        for i, level in enumerate(levels)
    }


def count(c, levels, s, state):
    return {c: _lookup(quoted(c), [(v["value"], int(v["n"])) for v in levels], F.lit(0)).cast("long")}


def target(c, levels, s, state):
    prior = state["prior"]
    pairs = []
    for level in levels:
        weight = 1.0 / (1.0 + math.exp(-(level["n"] - s.min_samples) / s.smoothing))
        pairs.append((level["value"], float(prior * (1.0 - weight) + level["mean"] * weight)))
    return {c: _lookup(quoted(c), pairs, F.lit(float(prior)))}


@register
class FeatureEncoding(Stage):
    """Codes for text columns. Columns with too many levels are dropped, missing texts are a level."""

    STAGE = "feature_encoding"
    METHODS = {
        "ordinal": (fit_levels, _each(ordinal)),
        "onehot": (fit_levels, _each(onehot)),
        "count": (fit_levels, _each(count)),
        "target": (fit_levels, _each(target)),
    }
    OPTIONS = {
        "max_levels": 100,
        "max_share": 0.5,
        "unknown": "Unknown",
        "drop_columns": ["Genres"],
        "min_samples": 20,
        "smoothing": 10.0,
    }
