"""Outlier handling inside the degree sample of each split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.keys import SPLIT, in_sample
from tamis.functions.quantiles import exact_quantiles
from tamis.functions.schema import numeric_columns, quoted
from tamis.functions.stats import summaries
from tamis.operators.base import Settings, Stage, register, training_sample
from tamis.operators.density import apply_lof, fit_lof

SPLITS = ("train", "val", "test")


def _per_split(df: DataFrame, degree: float, values: dict[str, Column], probs: list[float]) -> dict:
    """Quantiles of every (split, column) pair over the split's own sample, as extra columns of one pass."""
    here = in_sample(degree)
    wanted = {
        f"{split}\t{c}": F.when((F.col(SPLIT) == split) & here, v) for split in SPLITS for c, v in values.items()
    }
    q = exact_quantiles(df, wanted, probs)
    out: dict = {split: {} for split in SPLITS}
    for key, value in q.items():
        split, c = key.split("\t", 1)
        out[split][c] = value
    return out


def _limits(df: DataFrame, names: list[str], table: dict) -> DataFrame:
    """``df`` with one column per name, its value for the row's split.

    The values come by a join, so no condition on them sinks below the projection that computes the row keys.
    """
    rows = [(split, *[None if v is None else float(v) for v in table[split]]) for split in SPLITS]
    limits = df.sparkSession.createDataFrame(rows, ", ".join([f"{SPLIT} string", *[f"`{n}` double" for n in names]]))
    return df.join(F.broadcast(limits), SPLIT, "left")  # three rows


def fit_zsb(df: DataFrame, s: Settings) -> dict:
    columns = numeric_columns(df, s.label)
    values = {c: quoted(c).cast("double") for c in columns}
    medians = _per_split(df, s.degree, values, [0.5])
    names = [f"__m{i}" for i in range(len(columns))]
    centred = _limits(df, names, {split: [medians[split][c][0] for c in columns] for split in SPLITS}) if columns else df
    spread = {c: F.abs(values[c] - F.col(name)) for c, name in zip(columns, names)}
    mads = _per_split(centred, s.degree, spread, [0.5])
    return {"columns": columns, "median": medians, "mad": mads}


def apply_zsb(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    columns, flags = state["columns"], []
    names = [f"__{tag}{i}" for i in range(len(columns)) for tag in "ms"]
    table = {sp: [v for c in columns for v in (state["median"][sp][c][0], state["mad"][sp][c][0])] for sp in SPLITS}
    wide = _limits(df, names, table) if columns else df
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        centre, mad = F.col(f"__m{i}"), F.col(f"__s{i}") * F.lit(s.mad_factor)
        score = F.abs(x - centre) / F.when(mad > 0, mad)
        # zero spread: every value off the median is infinitely far, the median itself is not flagged
        flags.append(F.when(mad > 0, score > F.lit(s.z_cut)).otherwise(x != centre))
    return _drop_flagged(wide, s, [F.coalesce(f, F.lit(False)) for f in flags], None).select(*[quoted(c) for c in df.columns])


def fit_iqr(df: DataFrame, s: Settings) -> dict:
    columns = numeric_columns(df, s.label)
    values = {c: quoted(c).cast("double") for c in columns}
    return {"columns": columns, "quartiles": _per_split(df, s.degree, values, [0.25, 0.75])}


def apply_iqr(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    columns, flags, values = state["columns"], [], []
    names = [f"__{tag}{i}" for i in range(len(columns)) for tag in "lh"]
    wide = _limits(df, names, {sp: [v for c in columns for v in state["quartiles"][sp][c]] for sp in SPLITS}) if columns else df
    for i, c in enumerate(columns):
        x, q1, q3 = quoted(c).cast("double"), F.col(f"__l{i}"), F.col(f"__h{i}")
        reach = F.lit(s.iqr_factor) * (q3 - q1)
        flags.append(F.coalesce((x < q1 - reach) | (x > q3 + reach), F.lit(False)))
        values.append(x)
    if s.iqr_mode not in ("value_sum", "fraction"):
        raise ValueError("iqr_mode must be 'value_sum' or 'fraction'")
    kept = _drop_flagged(wide, s, flags, values if s.iqr_mode == "value_sum" else None)
    return kept.select(*[quoted(c) for c in df.columns])


def _drop_flagged(df: DataFrame, s: Settings, flags: list[Column], values: list[Column] | None) -> DataFrame:
    if not flags:
        return df
    if s.threshold == -1:
        drop = flags[0]
        for f in flags[1:]:
            drop = drop | f
    else:
        score = F.lit(0.0)
        for i, f in enumerate(flags):
            score = score + F.when(f, values[i] if values else F.lit(1.0)).otherwise(F.lit(0.0))
        drop = score / F.lit(float(len(flags))) > F.lit(s.threshold)
    return df.where(~(in_sample(s.degree) & drop))


def fit_mad(df: DataFrame, s: Settings) -> dict:
    columns = numeric_columns(df, s.label)
    sample = training_sample(df, s.degree)
    values = {c: quoted(c).cast("double") for c in columns}
    medians = {c: q[0] for c, q in exact_quantiles(sample, values, [0.5]).items()}
    spread = {c: F.abs(values[c] - F.lit(medians[c])) for c in columns if medians[c] is not None}
    mads = {c: q[0] for c, q in exact_quantiles(sample, spread, [0.5]).items()}
    means = summaries(sample, values, {"m": F.avg})
    return {"limits": {c: [medians[c], mads[c], means[c]["m"]] for c in spread}}


def apply_mad(df: DataFrame, s: Settings, state: dict) -> DataFrame:
    """Cells far from the training median take the training mean; no row is dropped."""
    here = in_sample(s.degree)
    done = {}
    for c, (median, mad, mean) in state["limits"].items():
        if mad:
            x = quoted(c).cast("double")
            far = (x < F.lit(median - s.n_mad * mad)) | (x > F.lit(median + s.n_mad * mad))
            done[c] = F.when(here & far, F.lit(mean)).otherwise(x)
    return df.select(*[done[c].alias(c) if c in done else quoted(c) for c in df.columns])


@register
class OutlierDetection(Stage):
    """``ZSB``, ``IQR`` and ``LOF`` drop rows, ``MAD`` replaces cells. ``threshold=-1``: drop on any flag."""

    STAGE = "outlier_detection"
    METHODS = {
        "ZSB": (fit_zsb, apply_zsb),
        "IQR": (fit_iqr, apply_iqr),
        "LOF": (fit_lof, apply_lof),
        "MAD": (fit_mad, apply_mad),
    }
    EVERY_SPLIT = frozenset({"ZSB", "IQR"})
    OPTIONS = {
        "threshold": 0.3,
        "mad_factor": 1.4296,
        "z_cut": 1.6,
        "iqr_factor": 1.5,
        "iqr_mode": "value_sum",
        "n_mad": 2.5,
        "neighbours": 20,
    }
