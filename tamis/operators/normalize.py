"""Normalization of numeric columns; missing numbers first take the full training mean."""

from __future__ import annotations

import math
import statistics

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.keys import SPLIT
from tamis.functions.quantiles import constant_array, exact_quantiles
from tamis.functions.schema import numeric_columns, quoted
from tamis.functions.stats import summaries
from tamis.operators.base import Settings, Stage, literal, register, training_sample


def _fit(learn):
    def fit(df: DataFrame, s: Settings) -> dict:
        columns = numeric_columns(df, s.label)
        train = df.where(F.col(SPLIT) == "train")
        means = summaries(train, {c: quoted(c) for c in columns}, {"mean": F.avg})
        fills = {c: means[c]["mean"] for c in columns}
        sample = training_sample(df, s.degree)
        values = {c: _filled(c, fills[c]) for c in columns}
        return {"columns": columns, "fills": fills, "by": learn(sample, values, s) if columns else {}}

    return fit


def _apply(rule):
    def apply(df: DataFrame, s: Settings, state: dict) -> DataFrame:
        done = {c: rule(_filled(c, state["fills"][c]), state["by"].get(c), s, state) for c in state["columns"]}
        return df.select(*[done[c].alias(c) if c in done else quoted(c) for c in df.columns])

    return apply


def _filled(c: str, fill) -> Column:
    return F.coalesce(quoted(c).cast("double"), literal(fill).cast("double"))


def _scale(value) -> float:
    """Divisor of a spread; a zero spread divides by one."""
    return float(value) if value else 1.0


def learn_zscore(sample, values, s):
    stats = summaries(sample, values, {"m": F.avg, "d": F.stddev_pop})
    return {c: [v["m"], _scale(v["d"])] for c, v in stats.items()}


def learn_robust(sample, values, s):
    q = exact_quantiles(sample, values, [0.25, 0.5, 0.75])
    return {c: [v[1], _scale(None if v[0] is None else v[2] - v[0])] for c, v in q.items()}


def learn_minmax(sample, values, s):
    stats = summaries(sample, values, {"lo": F.min, "hi": F.max})
    return {c: [v["lo"], _scale(None if v["lo"] is None else v["hi"] - v["lo"])] for c, v in stats.items()}


def learn_maxabs(sample, values, s):
    stats = summaries(sample, {c: F.abs(v) for c, v in values.items()}, {"hi": F.max})
    return {c: [0.0, _scale(v["hi"])] for c, v in stats.items()}


def shift_scale(x, by, s, state):
    return (x - literal(by[0])) / F.lit(by[1])


def learn_nothing(sample, values, s):
    return {}


def unit_length(x, by, s, state):
    squares = None
    for c in state["columns"]:
        v = _filled(c, state["fills"][c])
        squares = v * v if squares is None else squares + v * v
    length = F.sqrt(squares)
    return F.when(length > 0, x / length).otherwise(x)


def learn_sigmoid(sample, values, s):
    """One mean and one sample deviation over all values of the fitted matrix."""
    stats = summaries(sample, values, {"n": F.count, "m": F.avg, "v": F.var_pop})
    n = sum(v["n"] for v in stats.values())
    if not n:
        return {c: [0.0, 1.0] for c in values}
    mean = sum(v["n"] * v["m"] for v in stats.values() if v["n"]) / n
    squares = sum(v["n"] * (v["v"] + (v["m"] - mean) ** 2) for v in stats.values() if v["n"])
    return {c: [mean, _scale(math.sqrt(squares / (n - 1)) if n > 1 else 0.0)] for c in values}


def sigmoid(x, by, s, state):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x - F.lit(by[0])) / F.lit(by[1])))


def learn_knots(sample, values, s):
    """Empirical quantiles as distinct knots, each with its first and last probability."""
    rows = sample.count()
    k = max(1, min(int(s.max_knots), rows))
    probs = np.linspace(0.0, 1.0, k).tolist()
    out = {}
    for c, q in exact_quantiles(sample, values, probs).items():
        knots, first, last = [], [], []
        for p, v in zip(probs, q):
            if v is None:
                continue
            # equal neighbours may interpolate to values an ulp apart
            if knots and v <= knots[-1] + 1e-12 * max(1.0, abs(knots[-1])):
                last[-1] = p
            else:
                knots.append(float(v))
                first.append(p)
                last.append(p)
        out[c] = [knots, first, last]
    return out


def _apply_knots(finish):
    """The knot interval is found by binary search in the JVM, the rest is array arithmetic."""

    def apply(df: DataFrame, s: Settings, state: dict) -> DataFrame:
        columns = [c for c in state["columns"] if state["by"].get(c) and state["by"][c][0]]
        names = df.columns
        wide = df.select("*", *[_filled(c, state["fills"][c]).alias(f"__v{i}") for i, c in enumerate(columns)])
        searched = [(i, c) for i, c in enumerate(columns) if len(state["by"][c][0]) > 1]
        if searched:
            wide = Bucketizer(
                splitsArray=[[-math.inf, *state["by"][c][0], math.inf] for _, c in searched],
                inputCols=[f"__v{i}" for i, _ in searched],
                outputCols=[f"__b{i}" for i, _ in searched],
                handleInvalid="keep",
            ).transform(wide)
        # one projection per step: a later step names a column instead of repeating its expression
        parts = []
        for i, c in searched:
            knots, first, last = (constant_array(v) for v in state["by"][c])
            at = F.col(f"__b{i}").cast("int")
            parts += [
                F.get(knots, at - 1).alias(f"__l{i}"),
                F.get(knots, at).alias(f"__r{i}"),
                F.get(first, at - 1).alias(f"__p{i}"),
                F.get(last, at - 1).alias(f"__q{i}"),
                F.get(first, at).alias(f"__n{i}"),
            ]
        wide = wide.select("*", *parts)
        places = []
        for i, c in enumerate(columns):
            knots = state["by"][c][0]
            x = F.col(f"__v{i}")
            y = F.when(x <= F.lit(knots[0]), F.lit(0.0)).when(x >= F.lit(knots[-1]), F.lit(1.0))
            if len(knots) > 1:
                left, right, before, low, high = (F.col(f"__{tag}{i}") for tag in "lrpqn")
                y = y.when(x == left, (before + low) / 2).when(
                    x.isNotNull(), low + (x - left) / (right - left) * (high - low)
                )
            places.append(y.alias(f"__y{i}"))
        wide = wide.select(*[quoted(c) for c in names], *places)
        at = {c: i for i, c in enumerate(columns)}
        return wide.select(*[finish(F.col(f"__y{at[c]}")).alias(c) if c in at else quoted(c) for c in names])

    return apply


def as_is(y: Column) -> Column:
    return y


# Rational approximation of the inverse normal distribution function
# (Wichura, Algorithm AS 241, PPND16), numerators and denominators from the constant term up.
CENTRE_NUM = (
    3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
    45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727,
)
CENTRE_DEN = (
    1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
    21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610,
)
MIDDLE_NUM = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640,
)
MIDDLE_DEN = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
    0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9,
)
TAIL_NUM = (
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
    0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7,
)
TAIL_DEN = (
    1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
    0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)
NORMAL_BOUND = 1e-7


def _poly(coefficients, r: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * r + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Inverse normal distribution function for p in (0, 1)."""
    q = p - F.lit(0.5)
    r0 = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    side = F.when(q < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    r1, r2 = tail - F.lit(1.6), tail - F.lit(5.0)
    return (
        F.when(F.abs(q) <= 0.425, q * _poly(CENTRE_NUM, r0) / _poly(CENTRE_DEN, r0))
        .when(tail <= 5.0, side * _poly(MIDDLE_NUM, r1) / _poly(MIDDLE_DEN, r1))
        .otherwise(side * _poly(TAIL_NUM, r2) / _poly(TAIL_DEN, r2))
    )


def to_normal(y: Column) -> Column:
    floor = statistics.NormalDist().inv_cdf(NORMAL_BOUND - float(np.spacing(1.0)))
    inner = F.when((y > NORMAL_BOUND) & (y < 1.0 - NORMAL_BOUND), y).otherwise(F.lit(0.5))
    value = F.least(F.greatest(probit(inner), F.lit(floor)), F.lit(-floor))
    return F.when(y <= NORMAL_BOUND, F.lit(floor)).when(y >= 1.0 - NORMAL_BOUND, F.lit(-floor)).when(y.isNotNull(), value)


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The four branches of the transform; ``lam`` may be a column."""
    up, down = F.log1p(F.greatest(x, F.lit(0.0))), F.log1p(F.greatest(-x, F.lit(0.0)))
    other = F.lit(2.0) - lam
    safe = F.when(F.abs(lam) < 1e-9, F.lit(1.0)).otherwise(lam)
    safe_other = F.when(F.abs(other) < 1e-9, F.lit(1.0)).otherwise(other)
    return F.when(
        x >= 0, F.when(F.abs(lam) < 1e-9, up).otherwise((F.exp(lam * up) - 1.0) / safe)
    ).otherwise(F.when(F.abs(other) < 1e-9, -down).otherwise(-(F.exp(other * down) - 1.0) / safe_other))


def learn_power(sample, values, s):
    """Likelihood-fitted exponent by a grid that narrows fivefold per pass, all columns at once."""
    names = list(values)
    steps = [0.5]
    while steps[-1] > s.lambda_step * 1.0001:
        steps.append(steps[-1] / 5)
    centre = {c: 0.0 for c in names}
    base = sample.select(*[values[c].alias(f"x{i}") for i, c in enumerate(names)])
    for turn, step in enumerate(steps):
        points = range(-10, 11) if turn == 0 else range(-5, 6)
        items = F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("c"), F.lit(j).alias("j"), F.lit(round(centre[c] + j * step, 9)).alias("lam"), F.col(f"x{i}").alias("x"))
                    for i, c in enumerate(names)
                    for j in points
                ]
            )
        ).alias("item")
        rows = (
            base.select(items)
            .select("item.*")
            .groupBy("c", "j", "lam")
            .agg(
                F.count("x").alias("n"),
                F.var_pop(yeo_johnson(F.col("x"), F.col("lam"))).alias("v"),
                F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("t"),
            )
            .collect()
        )
        best: dict[int, tuple[float, float]] = {}
        for r in sorted(rows, key=lambda r: (r["c"], r["j"])):
            if not r["v"] or r["v"] <= 0:
                continue
            fit = -r["n"] / 2 * math.log(r["v"]) + (r["lam"] - 1.0) * r["t"]
            if r["c"] not in best or fit > best[r["c"]][0]:
                best[r["c"]] = (fit, r["lam"])
        for i, c in enumerate(names):
            centre[c] = best[i][1] if i in best else 1.0
    stats = summaries(sample, {c: yeo_johnson(values[c], F.lit(centre[c])) for c in names}, {"m": F.avg, "d": F.stddev_pop})
    return {c: [centre[c], stats[c]["m"], _scale(stats[c]["d"])] for c in names}


def power(x, by, s, state):
    return (yeo_johnson(x, F.lit(by[0])) - literal(by[1])) / F.lit(by[2])


def learn_even_bins(sample, values, s):
    stats = summaries(sample, values, {"lo": F.min, "hi": F.max})
    out = {}
    for c, v in stats.items():
        if v["lo"] is None or v["hi"] == v["lo"]:
            out[c] = []
        else:
            width = (v["hi"] - v["lo"]) / s.bins
            out[c] = [v["lo"] + j * width for j in range(1, s.bins)]
    return out


def learn_quantile_bins(sample, values, s):
    q = exact_quantiles(sample, values, [j / s.bins for j in range(s.bins + 1)])
    out = {}
    for c, edges in q.items():
        if edges[0] is None:
            out[c] = []
            continue
        kept = [edges[0]]
        for before, edge in zip(edges, edges[1:]):
            if edge - before > 1e-8:
                kept.append(edge)
        out[c] = kept[1:-1]
    return out


def bin_code(x, by, s, state):
    code = F.lit(0.0)
    for edge in by or []:
        code = code + F.when(x >= F.lit(edge), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(x.isNotNull(), code)


@register
class Normalization(Stage):
    """Numeric columns become doubles on a common scale; other columns pass."""

    STAGE = "data_normalization"
    METHODS = {
        "z_score": (_fit(learn_zscore), _apply(shift_scale)),
        "robust": (_fit(learn_robust), _apply(shift_scale)),
        "min_max": (_fit(learn_minmax), _apply(shift_scale)),
        "max_abs": (_fit(learn_maxabs), _apply(shift_scale)),
        "normalizer": (_fit(learn_nothing), _apply(unit_length)),
        "sigmoid": (_fit(learn_sigmoid), _apply(sigmoid)),
        "quantile_uniform": (_fit(learn_knots), _apply_knots(as_is)),
        "quantile_normal": (_fit(learn_knots), _apply_knots(to_normal)),
        "power": (_fit(learn_power), _apply(power)),
        "kbins_uniform": (_fit(learn_even_bins), _apply(bin_code)),
        "kbins_quantile": (_fit(learn_quantile_bins), _apply(bin_code)),
    }
    OPTIONS = {"bins": 5, "max_knots": 1000, "lambda_step": 0.00004}
