"""Execution degrees for many plans at once.

A plan is one row with columns ``e_i`` (degree), ``lo_i``, ``hi_i`` (bounds), ``k_i``, ``b_i`` (cost line)
for its stages i = 0..d-1. Every step below is row-local arithmetic over those columns, so all plans
advance together; only scoring a batch of probes needs the rows of one plan to come together again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.keys import seeded_unit
from tamis.plans.cost import stage_seconds
from tamis.plans.objective import BUDGET_SLACK, Objective
from tamis.session import cut_lineage

TINY = 1e-12
BISECTIONS = 55
PROBES = 200_000  # rows of probes or draws in one task, about
Score = Callable[[DataFrame], DataFrame]
Cost = Callable[[list[Column]], Column]


def cols(prefix: str, d: int) -> list[Column]:
    return [F.col(f"{prefix}_{i}") for i in range(d)]


def line_cost(d: int, overhead: float | Column = 0.0) -> Cost:
    """Sum of the clipped cost lines of the stages."""

    def cost(e: list[Column]) -> Column:
        total = overhead if isinstance(overhead, Column) else F.lit(float(overhead))
        for i in range(d):
            total = total + stage_seconds(F.col(f"k_{i}"), F.col(f"b_{i}"), e[i])
        return total

    return cost


def column_score(utility: Callable[[list[Column]], Column], d: int) -> Score:
    """Wrap a utility given as an expression of the degrees; ``utility`` is kept, for points that stand in other columns."""

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("u", utility(cols("e", d)))

    score.utility = utility
    return score


def clip(e: list[Column], d: int) -> list[Column]:
    return [F.least(F.greatest(x, lo), hi) for x, lo, hi in zip(e, cols("lo", d), cols("hi", d))]


def segment_share(anchor: list[Column], target: list[Column], cost: Cost, limit: Column) -> Column:
    """Largest share of the way from a feasible anchor to the target that keeps the budget.

    NULL if the anchor itself breaks it. Bisection holds for any cost that is convex on the segment.
    """

    def over(share: Column) -> Column:
        return cost([a + share * (t - a) for a, t in zip(anchor, target)]) > limit + BUDGET_SLACK

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) * 0.5
        return F.when(over(middle), F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(
            F.struct(middle.alias("lo"), s["hi"].alias("hi"))
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve, lambda s: s["lo"])
    return F.when(over(F.lit(0.0)), F.lit(None).cast("double")).when(~over(F.lit(1.0)), F.lit(1.0)).otherwise(found)


def affine_share(anchor: list[Column], target: list[Column], cost: Cost, limit: Column) -> Column:
    """The same share in closed form, for costs that no stage clips at zero on the segment."""
    c0, c1 = cost(anchor), cost(target)
    return (
        F.when(c0 > limit + BUDGET_SLACK, F.lit(None).cast("double"))
        .when(c1 <= limit + BUDGET_SLACK, F.lit(1.0))
        .otherwise((limit - c0) / F.when(c1 != c0, c1 - c0))
    )


class Space:
    """Dimension, cost and objective shared by the allocation steps."""

    def __init__(self, d: int, objective: Objective, cost: Cost | None = None, affine: bool = False, overhead: float = 0.0):
        self.d, self.objective = d, objective
        self.cost = cost or line_cost(d, overhead)
        self.lines = cost is None
        self.affine = affine

    def share(self, anchor: list[Column], target: list[Column]) -> Column:
        limit = self.objective.limit()
        if self.affine:
            return affine_share(anchor, target, self.cost, limit)
        if not self.lines:
            return segment_share(anchor, target, self.cost, limit)
        # lines without a negative slope never clip, so only the other rows need the bisection
        rising = F.lit(True)
        for k, b in zip(cols("k", self.d), cols("b", self.d)):
            rising = rising & (k >= 0) & (b >= 0)
        return F.when(rising, affine_share(anchor, target, self.cost, limit)).otherwise(
            segment_share(anchor, target, self.cost, limit)
        )

    def toward(self, df: DataFrame, anchor: list[Column], target: list[Column], names: list[str]) -> DataFrame:
        """Add ``names``: the farthest feasible point from anchor to target."""
        if not self.objective.bounded:
            return df.select("*", *[t.alias(n) for t, n in zip(target, names)])
        marked = df.withColumn("__a", self.share(anchor, target))
        moved = [a + F.col("__a") * (t - a) for a, t in zip(anchor, target)]
        return marked.select("*", *[m.alias(n) for m, n in zip(moved, names)]).drop("__a")

    def startable(self, df: DataFrame) -> DataFrame:
        """Plans whose lower bounds are affordable. Tested on the bounds, before any point is computed:
        a filter on a computed point would be pushed below it and repeat its whole expression."""
        return df.where(self.objective.feasible(self.cost(cols("lo", self.d))))

    def priced(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cost", self.cost(cols("e", self.d)))


def balanced_start(df: DataFrame, space: Space) -> DataFrame:
    """Degrees on the line from the lower to the upper bounds; plans whose lower bounds cost too much are dropped."""
    d = space.d
    names = [f"e_{i}" for i in range(d)]
    return space.toward(space.startable(df).drop(*names), cols("lo", d), cols("hi", d), names)


def random_start(df: DataFrame, space: Space, keys: list[str], start: int, seed: int) -> DataFrame:
    d = space.d
    names = [f"e_{i}" for i in range(d)]
    draws = [
        lo + seeded_unit(seed, "start", start, i, *[F.col(k) for k in keys]) * (hi - lo)
        for i, (lo, hi) in enumerate(zip(cols("lo", d), cols("hi", d)))
    ]
    drawn = space.startable(df).drop(*names).select("*", *[x.alias(f"__t_{i}") for i, x in enumerate(draws)])
    return space.toward(drawn, cols("lo", d), cols("__t", d), names).drop(*[f"__t_{i}" for i in range(d)])


def coordinate_slopes(space: Space) -> list[Column]:
    """Cost increase per unit of each degree, from the bounds."""
    d, low, high = space.d, cols("lo", space.d), cols("hi", space.d)
    base = space.cost(low)
    out = []
    for i in range(d):
        raised = [high[j] if j == i else low[j] for j in range(d)]
        width = high[i] - low[i]
        out.append(F.when(width > TINY, F.greatest(F.lit(0.0), (space.cost(raised) - base) / width)).otherwise(F.lit(0.0)))
    return out


def linear_oracle(df: DataFrame, space: Space, gradient: list[Column], names: list[str]) -> DataFrame:
    """Best point of a linear utility within the budget: a fractional knapsack by gain per cost.

    What a coordinate receives depends on the cost of the coordinates ranked before it, a sum over the
    stages of the same row.
    """
    d, low, high = space.d, cols("lo", space.d), cols("hi", space.d)
    if not space.objective.bounded:
        return df.select("*", *[F.when(g > 0, h).otherwise(lo).alias(n) for g, lo, h, n in zip(gradient, low, high, names)])
    slopes = coordinate_slopes(space)
    staged = df.select("*", *[s.alias(f"__s_{i}") for i, s in enumerate(slopes)], *[g.alias(f"__g_{i}") for i, g in enumerate(gradient)])
    s, g = cols("__s", d), cols("__g", d)
    free = [(g[i] > 0) & (s[i] <= TINY) for i in range(d)]
    base = [F.when(free[i], high[i]).otherwise(low[i]) for i in range(d)]
    paid = [(g[i] > 0) & (s[i] > TINY) for i in range(d)]
    staged = staged.withColumn("__left", F.greatest(F.lit(0.0), space.objective.limit() - space.cost(base))).select(
        "*", *[F.when(paid[i], g[i] / F.when(s[i] > TINY, s[i])).alias(f"__r_{i}") for i in range(d)]
    )
    r = cols("__r", d)
    target = []
    for i in range(d):
        before = F.lit(0.0)
        for j in range(d):
            if j != i:
                first = (r[j] > r[i]) | (r[j] == r[i]) if j < i else r[j] > r[i]
                before = before + F.when(r[j].isNotNull() & first, s[j] * (high[j] - low[j])).otherwise(F.lit(0.0))
        extra = F.least(high[i] - low[i], F.greatest(F.lit(0.0), F.col("__left") - before) / F.when(s[i] > TINY, s[i]))
        target.append(F.when(r[i].isNotNull(), low[i] + extra).otherwise(base[i]))
    staged = staged.select("*", *[t.alias(f"__o_{i}") for i, t in enumerate(target)])
    helpers = [f"__{tag}_{i}" for tag in "sgro" for i in range(d)] + ["__left"]
    # the knapsack is exact for unclipped lines; the segment repairs the rest
    return space.toward(staged, low, cols("__o", d), names).drop(*helpers)


def gaussian_directions(keys: list[str], d: int, count: int, seed: int, iteration: int) -> list[list[Column]]:
    """Unit vectors per plan and iteration from hashed uniforms (Box-Muller)."""
    out = []
    for q in range(count):
        raw = []
        for i in range(d):
            base = [F.lit(seed), F.lit(iteration), F.lit(q), F.lit(i), *[F.col(k) for k in keys]]
            u1 = (F.pmod(F.xxhash64(F.lit("a"), *base), F.lit(2**31 - 1)) + 1) / float(2**31)
            u2 = F.pmod(F.xxhash64(F.lit("b"), *base), F.lit(2**31 - 1)) / float(2**31)
            raw.append(F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2))
        length = F.sqrt(sum((x * x for x in raw[1:]), raw[0] * raw[0]))
        out.append([x / length for x in raw])
    return out


def _state(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def smoothed_gradient(
    df: DataFrame, space: Space, score: Score, keys: list[str], directions: list[list[Column]], radius: float
) -> DataFrame:
    """Add ``g_i`` from antithetic probe pairs along the directions, and ``probe``: the best probe seen."""
    d = space.d
    ranges = [F.greatest(hi - lo, F.lit(TINY)) for lo, hi in zip(cols("lo", d), cols("hi", d))]
    items = []
    for q, direction in enumerate(directions):
        for sign in (1.0, -1.0):
            target = clip([e + sign * radius * w * x for e, w, x in zip(cols("e", d), ranges, direction)], d)
            items.append(F.struct(F.lit(q).alias("q"), F.lit(sign).alias("sign"), *[t.alias(f"t_{i}") for i, t in enumerate(target)]))
    rows = df.select("*", F.posexplode(F.array(*items)).alias("__at", "__item"))
    rows = rows.select(*df.columns, F.col("__at"), F.col("__item.q").alias("__q"), F.col("__item.sign").alias("__sign"), *[F.col(f"__item.t_{i}").alias(f"__t_{i}") for i in range(d)])
    rows = rows.select("*", *[F.col(f"e_{i}").alias(f"__e_{i}") for i in range(d)])
    rows = space.toward(rows.drop(*[f"e_{i}" for i in range(d)]), cols("__e", d), cols("__t", d), [f"e_{i}" for i in range(d)])
    rows = score(space.priced(rows)).withColumn("__v", space.objective.value(F.col("u"), F.col("cost")))
    state = [c for c in _state(df, keys) if not c.startswith("e_")]
    probe = F.max(F.struct(space.objective.preference(F.col("u"), F.col("cost")).alias("p"), F.col("u"), F.col("cost"), *cols("e", d)))
    # one row per plan and direction, then one per plan: both grouped by the plan keys' partitioning
    pairs = rows.groupBy(*keys, "__q").agg(
        *[F.first(c).alias(c) for c in state],
        *[F.first(f"__e_{i}").alias(f"e_{i}") for i in range(d)],
        probe.alias("__probe"),
        F.sum(F.col("__v") * F.col("__sign")).alias("__dv"),
        *[F.sum(F.col(f"e_{i}") * F.col("__sign")).alias(f"__d_{i}") for i in range(d)],
    )
    delta = [F.col(f"__d_{i}") / ranges[i] for i in range(d)]
    square = sum((x * x for x in delta[1:]), delta[0] * delta[0])
    valid = F.sqrt(square) > TINY
    # derivative along the unit delta is dv/|delta|, times delta/|delta|, times the dimension
    parts = [F.when(valid, d * F.col("__dv") * x / F.when(square > 0, square)) for x in delta]
    done = pairs.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in state],
        *[F.first(f"e_{i}").alias(f"e_{i}") for i in range(d)],
        F.max("__probe").alias("probe"),
        *[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"g_{i}") for i, x in enumerate(parts)],
    )
    return done.select(*keys, *state, *[f"e_{i}" for i in range(d)], *[(F.col(f"g_{i}") / ranges[i]).alias(f"g_{i}") for i in range(d)], "probe")


def _signed(plus: Column, minus: Column) -> Column:
    """The sum of both outcomes of a pair with their signs, as an aggregate takes it: nulls are left out."""
    return F.coalesce(plus - minus, plus, -minus)


def smoothed_gradient_in_row(
    df: DataFrame, space: Space, utility: Callable[[list[Column]], Column], directions: list[list[Column]], radius: float
) -> DataFrame:
    """What ``smoothed_gradient`` adds, for plans of one row each and a utility of columns: the probes are columns of the plan."""
    d, at, spread = space.d, range(space.d), cols("__w", space.d)
    kept = [F.col(f"`{c}`") for c in df.columns]
    probes = [(q, sign) for q in range(len(directions)) for sign in (1.0, -1.0)]
    name = lambda tag, k: [f"__{tag}_{k}_{i}" for i in at]
    several = lambda tag, k: [F.col(c) for c in name(tag, k)]
    ranges = [F.greatest(hi - lo, F.lit(TINY)).alias(f"__w_{i}") for i, (lo, hi) in enumerate(zip(cols("lo", d), cols("hi", d)))]
    rows = df.select(*kept, *ranges, *[x.alias(f"__n_{q}_{i}") for q, direction in enumerate(directions) for i, x in enumerate(direction)])
    tried = []
    for k, (q, sign) in enumerate(probes):
        target = clip([e + sign * radius * w * x for e, w, x in zip(cols("e", d), spread, several("n", q))], d)
        tried += [t.alias(c) for t, c in zip(target, name("t", k))]
    rows = rows.select(*kept, *spread, *tried)
    if space.objective.bounded:
        far = [space.share(cols("e", d), several("t", k)).alias(f"__a_{k}") for k in range(len(probes))]
        rows = rows.select(*kept, *spread, *[F.col(c) for k in range(len(probes)) for c in name("t", k)], *far)
        moved = [(e + F.col(f"__a_{k}") * (t - e)).alias(c) for k in range(len(probes)) for e, t, c in zip(cols("e", d), several("t", k), name("p", k))]
    else:
        moved = [t.alias(c) for k in range(len(probes)) for t, c in zip(several("t", k), name("p", k))]
    points = [F.col(c) for k in range(len(probes)) for c in name("p", k)]
    rows = rows.select(*kept, *spread, *moved)
    rows = rows.select(
        *kept, *spread, *points, *[x.alias(f"__{tag}_{k}") for k in range(len(probes)) for tag, x in (("u", utility(several("p", k))), ("c", space.cost(several("p", k))))]
    )
    value = [space.objective.value(F.col(f"__u_{k}"), F.col(f"__c_{k}")) for k in range(len(probes))]
    seen = []
    for k in range(len(probes)):
        u, cost = F.col(f"__u_{k}"), F.col(f"__c_{k}")
        seen.append(F.struct(space.objective.preference(u, cost).alias("p"), u.alias("u"), cost.alias("cost"), *[x.alias(f"e_{i}") for i, x in enumerate(several("p", k))]))
    pairs = [_signed(value[2 * q], value[2 * q + 1]).alias(f"__v_{q}") for q in range(len(directions))]
    pairs += [(_signed(a, b) / w).alias(f"__d_{q}_{i}") for q in range(len(directions)) for i, (a, b, w) in enumerate(zip(several("p", 2 * q), several("p", 2 * q + 1), spread))]
    rows = rows.select(*kept, *spread, F.greatest(*seen).alias("probe"), *pairs)
    parts = [[] for _ in at]
    for q in range(len(directions)):
        delta = several("d", q)
        square = sum((x * x for x in delta[1:]), delta[0] * delta[0])
        for i in at:
            parts[i].append(F.when(F.sqrt(square) > TINY, d * F.col(f"__v_{q}") * delta[i] / F.when(square > 0, square)).alias(f"__g_{q}_{i}"))
    rows = rows.select(*kept, *spread, "probe", *[x for part in parts for x in part])
    out = []
    for i in at:
        mine = [F.col(f"__g_{q}_{i}") for q in range(len(directions))]
        counted = sum((x.isNotNull().cast("int") for x in mine), F.lit(0))
        total = sum((F.coalesce(x, F.lit(0.0)) for x in mine), F.lit(0.0))
        out.append((F.when(counted > 0, total / counted).otherwise(F.lit(0.0)) / spread[i]).alias(f"g_{i}"))
    return rows.select(*kept, *out, "probe")


def coordinate_gradient(df: DataFrame, space: Space, score: Score, keys: list[str], step: float = 0.02) -> DataFrame:
    """Add ``g_i`` by central differences per coordinate, and ``probe``: the best probe seen."""
    d = space.d
    e = cols("e", d)
    ranges = [F.greatest(hi - lo, F.lit(TINY)) for lo, hi in zip(cols("lo", d), cols("hi", d))]
    items = []
    for i in range(d):
        for sign in (1.0, -1.0):
            target = clip([e[j] + sign * step * ranges[j] if j == i else e[j] for j in range(d)], d)
            items.append(F.struct(F.lit(i).alias("q"), F.lit(sign).alias("sign"), *[t.alias(f"t_{j}") for j, t in enumerate(target)]))
    rows = df.select(*df.columns, F.explode(F.array(*items)).alias("__item"))
    rows = rows.select(*df.columns, F.col("__item.q").alias("__q"), F.col("__item.sign").alias("__sign"), *[F.col(f"__item.t_{i}").alias(f"__t_{i}") for i in range(d)])
    rows = rows.select("*", *[F.col(f"e_{i}").alias(f"__e_{i}") for i in range(d)]).drop(*[f"e_{i}" for i in range(d)])
    rows = score(space.priced(space.toward(rows, cols("__e", d), cols("__t", d), [f"e_{i}" for i in range(d)])))
    state = [c for c in _state(df, keys) if not c.startswith("e_")]
    probe = F.max(F.struct(space.objective.preference(F.col("u"), F.col("cost")).alias("p"), F.col("u"), F.col("cost"), *cols("e", d)))

    def slope(i: int) -> Column:
        mine = F.col("__q") == i
        gain = F.sum(F.when(mine, F.col("u") * F.col("__sign")))
        gap = F.sum(F.when(mine, F.col(f"e_{i}") * F.col("__sign")))
        return F.coalesce(F.when(F.abs(gap) > TINY, gain / F.when(F.abs(gap) > TINY, gap)), F.lit(0.0))

    return rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in state],
        *[F.first(f"__e_{i}").alias(f"e_{i}") for i in range(d)],
        *[slope(i).alias(f"g_{i}") for i in range(d)],
        probe.alias("probe"),
    )


def _better(space: Space) -> Column:
    """Keep the best of the stored candidate, the round's probes and the new point."""
    d = space.d
    new = F.struct(space.objective.preference(F.col("u"), F.col("cost")).alias("p"), F.col("u"), F.col("cost"), *cols("e", d))
    return F.greatest(F.col("best"), F.col("probe"), new)


def _first_best(space: Space) -> Column:
    return F.struct(space.objective.preference(F.col("u"), F.col("cost")).alias("p"), F.col("u"), F.col("cost"), *cols("e", space.d))


def frank_wolfe(
    plans: DataFrame,
    space: Space,
    score: Score,
    keys: list[str],
    rounds: int = 20,
    directions: int = 3,
    radius: float = 0.10,
    radius_decay: float = 0.25,
    starts: int = 2,
    gap_tolerance: float = 1e-3,
    patience: int = 2,
    min_rounds: int = 3,
    step_numerator: float = 2.0,
    step_offset: float = 3.0,
    seed: int = 42,
    checkpoint_every: int = 4,
) -> DataFrame:
    """Zeroth-order Frank-Wolfe over all plans together; one row per plan with its best candidate.

    Rows of equal keys become one plan in the first round. From then on a plan and start is one row, and the probes
    of a utility of columns need no grouping.
    """
    d, utility = space.d, getattr(score, "utility", None)
    runs = [balanced_start(plans, space)]
    for s in range(1, starts):
        if s == 1 and not space.objective.bounded:
            runs.append(plans.drop(*[f"e_{i}" for i in range(d)]).select("*", *[F.col(f"lo_{i}").alias(f"e_{i}") for i in range(d)]))
        else:
            runs.append(random_start(plans, space, keys, s, seed))
    state = runs[0].withColumn("start", F.lit(0))
    for s, run in enumerate(runs[1:], 1):
        state = state.unionByName(run.withColumn("start", F.lit(s)))
    at = [*keys, "start"]
    state = dealt(state, keys, 2 * directions)
    state = score(space.priced(state)).withColumn("best", _first_best(space)).withColumn("calm", F.lit(0)).withColumn("live", F.lit(True))
    finished = []
    for turn in range(rounds):
        width = max(1e-5, radius / (turn + 1.0) ** radius_decay)
        drawn = gaussian_directions(at, d, directions, seed, turn)
        if utility is None:
            state = smoothed_gradient(state.drop("u", "cost"), space, score, at, drawn, width)
        elif turn:
            state = smoothed_gradient_in_row(state.drop("u", "cost"), space, utility, drawn, width)
        else:
            state = _first_gradient(state.drop("u", "cost"), space, score, at, drawn, width)
        state = _advance(state, space, score, turn, min(1.0, step_numerator / (turn + step_offset)), gap_tolerance, patience, min_rounds)
        if (turn + 1) % checkpoint_every == 0 and turn + 1 < rounds:
            state = cut_lineage(state)
            finished.append(state.where("not live"))
            state = state.where("live")
            if state.isEmpty():
                break
    return _unpack(_together(state, finished).groupBy(*keys).agg(F.max("best").alias("best")), keys, d)


def _first_gradient(state: DataFrame, space: Space, score: Score, at: list[str], directions: list[list[Column]], radius: float) -> DataFrame:
    """The gradient of the first round: only rows that share their keys with others are grouped."""
    counted = state.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*at)))
    alone = smoothed_gradient_in_row(counted.where("__n = 1").drop("__n"), space, score.utility, directions, radius)
    return alone.unionByName(smoothed_gradient(counted.where("__n > 1").drop("__n"), space, score, at, directions, radius))


def _together(state: DataFrame, finished: list[DataFrame]) -> DataFrame:
    out = state.select(*[c for c in state.columns if c not in ("u", "cost")])
    for part in finished:
        out = out.unionByName(part.drop("u", "cost"))
    return out


def _advance(df, space, score, turn, step, gap_tolerance, patience, min_rounds) -> DataFrame:
    d = space.d
    df = linear_oracle(df, space, cols("g", d), [f"__x_{i}" for i in range(d)])
    gap = F.greatest(F.lit(0.0), sum((F.col(f"g_{i}") * (F.col(f"__x_{i}") - F.col(f"e_{i}")) for i in range(1, d)), F.col("g_0") * (F.col("__x_0") - F.col("e_0"))))
    df = df.withColumn("calm", F.when(gap <= gap_tolerance, F.col("calm") + 1).otherwise(F.lit(0)))
    done = (F.col("calm") >= patience) if turn + 1 >= min_rounds else F.lit(False)
    # a plan that has stopped stays where it is until its rows are set aside at the next checkpoint
    df = df.withColumn("__done", done | ~F.col("live"))
    target = clip([(1.0 - step) * e + step * x for e, x in zip(cols("e", d), cols("__x", d))], d)
    df = df.select("*", *[F.when(F.col("__done"), e).otherwise(t).alias(f"__t_{i}") for i, (e, t) in enumerate(zip(cols("e", d), target))])
    df = df.select(*[c for c in df.columns if not c.startswith("e_")], *[F.col(f"e_{i}").alias(f"__e_{i}") for i in range(d)])
    df = space.toward(df, cols("__e", d), cols("__t", d), [f"e_{i}" for i in range(d)])
    still = F.lit(True)
    for i in range(d):
        still = still & (F.abs(F.col(f"e_{i}") - F.col(f"__e_{i}")) <= TINY)
    stop = F.col("__done") | (still if turn + 1 >= min_rounds else F.lit(False))
    df = df.withColumn("live", ~stop)
    df = score(space.priced(df)).withColumn("best", F.when(F.col("__done"), F.greatest("best", "probe")).otherwise(_better(space)))
    return df.drop("probe", "__done", *[f"__{t}_{i}" for t in ("x", "t", "e") for i in range(d)], *[f"g_{i}" for i in range(d)])


def frank_wolfe_deterministic(
    plans: DataFrame, space: Space, score: Score, keys: list[str], rounds: int = 200, step: float = 0.02,
    points: int = 21, gap_tolerance: float = 1e-4, patience: int = 2, min_rounds: int = 3, checkpoint_every: int = 4,
) -> DataFrame:
    """Coordinate differences and a grid search on the segment; one start."""
    state = dealt(balanced_start(plans, space), keys, points)
    state = score(space.priced(state)).withColumn("best", _first_best(space)).withColumn("calm", F.lit(0)).withColumn("live", F.lit(True))
    finished = []
    for turn in range(rounds):
        state = deterministic_round(state.drop("u", "cost"), space, score, keys, step, points, gap_tolerance, patience, turn + 1 >= min_rounds)
        if (turn + 1) % checkpoint_every == 0 and turn + 1 < rounds:
            state = cut_lineage(state)
            finished.append(state.where("not live"))
            state = state.where("live")
            if state.isEmpty():
                break
    return _unpack(_together(state, finished).select(*keys, "best"), keys, space.d)


def deterministic_round(df, space, score, keys, step=0.02, points=21, gap_tolerance=1e-4, patience=2, may_stop=True) -> DataFrame:
    d = space.d
    df = coordinate_gradient(df, space, score, keys, step)
    df = linear_oracle(df, space, cols("g", d), [f"__x_{i}" for i in range(d)])
    gap = F.greatest(F.lit(0.0), sum((F.col(f"g_{i}") * (F.col(f"__x_{i}") - F.col(f"e_{i}")) for i in range(1, d)), F.col("g_0") * (F.col("__x_0") - F.col("e_0"))))
    df = df.withColumn("calm", F.when(gap <= gap_tolerance, F.col("calm") + 1).otherwise(F.lit(0)))
    df = df.withColumn("__done", ((F.col("calm") >= patience) if may_stop else F.lit(False)) | ~F.col("live"))
    shares = F.array(*[F.lit(j / (points - 1)) for j in range(points)])
    rows = df.select("*", F.posexplode(shares).alias("__j", "__w"))
    target = clip([(1.0 - F.col("__w")) * e + F.col("__w") * x for e, x in zip(cols("e", d), cols("__x", d))], d)
    rows = rows.select("*", *[t.alias(f"__t_{i}") for i, t in enumerate(target)])
    rows = rows.select(*[c for c in rows.columns if not c.startswith("e_")], *[F.col(f"e_{i}").alias(f"__e_{i}") for i in range(d)])
    rows = score(space.priced(space.toward(rows, cols("__e", d), cols("__t", d), [f"e_{i}" for i in range(d)])))
    state = [c for c in df.columns if c not in keys and not c.startswith(("e_", "g_", "__x_"))]
    pick = F.max(F.struct(F.col("u"), (-F.col("__j")).alias("j"), F.col("cost"), *cols("e", d))).alias("__pick")
    line = F.max(_first_best(space)).alias("__line")
    done = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in state], *[F.first(f"__e_{i}").alias(f"__e_{i}") for i in range(d)], pick, line)
    done = done.select(
        "*", F.col("__pick.u").alias("u"), F.col("__pick.cost").alias("cost"), *[F.col(f"__pick.e_{i}").alias(f"e_{i}") for i in range(d)]
    )
    still = F.lit(True)
    for i in range(d):
        still = still & (F.abs(F.col(f"e_{i}") - F.col(f"__e_{i}")) <= TINY)
    stop = F.col("__done") | (still if may_stop else F.lit(False))
    done = done.withColumn("live", ~stop).withColumn("best", F.greatest("best", "probe", "__line"))
    return done.drop("probe", "__pick", "__line", "__done", *[f"__e_{i}" for i in range(d)])


def _unpack(df: DataFrame, keys: list[str], d: int) -> DataFrame:
    return df.select(*keys, F.col("best.u").alias("u"), F.col("best.cost").alias("cost"), *[F.col(f"best.e_{i}").alias(f"e_{i}") for i in range(d)])


def dealt(plans: DataFrame, keys: list[str], probes: int) -> DataFrame:
    """Plans dealt by their keys over tasks whose number grows with them.

    Grouping the ``probes`` of a plan by the keys then needs no shuffle, and what a task sorts does not grow with the plans.
    """
    spark = plans.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(plans.count() * probes / PROBES))
    return plans.repartition(tasks, *keys)


def monte_carlo(plans: DataFrame, space: Space, score: Score, keys: list[str], samples: int, seed: int = 42) -> DataFrame:
    """Best affordable draw per plan; without one, the cheapest draw and no utility.

    The budget filter runs before scoring, so only affordable draws are scored.
    """
    d = space.d
    rows = dealt(plans, keys, samples).drop(*[f"e_{i}" for i in range(d)]).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    rows = rows.select(
        "*",
        *[
            (F.col(f"lo_{i}") + seeded_unit(seed, "mc", i, F.col("draw"), *[F.col(k) for k in keys]) * (F.col(f"hi_{i}") - F.col(f"lo_{i}"))).alias(f"e_{i}")
            for i in range(d)
        ],
    )
    rows = space.priced(rows)
    scored = score(rows.where(space.objective.feasible(F.col("cost"))))
    fields = [F.col("cost"), *cols("e", d)]
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.col("u"), (-F.col("draw")).alias("o"), *fields)).alias("best"))
    cheapest = rows.groupBy(*keys).agg(F.min(F.struct(F.col("cost"), F.col("draw"), *cols("e", d))).alias("cheap"))
    joined = cheapest.join(best, keys, "left")
    return joined.select(
        *keys,
        F.col("best.u").alias("u"),
        F.coalesce("best.cost", "cheap.cost").alias("cost"),
        *[F.coalesce(f"best.e_{i}", f"cheap.e_{i}").alias(f"e_{i}") for i in range(d)],
        F.col("best").isNotNull().alias("feasible"),
    )


def uniform_allocation(plans: DataFrame, space: Space, e_min: float = 0.1) -> DataFrame:
    """Spread the budget left at the lowest degrees evenly over the stages, each capped at its full cost.

    The level L with sum(min(inc_i, L)) = rest has a closed form over the sorted increments of a row.
    """
    d = space.d
    names = [f"e_{i}" for i in range(d)]
    base = plans.drop(*names)
    lows = [F.lit(e_min)] * d
    inc = [
        F.greatest(F.lit(0.0), stage_seconds(F.col(f"k_{i}"), F.col(f"b_{i}"), F.lit(1.0)) - stage_seconds(F.col(f"k_{i}"), F.col(f"b_{i}"), F.lit(e_min)))
        for i in range(d)
    ]
    base = base.select("*", *[x.alias(f"__i_{i}") for i, x in enumerate(inc)], (space.objective.limit() - space.cost(lows)).alias("__rest"))
    ordered = F.array_sort(F.array(*cols("__i", d)))
    # try every count m of fully paid stages: L = (rest - sum of the m smallest) / (d - m), the first that fits
    level = F.lit(float("inf"))
    for m in reversed(range(d)):
        paid = F.aggregate(F.slice(ordered, 1, m), F.lit(0.0), lambda a, x: a + x) if m else F.lit(0.0)
        candidate = (F.col("__rest") - paid) / (d - m)
        level = F.when(F.get(ordered, F.lit(m)) >= candidate, candidate).otherwise(level)
    base = base.withColumn("__level", level)
    out = []
    for i in range(d):
        use = F.least(F.col(f"__i_{i}"), F.col("__level"))
        k = F.col(f"k_{i}")
        raised = F.when(
            (F.col(f"__i_{i}") > TINY) & (k > TINY), F.least(F.lit(1.0), F.lit(e_min) + use / F.when(k > TINY, k))
        ).otherwise(F.lit(1.0))
        out.append(F.when(F.col("__rest") > TINY, raised).otherwise(F.lit(e_min)).alias(names[i]))
    done = base.select("*", *out).drop("__rest", "__level", *[f"__i_{i}" for i in range(d)])
    return space.priced(done)


def cheapest_methods(coefficients: DataFrame, group: list[str], e_min: float = 0.1) -> DataFrame:
    """Per group and stage the method with the lowest cost at the lowest degree."""
    price = stage_seconds(F.col("k"), F.col("b"), F.lit(e_min))
    return coefficients.groupBy(*group, "stage").agg(F.min(F.struct(price.alias("seconds"), F.col("method"))).alias("m")).select(
        *group, "stage", F.col("m.method").alias("method"), F.col("m.seconds").alias("seconds")
    )


def swap_table(coefficients: DataFrame, group: list[str], e_min: float, grid: list[float], gain: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Every (stage, method, degree) swap against the cheapest plan with cost and gain differences and their ratio.

    ``gain(stage, method, e)`` is the predicted utility change of the swap.
    """
    base = cheapest_methods(coefficients, group, e_min)
    swaps = coefficients.withColumn("e", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    joined = swaps.join(base.select(*group, "stage", F.col("seconds").alias("base_seconds")), [*group, "stage"])
    cost = F.greatest(F.lit(0.0), stage_seconds(F.col("k"), F.col("b"), F.col("e")) - F.col("base_seconds"))
    better = F.greatest(F.lit(0.0), gain(F.col("stage"), F.col("method"), F.col("e")))
    return joined.select(
        *group, "stage", "method", "e", stage_seconds(F.col("k"), F.col("b"), F.col("e")).alias("seconds"), "base_seconds",
        cost.alias("cost_delta"), better.alias("gain_delta"), (better / F.greatest(cost, F.lit(1e-9))).alias("ratio"),
    )


def greedy_plan(swaps: DataFrame, group: list[str], overhead: float = 0.0) -> DataFrame:
    """Accept swaps by ratio while the plan stays affordable, one per stage: (group, stage, method, e, seconds, total).

    An ordered fold over the swaps of a group, whose state maps each stage to what it takes. ``swaps`` also has
    ``budget``. A group holds methods x degrees swaps, at most a few hundred.
    """
    item = F.struct((-F.col("ratio")).alias("ratio"), (-F.col("gain_delta")).alias("gain"), "stage", "method", "e", "seconds")
    gathered = swaps.groupBy(*group).agg(
        F.array_sort(F.collect_list(item)).alias("__items"),
        F.map_from_entries(F.collect_set(F.struct("stage", "base_seconds"))).alias("__base"),
        F.first("budget").alias("__limit"),
    )

    def taken(method: Column, e: Column, seconds: Column) -> Column:
        return F.struct(method.cast("string").alias("method"), e.cast("double").alias("e"), seconds.alias("seconds"))

    def total(state: Column) -> Column:
        return F.aggregate(F.map_values(state), F.lit(float(overhead)), lambda a, v: a + v["seconds"])

    def accept(state: Column, swap: Column) -> Column:
        new = taken(swap["method"], swap["e"], swap["seconds"])
        swapped = F.transform_values(state, lambda k, v: F.when(k == swap["stage"], new).otherwise(v))
        free = F.element_at(state, swap["stage"])["method"].isNull()
        return F.when(free & (total(swapped) <= F.col("__limit")), swapped).otherwise(state)

    start = F.transform_values("__base", lambda _, v: taken(F.lit(None), F.lit(None), v))
    done = gathered.withColumn("__plan", F.aggregate("__items", start, accept)).withColumn("total", total(F.col("__plan")))
    stages = done.select(*group, "total", F.explode("__plan").alias("stage", "__v"))
    return stages.select(*group, "stage", "__v.method", "__v.e", "__v.seconds", "total")


def hybrid_rule(plans: DataFrame, space: Space, low: float = 0.2) -> DataFrame:
    """Mark plans: ``direct`` if full degrees are affordable, ``optimise`` if degree ``low`` is, else ``skip``."""
    full = space.cost([F.lit(1.0)] * space.d)
    least = space.cost([F.lit(low)] * space.d)
    limit = space.objective.limit()
    return plans.select(
        "*",
        full.alias("full_cost"),
        least.alias("low_cost"),
        F.when(full <= limit, "direct").when(least <= limit, "optimise").otherwise("skip").alias("branch"),
    )


def best_plan(candidates: DataFrame, space: Space, group: list[str], order: list[str]) -> DataFrame:
    """One row per group: the preferred candidate, ties by ``order``. Combined map-side, as an aggregate: a filter on a
    rank above these long projections would have the optimizer derive constraints from all of them, for most of a minute."""
    p = space.objective.preference(F.col("u"), F.col("cost"))
    key = F.struct(-p["met"], p["a"].isNull(), -p["a"], p["b"].isNull(), -p["b"], *order)
    others = [c for c in candidates.columns if c not in group]
    best = candidates.groupBy(*group).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), key).alias("__best"))
    return best.select(*[F.col(f"`{c}`") if c in group else F.col(f"__best.`{c}`") for c in candidates.columns])
