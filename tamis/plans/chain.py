"""Plans of any length, in which an operator may stand more than once.

A plan is a row with ``ops``, an array of (operator, lo, hi, k, b) in the order of the plan, and a ``budget``; its
degrees are an array of the same length. Utility and cost are callbacks over both arrays. Allocation is a fold inside
the row: every round takes slopes by differences, finds the best point of the linear model as a fractional knapsack
over the sorted array of gains per cost, and searches the segment to it. So nothing is shuffled, and the plan of the
query does not grow with the rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.plans.objective import BUDGET_SLACK

TINY = 1e-12
Measure = Callable[[Column, Column], Column]  # (ops, degrees) -> number


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a variable: evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def line_costs(ops: Column, e: Column) -> Column:
    """Sum of the clipped cost lines."""
    return total(F.zip_with(ops, e, lambda o, x: F.greatest(F.lit(0.0), o["b"] + o["k"] * x)))


def along(start: Column, target: Column, share: Column) -> Column:
    return F.zip_with(start, target, lambda a, b: a + share * (b - a))


def _bound(ops: Column, name: str) -> Column:
    return F.transform(ops, lambda o: o[name])


def affordable(ops: Column, start: Column, target: Column, cost: Measure, budget: Column, halvings: int = 40) -> Column:
    """The farthest point from an affordable start toward the target that keeps the budget, by halving."""

    def between(a: Column, z: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            middle = (s["lo"] + s["hi"]) * 0.5
            over = cost(ops, along(a, z, middle)) > budget + BUDGET_SLACK
            return F.struct(F.when(over, s["lo"]).otherwise(middle).alias("lo"), F.when(over, middle).otherwise(s["hi"]).alias("hi"))

        ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        share = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), ends, halve, lambda s: s["lo"])
        return F.when(cost(ops, z) <= budget + BUDGET_SLACK, z).otherwise(let(share, lambda w: along(a, z, w)))

    return let(start, lambda a: let(target, lambda z: between(a, z)))


def slopes(ops: Column, e: Column, utility: Measure, step: float) -> Column:
    """Difference of the utility per unit of each degree, from points inside the bounds."""

    def moved(i: Column, sign: float) -> Column:
        return F.transform(e, lambda x, j: F.when(j == i, F.least(F.greatest(x + sign * step, F.get(ops, j)["lo"]), F.get(ops, j)["hi"])).otherwise(x))

    def difference(i: Column, up: Column, down: Column) -> Column:
        width = F.get(up, i) - F.get(down, i)
        return F.when(width > TINY, (utility(ops, up) - utility(ops, down)) / F.when(width > TINY, width)).otherwise(F.lit(0.0))

    def slope(_: Column, i: Column) -> Column:
        return let(moved(i, 1.0), lambda up: let(moved(i, -1.0), lambda down: difference(i, up, down)))

    return F.transform(e, slope)


def knapsack(ops: Column, gains: Column, cost: Measure, budget: Column) -> Column:
    """Best point of a linear utility: degrees rise from their lower bounds in the order of gain per cost."""
    low = _bound(ops, "lo")

    def within(base: Column) -> Column:
        def offer(g: Column, i: Column) -> Column:
            raised = F.transform(ops, lambda o, j: F.when(j == i, o["hi"]).otherwise(o["lo"]))
            return let(F.greatest(F.lit(0.0), cost(ops, raised) - base), lambda price: priced(g, i, price))

        def priced(g: Column, i: Column, price: Column) -> Column:
            ratio = F.when(price > TINY, g / F.when(price > TINY, price)).otherwise(F.lit(float("inf")))
            return F.struct((-ratio).alias("order"), i.alias("i"), price.alias("price"), (g > 0).alias("wanted"))

        def take(s: Column, o: Column) -> Column:
            share = F.when(o["price"] > TINY, F.least(F.lit(1.0), s["rest"] / F.when(o["price"] > TINY, o["price"]))).otherwise(F.lit(1.0))
            width = F.get(ops, o["i"])["hi"] - F.get(ops, o["i"])["lo"]
            degrees = lambda w: F.transform(s["e"], lambda x, j: F.when(j == o["i"], x + w * width).otherwise(x))
            return let(share, lambda w: F.struct((s["rest"] - w * o["price"]).alias("rest"), degrees(w).alias("e")))

        ranked = F.filter(F.array_sort(F.transform(gains, offer)), lambda o: o["wanted"])
        start = F.struct(F.greatest(F.lit(0.0), budget - base).alias("rest"), low.alias("e"))
        return F.aggregate(ranked, start, take, lambda s: s["e"])

    return let(cost(ops, low), within)


def exchange(ops: Column, e: Column, gains: Column, cost: Measure) -> Column:
    """The point that takes from the degree with the least gain per cost for the one with the most, as far as bounds let."""

    def unit(price: Column) -> Column:
        return F.when(price > TINY, price).otherwise(F.lit(TINY))

    def offer(o: Column, i: Column) -> Column:
        raised = F.transform(e, lambda x, j: F.when(j == i, o["hi"]).otherwise(F.get(ops, j)["lo"]))
        bottom = F.transform(e, lambda x, j: F.get(ops, j)["lo"])
        price = (cost(ops, raised) - cost(ops, bottom)) / F.greatest(o["hi"] - o["lo"], F.lit(TINY))
        up, down = (o["hi"] - F.get(e, i)) * price, (F.get(e, i) - o["lo"]) * price
        return let(price, lambda p: F.struct((F.get(gains, i) / unit(p)).alias("ratio"), i.alias("i"), unit(p).alias("price"), up.alias("up"), down.alias("down")))

    def move(best: Column, worst: Column) -> Column:
        amount = F.least(best["up"], worst["down"])
        shifted = F.transform(
            e, lambda x, j: F.when(j == best["i"], x + amount / best["price"]).when(j == worst["i"], x - amount / worst["price"]).otherwise(x)
        )
        return F.when((best["i"] != worst["i"]) & (amount > 0), shifted).otherwise(e)

    def chosen(offers: Column) -> Column:
        most, least = F.array_max(F.filter(offers, lambda o: o["up"] > TINY)), F.array_min(F.filter(offers, lambda o: o["down"] > TINY))
        return let(most, lambda b: let(least, lambda w: F.coalesce(move(b, w), e)))

    return let(F.transform(ops, offer), chosen)


def allocate(plans: DataFrame, utility: Measure, cost: Measure = line_costs, rounds: int = 40, step: float = 0.002) -> DataFrame:
    """Adds (e, u, cost) to plans (ops, budget); plans whose lowest degrees cost too much have NULL degrees.

    A round searches two segments: to the best point of the linear model, and along an exchange of two degrees,
    which converges where the first one swings between corners.
    """
    ops, budget = F.col("ops"), F.col("budget")
    low, high = _bound(ops, "lo"), _bound(ops, "hi")
    shares = F.array(*[F.lit(x) for x in (0.0, 1 / 256, 1 / 64, 1 / 16, 1 / 4, 1 / 2, 1.0)])

    def advance(s: Column, _: Column) -> Column:
        def line(target: Column) -> Column:
            def point(w: Column) -> Column:
                reached = affordable(ops, s["e"], along(s["e"], target, w), cost, budget)
                # rounding may leave a degree a hair outside its bounds, where a utility need not be defined
                inside = F.zip_with(ops, reached, lambda o, x: F.least(F.greatest(x, o["lo"]), o["hi"]))
                return let(inside, lambda e: F.struct(F.nanvl(utility(ops, e), F.lit(float("-inf"))).alias("u"), e.alias("e")))

            return F.array_max(F.transform(shares, point))

        def both(g: Column) -> Column:
            corner = let(affordable(ops, low, knapsack(ops, g, cost, budget), cost, budget), line)
            return F.greatest(corner, let(exchange(ops, s["e"], g, cost), line))

        def kept(found: Column) -> Column:
            better = found["u"] > s["u"]
            return F.when(better, F.struct(found["u"].alias("u"), found["e"].alias("e"), better.alias("live"))).otherwise(
                F.struct(s["u"].alias("u"), s["e"].alias("e"), F.lit(False).alias("live"))
            )

        # a round depends on the point alone, so after one without gain all others would find the same
        return F.when(s["live"], let(let(slopes(ops, s["e"], utility, step), both), kept)).otherwise(s)

    anchored = plans.withColumn("__start", F.when(cost(ops, low) <= budget + BUDGET_SLACK, affordable(ops, low, high, cost, budget)))
    first = F.struct(utility(ops, F.col("__start")).alias("u"), F.col("__start").alias("e"), F.lit(True).alias("live"))
    done = anchored.withColumn("__best", F.when(F.col("__start").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, advance)))
    found = done.select(*plans.columns, F.col("__best.e").alias("e"), F.col("__best.u").alias("u"))
    return found.withColumn("cost", cost(F.col("ops"), F.col("e")))
