"""Distributed statistics against NumPy, with small limits so the large-data paths run."""

import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions.keys import in_sample, with_row_keys
from tamis.functions.neighbours import build_tree, candidates, match, nearest
from tamis.functions.quantiles import _Brackets, exact_quantiles, grouped_quantile
from tamis.functions.ranks import with_ranks_below
from tamis.functions.stats import cardinality_over, correlations, modes, moments
from tamis.operators.split import cv_folds, degree_sample, divide, split_sizes, stratified_holdout

# rows, train, validation and test sizes of eighteen published tables
SIZES = [
    (4177, 1670, 1253, 1254), (4562, 1824, 1369, 1369), (20867, 8346, 6260, 6261), (67557, 27022, 20267, 20268),
    (14980, 5992, 4494, 4494), (9367, 3746, 2810, 2811), (1460, 583, 439, 438), (44819, 17927, 13446, 13446),
    (20000, 8000, 6000, 6000), (15545, 6217, 4664, 4664), (2111, 844, 633, 634), (5473, 2189, 1642, 1642),
    (1945, 777, 584, 584), (15000, 6000, 4500, 4500), (88588, 35434, 26577, 26577), (58000, 23200, 17400, 17400),
    (32561, 13024, 9768, 9769), (5456, 2182, 1637, 1637),
]


@pytest.mark.parametrize("n,train,val,test", SIZES)
def test_split_sizes(n, train, val, test):
    assert split_sizes(n) == (train, val, test)


def numbers(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, x double")


@pytest.mark.parametrize("shape", ["ties", "uniform", "lognormal", "extreme", "hot"])
def test_quantiles_by_selection(spark, shape):
    rng = np.random.default_rng(3)
    values = {
        "ties": rng.integers(0, 7, 500),
        "uniform": rng.random(1500),
        "lognormal": np.exp(rng.normal(0, 6, 1500)),
        "extreme": np.concatenate([rng.random(700), [1e300, -1e300, 5e-324]]),
        "hot": np.concatenate([np.full(600, 3.25), rng.random(900) * 10]),
    }[shape]
    probs = [0.0, 0.1, 0.25, 0.5, 0.731, 0.9, 1.0]
    df = numbers(spark, list(values) + [None] * 5).repartition(4)
    got = exact_quantiles(df, {"x": F.col("x")}, probs, buckets=16, list_rows=20)["x"]
    np.testing.assert_allclose(got, np.quantile(np.asarray(values, dtype=float), probs), rtol=1e-12)
    small = exact_quantiles(df, {"x": F.col("x")}, probs)["x"]
    np.testing.assert_allclose(small, got, rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = numbers(spark, [None, None])
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5], list_rows=0) == {"x": [None]}
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [None]}


def test_uneven_values_take_few_jobs(spark):
    rng = np.random.default_rng(4)
    values = np.exp(rng.normal(0, 8, 200_000))
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    tracker, probs = spark.sparkContext.statusTracker(), np.linspace(0, 1, 1000).tolist()
    spark.sparkContext.setJobGroup("quantiles", "jobs of one call")
    got = exact_quantiles(df, {"x": F.col("x")}, probs, list_rows=20_000)["x"]
    jobs = len(tracker.getJobIdsForGroup("quantiles"))
    spark.sparkContext.setJobGroup("", "")
    np.testing.assert_allclose(got, np.quantile(values, probs), rtol=1e-12)
    assert jobs <= 16  # with adaptive plans every shuffle is a job of its own: some three for a pass


def test_grouped_quantile_with_hot_group(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": np.round(rng.gamma(2, 3, 900), 2), "one": np.array([4.0]), "same": np.full(50, 2.5), "two": np.array([1.0, 9.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for p, listed in ((0.5, 100_000), (0.9, 20)):
        got = {r["g"]: r["q"] for r in grouped_quantile(df, ["g"], "v", p, "q", list_rows=listed).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            assert got[g] == pytest.approx(np.quantile(vs, p), rel=1e-12)


@pytest.mark.parametrize("shape", ["tail", "ties", "edge", "infinite"])
def test_a_group_with_most_rows_is_narrowed_where_it_lies(spark, shape):
    """90 % of the rows in one group: what is ordered in one task does not grow with it, and no task reads much more than others."""
    rng = np.random.default_rng(8)
    n = 40_000
    hot = {
        "tail": np.exp(rng.normal(0, 9, n)),
        "ties": np.concatenate([np.full(n // 2, 3.0), rng.normal(3, 1, n // 2)]),
        "edge": np.concatenate([np.full(n * 9 // 10, 7.0), rng.random(n // 10) * 7]),  # the rank is the first of many equal ones
        "infinite": np.concatenate([np.full(500, -np.inf), rng.normal(0, 1, n - 900), np.full(400, np.inf)]),
    }[shape]
    groups = {None: hot, 1: rng.random(2000), 2: rng.normal(size=2000)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v double").repartition(8)
    for p in (0.0, 0.1, 0.5, 0.9):
        brackets = _Brackets(df.select("g", F.col("v").alias("__x")), ["g"], [{"g": None, "__n": n}], p)
        rounds = 0
        while brackets.narrow(200):
            rounds += 1
        # strictly between the ends few are left, and no shuffle has moved a row
        assert rounds <= 4 and (brackets.inside().count() <= 200 or not brackets._wanted(brackets.state[(None,)]))
        plan = brackets.inside()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "Exchange hashpartitioning" not in plan
        got = {r["g"]: r["q"] for r in grouped_quantile(df, ["g"], "v", p, "q", list_rows=200).collect()}
        for g, vs in groups.items():
            ordered, at = np.sort(vs), p * (len(vs) - 1)
            a, c = ordered[int(at)], ordered[min(int(at) + 1, len(vs) - 1)]
            expected = a if at == int(at) else a * (1 - (at - int(at))) + c * (at - int(at))
            assert got[g] == pytest.approx(expected, rel=1e-12), (g, p)


def test_ranks_take_exact_counts(spark):
    df = with_row_keys(spark.range(3000).withColumn("c", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 > 0, (F.col("id") % 7).cast("string"))), ["id"])
    marked = with_ranks_below(df, lambda n: [F.floor(n / 4), F.lit(0), n + 5], ["quarter", "never", "always"], "degree", F.col("c"))
    rows = marked.groupBy("c").agg(F.count("*").alias("n"), *[F.sum(F.col(x).cast("int")).alias(x) for x in ("quarter", "never", "always")]).collect()
    assert len(rows) == 9 and all((r["quarter"], r["never"], r["always"]) == (r["n"] // 4, 0, r["n"]) for r in rows)


def test_holdout_and_folds_of_many_classes(spark):
    base = spark.range(60_000).selectExpr("id", "CASE WHEN id < 20000 THEN concat('s', id) ELSE concat('c', id % 5000) END AS y")
    df = with_row_keys(base, ["id"])
    rows = stratified_holdout(df, "y", 0.25).groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("holdout").cast("int")).alias("k")).collect()
    assert len(rows) == 25_000 and all(r["k"] == (2 if r["n"] == 8 else 0) for r in rows)
    folds = cv_folds(df, "y").where("y LIKE 'c%'").groupBy("y").agg(F.countDistinct("fold").alias("f")).collect()
    assert {r["f"] for r in folds} == {8}


def test_many_knots_of_many_distinct_values(spark):
    df = spark.range(600_000).selectExpr("(id * 7919 % 600000) / 3.0D AS x")
    probs = [i / 999 for i in range(1000)]
    got = exact_quantiles(df, {"x": F.col("x")}, probs)["x"]
    assert np.allclose(got, np.quantile(np.arange(600_000) / 3.0, probs), rtol=1e-12)


def test_modes_keep_their_type(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "1.10", True)] * 3 + [(2**53, "2.20", False)] * 2, "a long, t string, b boolean").selectExpr("a", "cast(t AS decimal(10,2)) AS d", "b", "t")
    assert modes(df, ["a", "d", "b", "t"]) == {"a": big, "d": Decimal("1.1"), "b": True, "t": "1.10"}


def test_samples_are_nested_and_independent_of_layout(spark):
    df = with_row_keys(spark.range(2000), ["id"])
    small = {r[0] for r in df.where(in_sample(0.2)).select("id").collect()}
    large = {r[0] for r in df.repartition(8).where(in_sample(0.6)).select("id").collect()}
    assert small < large
    assert df.where(in_sample(1.0)).count() == 2000
    assert degree_sample(df, 0.25, exact=True).count() == 500


def test_exact_division_is_disjoint_and_complete(spark):
    df = divide(with_row_keys(spark.range(1460), ["id"]), exact=True)
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert counts == {"train": 583, "val": 439, "test": 438}
    none = divide(with_row_keys(spark.range(100), ["id"]), 0.3, 0.0)
    assert none.where("split = 'val'").count() == 0
    with pytest.raises(ValueError):
        divide(df, 0.7, 0.3)


def test_holdout_leaves_single_rows_out(spark):
    df = with_row_keys(spark.range(41).withColumn("y", F.when(F.col("id") == 0, "rare").otherwise("a")), ["id"])
    assert stratified_holdout(df, "y", 0.25).where("holdout").count() == 10
    two = with_row_keys(spark.range(40).withColumn("y", (F.col("id") % 2).cast("string")), ["id"])
    parts = stratified_holdout(two, "y", 0.25).where("holdout").groupBy("y").count().collect()
    assert sorted(r["count"] for r in parts) == [5, 5]


def test_folds_are_balanced(spark):
    df = with_row_keys(spark.range(103).withColumn("y", F.col("id") % 4), ["id"])
    rows = cv_folds(df, "y").groupBy("y", "fold").count().collect()
    by_class = {}
    for r in rows:
        by_class.setdefault(r["y"], []).append(r["count"])
    assert all(len(v) == 4 and max(v) - min(v) <= 1 for v in by_class.values())


def test_modes_and_cardinality(spark):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 1, 1.5), ("a", 2, None), ("b", 1, 0.5), (None, 3, 0.5)], "t string, i int, d double")
    assert modes(df, ["t", "i", "d"]) == {"t": "a", "i": 1, "d": 0.5}
    wide = spark.range(400).select((F.col("id") % 100).alias("at"), (F.col("id") % 101).alias("over"), F.col("id").alias("key"))
    assert cardinality_over(wide, ["at", "over", "key"], 100, 0.5) == {"over", "key"}


def test_moments_of_few_and_many_columns(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 15)) @ rng.normal(size=(15, 15)) + 5
    df = spark.createDataFrame(data.tolist(), ", ".join(f"x{i} double" for i in range(15)))
    for p in (3, 15):
        n, mean, cov = moments(df, [F.col(f"x{i}") for i in range(p)])
        assert n == 60
        np.testing.assert_allclose(mean, data[:, :p].mean(0), rtol=1e-9)
        np.testing.assert_allclose(cov, np.cov(data[:, :p].T, ddof=0), rtol=1e-8, atol=1e-9)


def test_correlation_of_a_constant_is_unknown(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, None, 7.0)], "a double, b double, c double")
    corr = correlations(df, ["a", "b", "c"])
    assert corr[("a", "b")] == pytest.approx(1.0)
    assert corr[("a", "c")] is None


def brute(queries, donors, k, dims, skip_self):
    out = {}
    for qid, q, want in queries:
        found = []
        for did, d in donors:
            if skip_self and did == qid or want >= 0 and d[want] is None:
                continue
            shared = [i for i in range(dims) if q[i] is not None and d[i] is not None]
            square = 0.0
            for i in shared:  # plain additions: the built-in sum compensates its rounding
                square += (q[i] - d[i]) * (q[i] - d[i])
            if shared:
                found.append((square * (dims / len(shared)), did))
        out[(qid, want)] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("gaps,skip_self", [(False, True), (True, False)])
def test_neighbours_match_brute_force(spark, gaps, skip_self):
    rng = np.random.default_rng(11)
    points = np.round(np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(8, 1, (60, 3)), np.tile([[1.0, 1.0, 1.0]], (60, 1))]), 1).tolist()
    if gaps:
        points = [[None if rng.random() < 0.2 else v for v in p] for p in points]
    donors = list(enumerate(points))
    queries = [(i, p, (p.index(None) if None in p else -1) if gaps else -1) for i, p in donors if not gaps or any(v is not None for v in p)]
    q = spark.createDataFrame(queries, "qid long, qv array<double>, want int")
    d = spark.createDataFrame(donors, "did long, dv array<double>")
    rows = nearest(q, d, 4, 3, skip_self, donor_block=16, query_block=8).collect()
    got = {}
    for r in rows:
        got.setdefault((r["qid"], r["want"]), []).append((r["dist2"], r["did"]))
    expected = {key: v for key, v in brute(queries, donors, 4, 3, skip_self).items() if v}
    assert {key: sorted(v) for key, v in got.items()} == expected


def test_rows_moved_for_neighbours_grow_with_the_rows(spark):
    """Four times the rows: each query meets about as many leaves, of about as many donors."""
    moved = {}
    for n in (4_000, 16_000):
        points = spark.range(n).selectExpr("id AS did", "array(rand(1), rand(2)) AS dv")
        tree = build_tree(points, 2, 5, block=128)
        placed, matched = match(tree, points.selectExpr("did AS qid", "dv AS qv", "-1 AS want"), 5, 128)
        met = candidates(tree, placed, matched, 5, 128).groupBy("qid").count()
        leaves = tree.donors.groupBy("kind", "top", "sub").count().agg(F.count("*"), F.max("count")).first()
        rows = matched.select("leaf", "rows", "q_parts").distinct().agg(F.sum(F.col("rows") * F.col("q_parts"))).first()[0]
        moved[n] = met.agg(F.avg("count")).first()[0], rows / n, leaves[0], len(tree.tops)
        assert met.count() == n and leaves[1] <= 128 * 4
    assert moved[16_000][2] > 3 * moved[4_000][2] and moved[16_000][3] >= 2 * moved[4_000][3]
    # the smaller table has more of its leaves at the border, with fewer neighbours
    for small, large in zip(moved[4_000][:2], moved[16_000][:2]):
        assert large < 1.5 * small and large < moved[16_000][2] / 10


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.floats(0, 1))
def test_rank_arithmetic(values, p):
    from tamis.functions.quantiles import _rank_pairs

    ordered = sorted(values)
    ((low, high, frac),) = _rank_pairs(len(values), [p])
    assert ordered[low] * (1 - frac) + ordered[high] * frac == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6)
