"""Cost, allocation, records, plan runs and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.plans.allocate import Space, cols, column_score, frank_wolfe, frank_wolfe_deterministic, greedy_plan, monte_carlo, segment_share
from tamis.plans.benefit import BenefitModel, train_benefit
from tamis.plans.compare import running_best
from tamis.plans.cost import cost_multiplier, fit_seconds, method_bonus
from tamis.plans.objective import Objective
from tamis.plans.run import benefit_records, prepare, run_plan
from tamis.plans.space import combo_count, combo_space, draw_plans, method_options
from tamis.sources.records import failure_counts, pending_cases, read_records, with_record_defaults, write_records
from tamis.sources.tables import keyed, read_catalog, read_csv, read_label


def utility(e):
    return F.lit(0.6) + F.lit(0.15) * F.sqrt(e[0]) + F.lit(0.2) * F.sqrt(e[1])


def cost(e):
    return F.lit(0.05) + F.lit(0.4) * e[0] + F.lit(0.6) * e[1]


@pytest.fixture(scope="module")
def plans(spark):
    return spark.range(3).select("id", *[F.lit(0.0).alias(f"lo_{i}") for i in range(2)], *[F.lit(1.0).alias(f"hi_{i}") for i in range(2)])


def objectives():
    return {
        "budget_performance": Objective("budget_performance", budget=0.7),
        "target_cost": Objective("target_cost", target=0.8),
        "utility_cost_ratio": Objective("ratio", baseline=0.6),
    }


@pytest.mark.parametrize("name", ["budget_performance", "target_cost", "utility_cost_ratio"])
def test_example_objectives(plans, name):
    objective = objectives()[name]
    space = Space(2, objective, cost=cost)
    rows = frank_wolfe(plans, space, column_score(utility, 2), ["id"], rounds=8, checkpoint_every=3).collect()
    assert len(rows) == 3
    for r in rows:
        assert all(0 <= r[f"e_{i}"] <= 1 for i in range(2)) and np.isfinite(r["u"])
        if name == "budget_performance":
            assert r["cost"] <= 0.7 + 1e-8 and r["u"] > 0.84
        if name == "target_cost":
            assert r["u"] >= 0.8 - 1e-6 and r["cost"] < 0.55
        if name == "utility_cost_ratio":
            assert (r["u"] - 0.6) / (r["cost"] + 1e-6) > (0.95 - 0.6) / 1.05


def test_deterministic_search_is_near_the_optimum(plans):
    space = Space(2, Objective(budget=0.7), cost=cost, affine=True)
    row = frank_wolfe_deterministic(plans, space, column_score(utility, 2), ["id"], rounds=6, checkpoint_every=3).first()
    grid = np.linspace(0, 1, 2001)
    other = np.clip((0.65 - 0.4 * grid) / 0.6, 0, 1)
    best = (0.6 + 0.15 * np.sqrt(grid) + 0.2 * np.sqrt(other))[0.4 * grid <= 0.65].max()
    assert best - 0.004 <= row["u"] <= best + 1e-9


def test_infeasible_plans_get_no_search_but_a_cheapest_draw(plans):
    space = Space(2, Objective(budget=0.01), cost=cost)
    assert frank_wolfe(plans, space, column_score(utility, 2), ["id"], rounds=1).count() == 0
    rows = monte_carlo(plans, space, column_score(utility, 2), ["id"], 5).collect()
    assert all(not r["feasible"] and r["u"] is None for r in rows)


def test_bisection_on_a_clipped_cost(spark):
    df = spark.range(1)
    value = segment_share([F.lit(0.0)], [F.lit(1.0)], lambda e: F.greatest(F.lit(0.0), F.lit(-1.0) + 3 * e[0]), F.lit(1.0))
    assert df.select(value).first()[0] == pytest.approx(2 / 3, abs=1e-8)


def test_model_scored_search(spark):
    records = draw_plans(spark.range(300), "id", method_options("legacy")).withColumn(
        "accuracy", 0.4 + 0.3 * F.col("e_imputation") + F.when(F.col("m_imputation") == "KNN", 0.2).otherwise(0.0)
    )
    model = train_benefit(records, ["id"], trees=15)
    assert model.mse < 0.02
    stages = list(method_options("legacy"))
    base = records.limit(2).select("id", *[F.col(f"m_{s}") for s in stages], *[F.col(f"e_{s}") for s in stages if s != "imputation"])
    one = base.select("*", F.lit(0.1).alias("lo_0"), F.lit(1.0).alias("hi_0"), F.lit(1.0).alias("k_0"), F.lit(0.0).alias("b_0"))

    def score(df):
        return model.score(df.withColumn("e_imputation", F.col("e_0"))).drop("e_imputation")

    space = Space(1, Objective(budget=0.8))
    found = monte_carlo(one, space, score, ["id"], 20).collect()
    assert all(r["feasible"] and r["cost"] <= 0.8 + 1e-9 for r in found)


def test_benefit_model_stores(spark, tmp_path):
    records = draw_plans(spark.range(120), "id", method_options("legacy")).withColumn("accuracy", F.col("e_imputation"))
    model = train_benefit(records, ["id"], trees=3, method_params=True)
    model.save(f"{tmp_path}/m")
    again = BenefitModel.load(spark, f"{tmp_path}/m")
    assert again.score(records).select("u").collect() == model.score(records).select("u").collect()


def test_spaces(spark):
    assert combo_count(method_options("legacy")) == 5184
    assert combo_count(method_options("sota")) == 190080
    assert [sum(map(len, method_options(s).values())) for s in ("legacy", "extended")] == [26, 46]
    assert combo_space(spark, method_options("legacy")).drop("combo_id").distinct().count() == 5184
    with pytest.raises(ValueError):
        method_options("mine")


def test_cost_fit_rules(spark):
    rows = [("up", 0.1 * i, 0.2 + 3 * 0.1 * i) for i in range(1, 11)] + [("down", 0.1 * i, 2 * 0.1 * i - 1) for i in range(1, 11)] + [("few", 0.5, 4.0), ("few", 1.0, 6.0)]
    df = spark.createDataFrame(rows, "m string, e double, mean_seconds double")
    got = {r["m"]: (r["k"], r["b"]) for r in fit_seconds(df, ["m"]).collect()}
    assert got["up"] == pytest.approx((3.0, 0.2)) and got["down"] == pytest.approx((2.0, 0.0)) and got["few"] == (0.0, 5.0)
    assert method_bonus("feature_encoding", "onehot") == pytest.approx(0.06)
    value = spark.range(1).select(cost_multiplier("e_dataset", F.lit(100000), F.lit(1), F.lit(0.0))).first()[0]
    assert value == pytest.approx((1 + 0.08 * 1.0) * (1 - 0.05 * 1.5))


def test_greedy_accepts_by_ratio_within_the_budget(spark):
    rows = [("d", "s1", "a", 1.0, 3.0, 1.0, 2.0, 0.5, 0.25, 3.5), ("d", "s1", "b", 1.0, 1.5, 1.0, 0.5, 0.4, 0.8, 3.5), ("d", "s2", "c", 1.0, 2.5, 1.0, 1.5, 0.3, 0.2, 3.5)]
    swaps = spark.createDataFrame(rows, "dataset string, stage string, method string, e double, seconds double, base_seconds double, cost_delta double, gain_delta double, ratio double, budget double")
    got = {r["stage"]: (r["method"], r["total"]) for r in greedy_plan(swaps, ["dataset", "budget"]).collect()}
    assert got == {"s1": ("b", 2.5), "s2": (None, 2.5)}


def test_running_best_across_chunks(spark):
    rng = np.random.default_rng(0)
    values = rng.random(200)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)], "g string, i long, v double").repartition(4)
    rows = running_best(df, ["g"], "i", "v", chunk=16).orderBy("i").collect()
    np.testing.assert_allclose([r["best_so_far"] for r in rows], np.maximum.accumulate(values))


def test_records_round_trip(spark, tmp_path):
    from tamis.sources.records import RECORD_SCHEMA

    row = ("d1", "NB", None, None, None, "test", None, None, None, {"imputation": "MEAN"}, {"imputation": 0.5}, 0.8, 1.0)
    write_records(spark.createDataFrame([row, ("d2", *row[1:])], RECORD_SCHEMA), f"{tmp_path}/r")
    back = read_records(spark, f"{tmp_path}/r", dataset="d1").collect()
    assert len(back) == 1 and back[0]["cost_param"] == "e" and back[0]["operator_space"] == "legacy"
    assert with_record_defaults(spark.createDataFrame([(None,)], "dataset string")).first()[0] == "google"
    cases = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "d string, b double")
    assert [r["d"] for r in pending_cases(cases, cases.where("d = 'a'"), ["d", "b"]).collect()] == ["b"]
    top = failure_counts(spark.createDataFrame([("x",), ("y",), ("x",)], "r string"), F.col("r")).collect()
    assert [(r["reason"], r["failures"]) for r in top] == [("x", 2), ("y", 1)]


def test_sources(spark, tmp_path):
    folder = tmp_path / "data" / "toy"
    folder.mkdir(parents=True)
    (folder / "data.csv").write_text("a,b,y\n1,?,u\n2,x,v\n")
    (folder / "info.json").write_text('{"label": "y",\n "other": 1}')
    assert read_label(spark, str(folder / "info.json")) == "y"
    assert read_csv(spark, str(folder / "data.csv")).where("b = '?'").count() == 1
    assert read_csv(spark, str(folder / "data.csv"), null_value="?").where("b IS NULL").count() == 1
    row = read_catalog(spark, str(tmp_path / "data")).first()
    assert (row["dataset"], row["label"]) == ("toy", "y")


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.range(400).selectExpr(
        "id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 50 + 0.5D END AS a", "(id * 37) % 91 / 10.0D AS b", "concat('k', id % 4) AS t", "CASE WHEN id % 50 > 25 THEN 'hi' ELSE 'lo' END AS y"
    )
    return keyed(df, ["id"]).drop("id").cache()


def test_plan_runs_every_stage(toy):
    methods = {
        "duplicate_detection": "AD", "feature_encoding": "onehot", "imputation": "KNN", "data_normalization": "min_max",
        "outlier_detection": "ZSB", "feature_extraction": "polynomial", "feature_selection": "VAR",
    }
    prepared, models = prepare(toy, methods, {s: 0.8 for s in methods}, "y")
    assert [m.stage for m in models] == list(methods)
    assert {"row_id", "row_hash", "split", "y"} < set(prepared.columns)
    result = run_plan(toy, {"feature_encoding": "ordinal", "imputation": "MEAN"}, {}, "y", "CART")
    assert result["accuracy"] > 0.7 and result["prep_seconds"] > 0


def test_records_are_generated_and_failures_kept(toy):
    good, bad = benefit_records(toy, "toy", "y", ["NB"], 1, parallel=2, seed=3)
    assert good.count() >= 1 or bad.count() >= 1
    assert all(0 <= r["accuracy"] <= 1 for r in good.collect())


def test_fitted_models_run_on_a_stream(spark, toy, tmp_path):
    from tamis.streaming.apply import transform_stream

    chain = {"feature_encoding": "ordinal", "imputation": "MEAN", "data_normalization": "z_score"}
    batch, models = prepare(toy, chain, {}, "y", keep=False)
    toy.write.parquet(f"{tmp_path}/in")
    stream = transform_stream(spark.readStream.schema(toy.schema).parquet(f"{tmp_path}/in"), models)
    running = stream.writeStream.format("memory").queryName("prepared").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    running.awaitTermination(60)
    key = ["row_id", *[c for c in sorted(batch.columns) if c != "row_id"]]
    assert spark.table("prepared").select(*key).orderBy("row_id").collect() == batch.select(*key).orderBy("row_id").collect()


def test_equal_beginnings_are_fitted_once(spark, toy):
    from tamis.plans.tree import plan_tree, run_plans

    first = {"feature_encoding": "ordinal", "imputation": "MEAN"}
    plans = [
        ("plain", first, {}),
        ("scaled", {**first, "data_normalization": "min_max"}, {}),
        ("scaled again", {**first, "data_normalization": "min_max"}, {}),
        ("half", {**first, "data_normalization": "min_max"}, {"data_normalization": 0.5}),
        ("median", {**first, "imputation": "MEDIAN", "data_normalization": "min_max"}, {}),
        ("nothing", {}, {}),
        ("broken", {**first, "feature_selection": "none such"}, {}),
    ]
    paths = []
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    outcomes = run_plans(toy, plans, "y", ["NB", "CART"], fitted=paths.append)
    assert len(paths) == len(set(paths)) == 6  # encoding, two imputations, two degrees of a scaling, the other scaling
    assert [len(p) for p in sorted(paths, key=len)] == [1, 2, 2, 3, 3, 3]
    assert len(outcomes) == 2 * len(plans) and len(plan_tree(plans).below()) == len(plans)
    by = {(o.plan, o.model): o for o in outcomes}
    assert by["scaled", "CART"].accuracy == by["scaled again", "CART"].accuracy is not None
    assert by["scaled", "CART"].prep_seconds > by["plain", "CART"].prep_seconds > 0
    alone = run_plan(toy, plans[4][1], {}, "y", "CART")
    assert by["median", "CART"].accuracy == alone["accuracy"]
    assert by["broken", "NB"].accuracy is None and "none such" in by["broken", "NB"].reason
    # every table of the tree has been released
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_too_few_records_are_an_error(spark, toy, monkeypatch):
    import tamis.plans.run as run

    def failing(df, plans, label, models, *args, **kwargs):
        return [run.Outcome(name, m, reason="no luck") for name, _, _ in plans for m in models]

    monkeypatch.setattr(run, "run_plans", failing)
    with pytest.raises(RuntimeError, match="0 of 2 plans.*no luck"):
        benefit_records(toy, "toy", "y", ["NB"], 2)


def test_coefficients_by_version(spark, tmp_path):
    from tamis.sources.records import coefficients_as_of, read_coefficients, write_coefficients

    def line(method, statistic, k):
        return ("a", "imputation", method, statistic, k, 0.1)

    schema = "dataset string, process string, method string, statistic string, k double, b double"
    write_coefficients(spark.createDataFrame([line("MEAN", "mean", 1.0), line("MEAN", "q90", 2.0)], schema), f"{tmp_path}/c", 1)
    write_coefficients(spark.createDataFrame([line("MEAN", "mean", 3.0), line("KNN", "mean", 9.0)], schema), f"{tmp_path}/c", 4)
    known = read_coefficients(spark, f"{tmp_path}/c", 3)
    assert {r["version"] for r in known.collect()} == {1}
    assert "PartitionFilters: [isnotnull(version" in known._jdf.queryExecution().executedPlan().toString()
    wanted = [("a", "imputation", m, v, s) for m, v, s in [("MEAN", 0, "mean"), ("MEAN", 1, "mean"), ("MEAN", 3, "mean"), ("MEAN", 9, "mean"), ("MEAN", 9, "q90"), ("KNN", 3, "mean"), ("none", 9, "mean")]]
    frame = spark.createDataFrame(wanted, "dataset string, process string, method string, version int, statistic string")
    rows = coefficients_as_of(frame, read_coefficients(spark, f"{tmp_path}/c", 9)).collect()
    found = {(r["method"], r["version"], r["statistic"]): (r["used_version"], r["k"]) for r in rows}
    assert found == {
        ("MEAN", 0, "mean"): (None, None), ("MEAN", 1, "mean"): (1, 1.0), ("MEAN", 3, "mean"): (1, 1.0), ("MEAN", 9, "mean"): (4, 3.0),
        ("MEAN", 9, "q90"): (1, 2.0), ("KNN", 3, "mean"): (None, None), ("none", 9, "mean"): (None, None),
    }


def test_models_with_tables_and_learners_are_stored(spark, toy, tmp_path):
    from tamis.operators.base import StageModel
    from tamis.operators.stages import Imputation, OutlierDetection

    encoded = prepare(toy, {"feature_encoding": "ordinal"}, {}, "y")[0]
    full = Imputation("MEAN", label="y").fit(encoded).transform(encoded)
    for number, (stage, table) in enumerate([(Imputation("KNN", label="y"), encoded), (Imputation("DT", label="y", tree_rounds=1), encoded), (OutlierDetection("LOF", label="y", neighbours=3), full)]):
        model = stage.fit(table)
        model.save(f"{tmp_path}/{number}")
        again = StageModel.load(f"{tmp_path}/{number}", spark)
        key = sorted(table.columns)
        assert again.transform(table).select(*key).orderBy("row_id").collect() == model.transform(table).select(*key).orderBy("row_id").collect()


def test_chains_of_operators(spark):
    from tamis.plans.chain import allocate, line_costs, total

    schema = "id int, ops array<struct<operator:string,lo:double,hi:double,k:double,b:double>>, budget double"
    twice = [("impute", 0.0, 1.0, 0.5, 0.1), ("scale", 0.2, 0.2, 1.0, 0.0), ("impute", 0.0, 1.0, 0.25, 0.0)]
    plans = spark.createDataFrame([(1, twice, 0.6), (2, twice, 5.0), (3, twice, 0.25), (4, twice[:1], 0.35), (5, [], 1.0)], schema)
    utility = lambda ops, e: total(F.zip_with(ops, e, lambda o, x: F.when(o["operator"] == "impute", F.sqrt(x)).otherwise(F.lit(0.0))))
    rows = {r["id"]: r for r in allocate(plans, utility).collect()}
    # 0.3 is left for two roots at 0.5 and 0.25 a unit: equal gain per cost where e_0 = 0.2 and e_2 = 0.8
    assert rows[1]["e"] == pytest.approx([0.2, 0.2, 0.8], abs=0.02) and rows[1]["u"] == pytest.approx(0.2**0.5 + 0.8**0.5, abs=1e-4)
    assert rows[2]["e"] == pytest.approx([1.0, 0.2, 1.0]) and rows[2]["cost"] == pytest.approx(1.05)
    assert rows[3]["e"] is None and rows[3]["u"] is None  # the fixed stage and the offset alone cost 0.3
    assert rows[4]["e"] == pytest.approx([0.5], abs=1e-6) and rows[5]["e"] == []
    assert all(r["cost"] <= r["budget"] + 1e-8 for r in rows.values() if r["e"])
    # a cost of its own: a second use of an operator is half the price of the first
    def cheaper(ops, e):
        return line_costs(ops, F.transform(e, lambda x, i: F.when(i > 1, x * 0.5).otherwise(x)))

    own = {r["id"]: r for r in allocate(plans.where("id = 1"), utility, cheaper).collect()}
    assert own[1]["u"] > rows[1]["u"] and own[1]["cost"] <= 0.6 + 1e-8
