import time

from pyspark.sql import functions as F

from tamis.plans.chain import allocate, total


def test_a_plan_without_gain_takes_no_further_rounds(spark):
    op = F.struct(F.lit("scale").alias("operator"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0.5).alias("k"), F.lit(0.0).alias("b"))
    plans = spark.range(8, numPartitions=1).select("id", F.array(op, op).alias("ops"), F.lit(2.0).alias("budget"))
    flat = lambda ops, e: total(e) * 0 + F.lit(1.0)
    few = allocate(plans, flat, rounds=2).collect()
    started = time.perf_counter()
    assert allocate(plans, flat, rounds=300_000).collect() == few
    assert time.perf_counter() - started < 40  # minutes, if all rounds were taken
    assert [(r["u"], r["e"]) for r in few] == [(1.0, [1.0, 1.0])] * 8
