"""Tables of a tree of plans that are held."""

from pyspark import StorageLevel

from tamis.plans.tree import run_plans
from tamis.sources.tables import keyed


def test_projections_are_read_from_the_table_held_last(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE cast(id % 50 AS double) END AS a", "cast(id % 13 AS double) AS b", "cast(id % 3 AS string) AS y")
    table = keyed(rows, ["id"]).drop("id")
    plans = [((i, n), {"imputation": i, "data_normalization": n}, {}) for i in ("MEAN", "MEDIAN") for n in ("min_max", "max_abs")]
    plans.append(("IQR", {"imputation": "MEAN", "outlier_detection": "IQR", "data_normalization": "min_max"}, {}))
    held, released = [], []
    kind = type(table)
    persist, unpersist = kind.persist, kind.unpersist
    monkeypatch.setattr(kind, "persist", lambda self, level=StorageLevel.MEMORY_AND_DISK: held.append(1) or persist(self, level))
    monkeypatch.setattr(kind, "unpersist", lambda self, *a: released.append(1) or unpersist(self, *a))
    outcomes = run_plans(table, plans, "y", ["NB"])
    assert len(outcomes) == 5 and all(o.reason is None and o.n > 0 for o in outcomes)
    # the table itself and the one without outliers
    assert len(held) == len(released) == 2
