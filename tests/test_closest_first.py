import numpy as np
import pytest

from tamis.functions import neighbours
from tamis.functions.neighbours import nearest


@pytest.mark.parametrize("wanted", [False, True])
def test_tasks_grow_with_the_rows_and_no_neighbour_is_lost(spark, monkeypatch, wanted):
    monkeypatch.setattr(neighbours, "TASK_BYTES", 8_192, raising=False)
    rng = np.random.default_rng(3)
    n, k, dims = 240, 4, 3
    points = np.round(rng.random((n, dims)) * [4, 40, 9], 1)
    points[rng.random((n, dims)) < 0.15] = np.nan
    points[:, 1] = np.where(np.isnan(points[:, 1]), 7.0, points[:, 1])
    points[n // 2 :: 3] = points[0]  # equal rows
    listed = [[None if np.isnan(v) else float(v) for v in p] for p in points]
    asks = [(i, p, j if wanted else -1) for i, p in enumerate(listed) for j in ((0, 2) if wanted else (0,)) if not wanted or p[j] is None]
    queries = spark.createDataFrame(asks, "qid long, qv array<double>, want int")
    donors = spark.createDataFrame(list(enumerate(listed)), "did long, dv array<double>")
    found = nearest(queries, donors, k, dims, donor_block=16, query_block=16)
    assert found.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {}
    for r in found.collect():
        got.setdefault((r["qid"], r["want"]), []).append((r["rank"], r["did"], r["dist2"]))
    there = ~np.isnan(points)
    for i, _, want in asks:
        shared = there[i] & there
        gap = np.where(shared, np.nan_to_num(points[i]) - np.nan_to_num(points), 0.0)
        square = (gap * gap)[:, 0] + (gap * gap)[:, 1] + (gap * gap)[:, 2]
        square = square * (dims / shared.sum(axis=1))
        may = np.flatnonzero(there[:, want]) if want >= 0 else np.arange(n)
        order = may[np.lexsort((may, square[may]))][:k]
        assert [(d, s) for _, d, s in sorted(got[i, want])] == [(d, pytest.approx(square[d])) for d in order]
