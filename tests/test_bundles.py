"""Neighbours in many dimensions, where all leaves meet."""

import numpy as np

from tamis.functions.neighbours import bundled, build_tree, candidates, match, nearest


def test_a_query_moves_once_for_the_leaves_of_a_bundle(spark):
    rng = np.random.default_rng(3)
    dims, n, k = 32, 600, 4
    points = np.round(rng.normal(0, 1, (n, dims)), 2)
    donors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "did long, dv array<double>")
    queries = donors.selectExpr("did AS qid", "dv AS qv", "-1 AS want")
    assert bundled(dims, 16) == 8 and bundled(2, 16) == 1
    tree = build_tree(donors, dims, k + 1, 16)
    placed, matched = match(tree, queries, k + 1, 16)
    leaves = matched.select("leaf").distinct().count()
    met = candidates(tree, placed, matched, k + 1, 16).selectExpr("qid", "size(numbers) AS leaves")
    moved = met.count() / n
    assert met.groupBy("qid").sum("leaves").where(f"`sum(leaves)` > {0.8 * leaves}").count() > 0.8 * n  # no bound drops much
    assert moved < leaves / 3
    got = {}
    for r in nearest(queries, donors, k, dims, True, donor_block=16, query_block=16).collect():
        got.setdefault(r["qid"], []).append((r["dist2"], r["did"]))
    for i, p in enumerate(points):
        square = np.zeros(n)
        for j in range(dims):
            square += (p[j] - points[:, j]) ** 2
        order = [d for d in np.lexsort((np.arange(n), square)) if d != i][:k]
        assert [d for _, d in sorted(got[i])] == order
