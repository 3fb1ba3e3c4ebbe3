"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "prepare_end_to_end", "split_exact", "strat_holdout", "dedup_exact", "dedup_approx_docs", "imp_mean", "imp_median", "imp_mf",
    "imp_mice", "enc_target", "norm_zscore", "norm_robust", "norm_quniform", "norm_kbins_q", "out_zsb", "out_iqr", "out_mad",
    "ext_pca", "ext_poly", "sel_lc", "sel_wr", "clf_gnb", "clf_mnb", "dataset_params", "runtime_profile", "plan_cost", "plan_best",
    "linear_oracle", "mc_allocate", "summary_best",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from tamis.queries import QUERIES
    from tamis.session import local_session

    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
