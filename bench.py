"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fathomset.plans import catalogue
from fathomset.session import build_session

HEADLINE = ["panel_coverage", "grouped_kfold", "ovr_scores", "roundrobin_panel", "panel_curve", "coverage_by_class", "coverage_mondrian",
            "metrics_by_fold", "recalibration_draws", "log_cpm", "stack_counts", "zscore_within", "bridge_variance", "nesting_table",
            "auroc_screen", "quantile_table", "individual_bootstrap", "cluster_bootstrap", "stability_selection", "perm_corr_stratified",
            "claim_status", "submission_ingest", "stream_scores", "late_fusion"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "*"), memory=os.environ.get("BENCH_MEMORY", "6g"))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    queries = catalogue()
    queries["ovr_scores"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
