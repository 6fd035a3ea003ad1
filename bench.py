"""Wall seconds of the headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendlens.plans import catalog  # noqa: E402
from spendlens.session import local_session  # noqa: E402

HEADLINE = [
    "t01_build_journeys", "t02_shapley_value", "t03_shapley_rate", "t05_markov_removal", "t10_time_decay", "t13_attribution_report", "t15_path_analysis",
    "n08_derive_metrics", "q04_dedupe_keep_first", "q06_changed_only", "a01_campaign_totals", "a05_benchmarks", "a11_entity_rollup",
    "w01_campaign_series_features", "w10_forecast", "w19_sessionize", "j05_as_of_join", "c03_churn", "r08_predict_ctr_cvr",
    "o03_budget_rule", "l02_cooldown_rule_scope", "l02_cooldown_entity_scope", "l05_interventions", "u01_user_profiles", "m01_error_metrics", "j10_neighbour_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
