"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]: one JSON line of seconds."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINES = ["stg_transfers_dedup", "wallet_daily_activity", "wallet_lifecycle", "daily_metrics", "weekly_metrics", "wallet_segments", "retention_cohorts", "funnel_conversion", "concentration", "anomalies", "dq_checks", "reconcile_daily"]


def main() -> None:
    from loomstream import registry
    from loomstream.session import build_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("segment_plan")  # starts the executors; hubs are built by the first query that needs them, in its time
    seconds = {}
    for name in HEADLINES:
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
