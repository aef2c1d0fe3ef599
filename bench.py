"""Seconds of the headline queries over one scale: a JSON line for the driver."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import QUERIES
from tidemark.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "replica_decision", "slot_dedup", "series_quality", "bounded_fill", "repair_plan", "feature_rows", "tree_dataset", "sequence_examples", "seasonal_peak", "rolling_quantile_peak", "holt_winters_peak",
    "walk_forward_score", "paired_comparison", "matured_error", "promotion_verdict", "evaluation_candidates", "surge_projection", "budget_projection", "upsert_latest", "insert_missing", "slot_claim", "cluster_capacity", "contract_parse",
    "quantile_trees", "recurrent_native", "stream_slots",
]


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", **{"spark__sql__shuffle__partitions": CPUS, "spark__ui__enabled": "false", "spark__driver__memory": "8g", "spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["seasonal_peak"](spark, SF_DIR).collect()  # starts the session's machinery
    seconds = {}
    for name in HEADLINES:
        begun = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
