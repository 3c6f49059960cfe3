"""Headline queries, timed once each on the tables under $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barsift import plans  # noqa: E402
from barsift.session import local_session  # noqa: E402

HEADLINE = [
    "l01_forward_outcomes", "l07_base_rate_wilson", "w05_kdj", "w12_layers", "k42_scan_signals", "a05_hit_rate_table",
    "m14_feature_matrix", "w16_cross_section", "m09_auc_scan", "i01_date_bootstrap", "l11_event_labels", "l04_cooldown",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    queries = plans.load()
    # One small pass warms the JVM and the reader.
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
