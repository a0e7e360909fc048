"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds are the median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidelog.queries import CATALOGUE
from tidelog.session import tuned

HEADLINE = [
    "kv_scan_latest", "kv_snapshot_scan", "kv_point_get", "kv_multi_get", "kv_range_scan", "kv_prefix_scan", "kv_scan_page", "kv_seek_ceil", "kv_next_prev",
    "kv_delete_range_effect", "kv_tombstone_skyline", "kv_merge_counter", "kv_merge_append", "kv_gc_pin", "kv_merge_collapse", "kv_ttl_scan", "kv_overlap",
    "kv_cf_union", "kv_ingest_overlay", "kv_txn_overlay_fwd", "kv_txn_conflicts_ser", "kv_lost_appends", "kv_stale_reads", "kv_shadow_verify", "kv_tail_batches", "kv_ycsb_mix",
    "kv_dense_ranges", "kv_multi_get_table", "kv_seek_ceil_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).getOrCreate()
    )
    tuned(spark).sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run, times = CATALOGUE[name][0], []
        for _ in range(4):
            began = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "sum of headline query medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
