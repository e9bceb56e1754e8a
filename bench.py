"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query runs to completion through the no-op sink (no driver collect).
``T2_load_warehouse`` is the one-off build of the month-partitioned
enriched fact that the analytics queries read; it is timed on its own.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "Q1_overview",
    "Q2_trend",
    "Q3_top_ssic",
    "Q4_hotspots",
    "Q5_search_page",
    "Q6_entity_detail",
    "A6_compare_areas",
    "R4_top_ssic_by_area_month",
    "J6_category_counts",
    "P10_clean_record",
    "A9_dedup_keep_latest",
    "J1_enrich_geo",
    "J5_point_in_polygon_subzone",
    "T3_geo_enrich",
    "N16_answer_questions",
    "ST4_stream_rollup",
    "S1_read_registry_csv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE

    from bizlens import get_session
    from bizlens.plans import catalog, warehouse

    spark = get_session(
        app="bizlens-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) * 2,
        extra={"spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024)},
    )
    spark.range(1).write.format("noop").mode("overwrite").save()  # JVM warm-up

    times: dict[str, float] = {}
    t0 = time.time()
    warehouse.warehouse_fact(spark, sf_dir)
    times["T2_load_warehouse"] = round(time.time() - t0, 3)

    for name in names:
        fn = catalog.QUERIES[name]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
