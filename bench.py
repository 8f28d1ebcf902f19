"""Headline and per-operator timings: one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local threads; names given as
arguments restrict the run. Every query is run once to warm up and once measured, its result
written to the ``noop`` sink so that every row is produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINES = (
    "full_rows", "full_rows_nested", "catalogue_kpis", "shop_goods_kpis", "kpi_sheet", "top_stock_value", "variation_summary",
    "snapshot_diff", "wide_diff", "long_diff", "url_history", "baseline_jobs", "snapshot_upsert", "clean_url_map", "pending_urls",
    "merge_proxies", "request_statistics", "latency_statistics", "outcome_streaks", "recent_latency", "rolling_success", "budget_states",
    "moving_latency", "job_counters", "bulk_runs", "seo_fields", "page_links", "page_structure", "block_verdicts", "page_quality",
    "cms_census", "duplicate_documents", "version_similarity", "vendor_variants", "selector_state", "stream_tumbling_counts",
)


def main() -> None:
    from catalogwatch.plans import load_all
    from catalogwatch.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load_all()
    names = sys.argv[1:] or list(HEADLINES)
    if names == ["all"]:
        names = list(queries)
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8", spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        for measured in (False, True):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if measured:
                times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
