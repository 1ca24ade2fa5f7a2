"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from plumbline.plans import QUERIES
from plumbline.session import local_session

HEADLINE = [
    "bid_totals", "room_schedule", "sanity_flags", "plausibility_corrected", "takeoff_diff", "diff_summary",
    "search_surfaces", "symbol_rooms", "bulk_edit", "undo_edits", "merge_surfaces", "daily_spend", "rate_limit",
    "cache_keys", "callouts", "dim_rows", "accuracy_metrics", "fuse_geometry", "room_faces", "wall_components",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    names = [n for n in HEADLINE if n in QUERIES]
    QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(found.group(1)) if found else folder}))


if __name__ == "__main__":
    main()
