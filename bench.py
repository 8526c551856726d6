"""Benchmark: the report and operator queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, no
rows pulled to the driver). Prints one JSON line; its value is the sum of the
headline queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rota.plans.catalog import queries  # noqa: E402
from rota.session import build_session  # noqa: E402

HEADLINE = (
    "report_v1", "report_v2", "report_v3", "report_v4", "report_v5",
    "report_v1_all", "report_v2_all", "report_v3_all", "report_v4_all", "report_v5_all",
    "shift_ranges", "change_blocks", "location_ranges", "allow_list_in", "doc_nested",
    "access_flags", "location_details", "shift_summary_left",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(f"local[{cpus}]", cpus, app_name="rota-bench")
    qs = queries()
    # JVM / codegen warm-up, not timed.
    for name in ("shift_span", "report_v3"):
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in [*HEADLINE, *(n for n in qs if n not in HEADLINE)]:
        best = None
        for _ in range(repeats):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times[n] for n in HEADLINE), 3),
        "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None,
    }))


if __name__ == "__main__":
    main()
