"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from footfall.queries import QUERIES
from footfall.session import session

HEADLINE = (
    "segment_count", "segment_count_rich", "segment_members", "behavior_pass", "funnel_histogram", "funnel_folded", "funnel_audience", "identity_resolve",
    "dedup_events", "feed_latest", "feed_cursor", "stats_daily", "stats_hourly", "catalog_events", "rollup_device_index", "person_summary", "ingest_outcomes",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main(names: list[str]) -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in names or HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first warms up
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        took[name] = round(statistics.median(times[1:]), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else sf_dir, "cpus": int(cpus)}))


if __name__ == "__main__":
    main(sys.argv[1:])
