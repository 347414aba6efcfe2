"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is run once to warm up, then timed ``$BENCH_REPEAT`` times (default 1)
(median reported); the result is fully consumed with a no-op write
(``format("noop")``), so the whole plan runs without collecting to the
driver.  ``value`` is the sum of the per-query medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from goldtally.session import local_session  # noqa: E402
from goldtally.suite import registry  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    # Partition sizing for CPU-heavy rows (JSON text, nested records): byte
    # targets well below the defaults, so compressed-but-costly data still
    # spreads over every core; on a cluster the same settings scale with data.
    split = os.environ.get("BENCH_SPLIT_BYTES", "8m")
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          extra={"spark.sql.files.maxPartitionBytes": split,
                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": split})
    times = {}
    for name, fn in registry.QUERIES.items():
        if only and name not in only:
            continue
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
