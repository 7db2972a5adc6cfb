"""Time every registered query at one scale factor; print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list), BENCH_EVENT_LOG (optional folder for
Spark's event log, to read stage and task times afterwards).

Each query is executed in full with the ``noop`` sink (all rows computed,
none collected), twice: ``cold_queries`` has the first run (includes JIT
warm-up of that plan's code paths), ``queries`` the second (warm) run, and
``value`` the sum of the warm runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.catalog import QUERIES  # noqa: E402
from quire.session import build_session  # noqa: E402


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    # Queries that write and stream thousands of files run last, so whatever they leave in the
    # driver JVM cannot affect the timing of the others.
    file_heavy = ["read_uploads", "incremental_ingest"]
    default = [q for q in sorted(QUERIES) if q not in file_heavy] + file_heavy
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or default
    extra = {"spark.driver.memory": "8g"}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.compress": "false",
                      "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="quire-bench", extra=extra)
    # Warm-up, not timed: JIT the JVM paths and start the Python workers once, so
    # the first query with a Python stage is not charged for worker start-up.
    QUERIES["token_count"](spark, root).write.format("noop").mode("overwrite").save()
    spark.range(0, 64, numPartitions=cpus).mapInPandas(lambda it: it, "id long").write.format("noop").mode(
        "overwrite").save()

    cold: dict[str, float] = {}
    times: dict[str, float] = {}
    for name in wanted:
        for store in (cold, times):
            t0 = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = re.search(r"sf([0-9.]+)", root)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else root, "cpus": cpus,
                      "cold_value": round(sum(cold.values()), 3), "cold_queries": cold}))


if __name__ == "__main__":
    main()
