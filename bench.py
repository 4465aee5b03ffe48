"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR   folder of the tables       (default /root/testdata/sf0.1)
BENCH_CPUS     cores                      (default 8)
BENCH_RUNS     timed runs, after one warm-up; the median counts (default 3)
BENCH_QUERIES  comma-separated names      (default all)

Results are written to Spark's no-op sink, so every row is computed and none is
brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from storelens.registry import QUERIES  # noqa: E402
from storelens.registry_sql import ORACLE_SQL  # noqa: E402
from storelens.session import single_machine_session  # noqa: E402


def timed(query, spark, folder: str) -> float:
    began = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def two_scan_form(name: str):
    """The same report from its text, which scans the impressions once per number."""

    def query(spark, folder: str):
        for table in ("supplier", "orders", "lineitem", "events"):
            spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(ORACLE_SQL[name].replace("VARCHAR", "STRING"))

    return query


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)

    spark = single_machine_session(cores, **{"spark.ui.showConsoleProgress": "false"})

    def median(query) -> float:
        timed(query, spark, folder)
        return round(statistics.median(timed(query, spark, folder) for _ in range(runs)), 3)

    seconds = {name: median(QUERIES[name]) for name in names}
    two_scan = {
        name: median(two_scan_form(name)) for name in ("impression_share", "keyword_rank") if name in names
    }
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "two_scan_form": two_scan,
        "sf": Path(folder).name.removeprefix("sf"),
        "cores": cores,
        "runs": runs,
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
