"""Times the registered queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a
comma-separated choice of queries. Each query runs once to warm up and then ``BENCH_RUNS``
times; the median counts. Results go to the no-op sink, so all rows are computed and none
is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from stationcast import queries as registry
from stationcast.session import build_session

HEADLINE = [
    "daily_features", "daily_resample", "daily_from_orders", "multi_window_features", "outer_join_sources",
    "asof_latest_ttl", "upsert_features", "missing_dates", "ozone_8h_daily_max", "aqi_from_subindices",
    "iqr_cap", "impute_train_mean", "expanding_folds", "last_n_per_station", "latest_row",
    "align_predictions", "regression_metrics", "stack_metrics", "blend_apply", "forecast_record",
    "describe_numeric", "correlation_matrix", "histogram", "boxplot_weekday", "kde_grid", "capped_sample",
    "scan_csv_roundtrip", "json_arrays_to_rows", "stream_daily", "linear_select", "rf_train", "gbt_train",
]
# long fits and streams run once, without a warm-up
ONCE = {"linear_select", "rf_train", "gbt_train", "stream_daily"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    registry.load_all()
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-", dir="/tmp"),
    )
    times: dict[str, float] = {}
    for name in names:
        laps = []
        for _ in range(1 if name in ONCE else runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        times[name] = round(statistics.median(laps[1:] or laps), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
