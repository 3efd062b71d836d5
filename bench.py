"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
BENCH_QUERIES may list other query names, or "all". Every query runs once cold and then three times
warm; the middle warm time counts, so that a busy moment of the machine does not. All rows and
columns are computed (a sink that discards them), so nothing is pruned away by counting.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallywork.catalog import QUERIES
from tallywork.session import build_session, scratch

HEADLINES = [
    "mean_ride_length", "rides_whole_report", "merge_three_tables", "merge_with_hot_key",
    "enrich_from_dimensions", "complete_categories", "value_shares", "share_of_total",
    "several_aggregates", "pivot_means", "distinct_counts", "duplicate_rows", "null_percent",
    "describe_columns", "group_quantiles", "box_summary", "correlation_matrix", "regression_line",
    "bootstrap_band", "renumber_rows", "rank_by_count", "values_at_ranks", "collect_launches",
    "launch_labels_success_rate", "launch_sql_ranked_outcomes", "activity_hourly", "impute_mean",
    "ridge_fit", "forest_report", "traffic_spikes", "credential_stuffing", "stream_tumbling_counts",
    "html_cells", "csv_scan",
]


def shuffle_and_spill(spark, since: int) -> tuple[int, int, int]:
    """Bytes shuffled and spilled by the stages started after stage ``since``, and the last stage."""
    gateway = spark.sparkContext._gateway
    no_quantiles = gateway.new_array(gateway.jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, no_quantiles, None)
    shuffled = spilled = 0
    last = since
    for i in range(stages.size()):
        stage = stages.apply(i)
        if stage.stageId() > since:
            shuffled += stage.shuffleWriteBytes()
            spilled += stage.diskBytesSpilled()
            last = max(last, stage.stageId())
    return shuffled, spilled, last


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    names = list(QUERIES) if chosen == ["all"] else chosen
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__ui__retainedStages="100000",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, details = {}, {}
    last = -1
    for name in names:
        runs = []
        for _ in range(4):
            with scratch(spark):
                start = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            shuffled, spilled, last = shuffle_and_spill(spark, last)
        times[name] = round(sorted(runs[1:])[1], 3)
        details[name] = {"cold": round(runs[0], 3), "warm": times[name], "shuffle_bytes": shuffled, "spill_bytes": spilled}
        print(f"{name}: {details[name]}", file=sys.stderr, flush=True)
    spark.stop()
    if os.environ.get("BENCH_DETAILS"):
        with open(os.environ["BENCH_DETAILS"], "w") as out:
            json.dump(details, out, indent=1)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
