"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

The reference reads its reports and flights from tables, so those two views are written first
and not timed; each query is run once to warm up, then $BENCH_RUNS times, and the median is taken.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from aerotrace.functions.clock import only_arrivals  # noqa: E402
from aerotrace.operators import (  # noqa: E402
    capacity,
    conflict,
    evaluation,
    network,
    schedule,
    serving,
    tracks,
    windows,
)
from aerotrace.plans import fixtures as fx  # noqa: E402
from aerotrace.plans.trajectory_queries import AS_OF, BOX, HORIZONS, forecast  # noqa: E402
from aerotrace.session import local_session, stored  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, max(4, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    reports = fx.kept(spark, sf_dir, "reports")
    flights = fx.kept(spark, sf_dir, "flights")
    airports, closures = fx.airports(spark, sf_dir), fx.closures(spark, sf_dir)
    model = stored(
        spark,
        evaluation.quantile_model(forecast(spark, sf_dir).where("fold = 'train'")),
        "model",
    )

    def eta():
        folds = evaluation.chronological_split(only_arrivals(flights), "flight_date")
        train = folds.where("fold = 'train'")
        return schedule.eta_features(folds, schedule.taxi_in_medians(train))

    def pipeline():
        return tracks.flight_rows(tracks.track_states(reports), airports)

    queries = {
        "rotation_edges": lambda: schedule.rotation_edges(flights),
        "flow_edges": lambda: schedule.flow_edges(flights),
        "eta_features": eta,
        "airport_grid": lambda: network.dense_grid(flights),
        "track_flights": pipeline,
        "track_anomalies": lambda: tracks.all_anomalies(tracks.track_states(reports)),
        "latest_in_bbox": lambda: serving.latest_in_bbox(reports, BOX, AS_OF),
        "windows_kinematics": lambda: windows.window_features(
            windows.windows(reports, horizons=HORIZONS)
        ),
        "conflicts": lambda: conflict.conflicts(reports, BOX, AS_OF, model, horizons=HORIZONS),
        "capacity_what_if": lambda: capacity.closure_report(
            capacity.queue_waits(capacity.runway_demand(flights), closures)
        ),
    }
    seconds = {}
    for name, build in queries.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            df = build()
            # Every column is computed; nothing is sent to the driver.
            cols = [
                F.map_entries(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes
            ]
            df.select(F.xxhash64(*cols).alias("h")).agg(F.bit_xor("h")).collect()
            times.append(time.perf_counter() - start)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
