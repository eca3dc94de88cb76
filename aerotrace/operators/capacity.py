"""Runway capacity: waiting times of every airport and day in closed form, with a closure.

One runway serves first come, first served at a fixed duration ``s``. Flight n (0-based, in
order) starts at ``max over m <= n of (a_m - s m) + s n``. Planned times are whole minutes, so
the maximum is taken over minutes (at most 1441 per airport-day, whatever the traffic) and a
flight adds its place within the minute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions.clock import flight_key, hhmm_minutes

# Service time, "affected" threshold, saturation threshold (minutes).
SERVICE_MIN = 1.5
AFFECTED_MIN = 1e-9
SATURATED_MIN = 30.0

DAY = ["airport", "day"]


def runway_demand(flights: DataFrame) -> DataFrame:
    """One row per planned departure and arrival of a flight that was not cancelled."""
    flown = flights.where(F.col("cancelled") != 1).withColumn(
        "_id", flight_key("carrier", "flight_number", "flight_date")
    )

    def side(airport: str, hhmm: str, name: str) -> DataFrame:
        return flown.select(
            F.col(airport).alias("airport"),
            F.col("flight_date").alias("day"),
            hhmm_minutes(hhmm).alias("scheduled_minute"),
            F.concat("_id", F.lit("_" + name[:3])).alias("flight_id"),
            F.lit(name).alias("operation"),
        ).where(F.col("scheduled_minute").isNotNull())

    return side("origin", "crs_dep_hhmm", "departure").unionByName(
        side("dest", "crs_arr_hhmm", "arrival")
    )


def queue_waits(
    demand: DataFrame,
    closures: DataFrame | None = None,
    service: float = SERVICE_MIN,
) -> DataFrame:
    """Per flight: baseline wait and, with ``closures``, the wait with one closure per airport.

    ``closures`` has ``airport, closed_from, closed_for`` (minutes of the day, each day). The
    first flight whose service would touch the closure is moved to its end and the queue
    restarts there.
    """
    minutes = demand.groupBy(*DAY, "scheduled_minute").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*DAY).orderBy("scheduled_minute")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    minutes = minutes.withColumn(
        "_c", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_slack", F.col("scheduled_minute") - service * F.col("_c"))
    minutes = minutes.withColumn("_lead", F.max("_slack").over(upto))
    if closures is not None:
        shut = closures.select(
            "airport",
            F.col("closed_from").alias("_cs"),
            (F.col("closed_from") + F.col("closed_for")).alias("_ce"),
        )
        first_start = F.col("_lead") + service * F.col("_c")
        place = F.greatest(
            F.lit(0), F.floor((F.col("_cs") - service - first_start) / service) + 1
        )
        hit = (place < F.col("_n")) & (first_start + service * place < F.col("_ce"))
        minutes = (
            minutes.join(shut, "airport", "left")
            .withColumn("_moved", F.min(F.when(hit, F.col("_c") + place)).over(Window.partitionBy(*DAY)))
            .withColumn(
                "_lead2",
                F.greatest(
                    F.col("_ce") - service * F.col("_moved"),
                    F.max(F.when(F.col("_c") > F.col("_moved"), F.col("_slack"))).over(upto),
                ),
            )
        )
    else:
        minutes = minutes.withColumn("_moved", F.lit(None).cast("long")).withColumn(
            "_lead2", F.lit(None).cast("double")
        )
    # A runway's minute holds a few flights, so their places by id need no further cut.
    here = Window.partitionBy(*DAY, "scheduled_minute").orderBy("flight_id")
    placed = demand.withColumn("_rank", F.row_number().over(here))
    n = F.col("_c") + F.col("_rank") - 1
    a = F.col("scheduled_minute")
    base = F.col("_lead") + service * n - a
    moved = F.when(n >= F.col("_moved"), F.col("_lead2") + service * n - a).otherwise(base)
    return placed.join(
        minutes.select(*DAY, "scheduled_minute", "_c", "_lead", "_lead2", "_moved"),
        [*DAY, "scheduled_minute"],
    ).select(
        *demand.columns,
        (n + 1).cast("long").alias("queue_pos"),
        base.alias("baseline_wait_min"),
        moved.alias("scenario_wait_min"),
        (moved - base).alias("added_delay_min"),
    )


def queue_wait(demand: DataFrame, service: float = SERVICE_MIN) -> DataFrame:
    """Waits without any closure."""
    return queue_waits(demand, None, service).drop("scenario_wait_min", "added_delay_min")


def closure_report(waits: DataFrame) -> DataFrame:
    """Per airport and day: what the closure adds, and how busy the runway is without it."""
    added = F.col("added_delay_min")
    return waits.groupBy(*DAY).agg(
        F.sum(added).alias("total_added_delay_min"),
        F.count_if(added > AFFECTED_MIN).alias("affected_flight_count"),
        F.max(added).alias("max_added_delay_min"),
        F.count(F.lit(1)).alias("flights_simulated"),
        F.avg("baseline_wait_min").alias("baseline_mean_wait_min"),
        F.max("baseline_wait_min").alias("baseline_max_wait_min"),
        (F.avg("baseline_wait_min") > SATURATED_MIN).alias("already_saturated"),
    )
