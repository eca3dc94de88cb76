"""On-time schedule analytics: congestion, medians, lookups, operations per quarter hour, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions.clock import flight_key, hhmm_hour, hhmm_minutes

# Bucket length, congestion block, default taxi-in, mph to knots.
BUCKET_MIN = 15
BUCKETS_PER_DAY = 96
BLOCK_MIN = 30
DEFAULT_TAXI_IN_MIN = 10.0
MPH_TO_KT = 0.868976

ETA_FEATURES = (
    "distance_mi",
    "sched_elapsed_min",
    "sched_block_speed_kt",
    "dep_delay_min",
    "hour_of_day",
    "day_of_week",
    "month",
    "dest_sched_arrivals_30min",
    "historic_taxi_in_p50_min",
    "carrier",
    "origin",
    "dest",
)
ETA_TARGET = "arr_delay_min"


def day_number(date) -> Column:
    return F.unix_date(F.col(date) if isinstance(date, str) else date)


def quarter_hour(date: str, hhmm: str) -> Column:
    """Absolute 15-minute bucket of a local time of day; a missing time counts as midnight."""
    return (
        day_number(date) * BUCKETS_PER_DAY
        + F.floor(hhmm_minutes(hhmm, nulls="zero") / BUCKET_MIN)
    ).cast("long")


def bucket_start(bucket) -> Column:
    return F.timestamp_seconds(F.col(bucket) * (BUCKET_MIN * 60))


def dest_congestion(df: DataFrame) -> DataFrame:
    """Add the number of *other* arrivals planned at the destination in the same half hour.

    Counted by an aggregate (combined before the shuffle) and joined back, so a crowded
    half hour is never gathered in one task.
    """
    block = F.floor(hhmm_minutes("crs_arr_hhmm") / BLOCK_MIN)
    keyed = df.withColumn("_block", block)
    counts = keyed.groupBy("flight_date", "dest", "_block").agg(
        (F.count(F.lit(1)) - 1).alias("dest_sched_arrivals_30min")
    )
    return keyed.join(counts, ["flight_date", "dest", "_block"], "left").drop("_block")


def _median(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Exact median from value counts: whole minutes have few distinct values per group."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return counts.groupBy(*keys).agg(F.percentile(col, 0.5, F.col("_n")).alias(out))


def taxi_in_medians(train: DataFrame, col: str = "taxi_in_min") -> dict[str, DataFrame]:
    """Median taxi-in per (dest, carrier), per dest and overall; fit on the training fold only."""
    return {
        "pair": _median(train, ["dest", "carrier"], col, "pair_p50"),
        "single": _median(train, ["dest"], col, "single_p50"),
        "overall": _median(train, [], col, "overall_p50"),
    }


def lookup_fallback(df: DataFrame, medians: dict[str, DataFrame], out: str) -> DataFrame:
    """Most specific median that exists: (dest, carrier), then dest, then overall."""
    return (
        df.join(medians["pair"], ["dest", "carrier"], "left")
        .join(medians["single"], "dest", "left")
        .withColumn(
            out, F.coalesce("pair_p50", "single_p50", medians["overall"].scalar())
        )
        .drop("pair_p50", "single_p50")
    )


def eta_features(df: DataFrame, medians: dict[str, DataFrame], keep: tuple[str, ...] = ()) -> DataFrame:
    """Arrival-delay features in fixed order plus the target; same call for training and serving.

    A non-positive scheduled duration is an error.
    """
    elapsed = F.when(F.col("sched_elapsed_min") > 0, F.col("sched_elapsed_min")).otherwise(
        F.raise_error(F.lit("sched_elapsed_min must be positive")).cast("double")
    )
    table = lookup_fallback(dest_congestion(df), medians, "_taxi")
    return table.select(
        *keep,
        "distance_mi",
        elapsed.alias("sched_elapsed_min"),
        (F.col("distance_mi") / (elapsed / 60) * MPH_TO_KT).alias("sched_block_speed_kt"),
        "dep_delay_min",
        hhmm_hour("crs_dep_hhmm").alias("hour_of_day"),
        "day_of_week",
        "month",
        "dest_sched_arrivals_30min",
        F.coalesce("_taxi", F.lit(DEFAULT_TAXI_IN_MIN)).alias("historic_taxi_in_p50_min"),
        "carrier",
        "origin",
        "dest",
        ETA_TARGET,
    )


def departure_ops(df: DataFrame) -> DataFrame:
    """Per (origin, quarter hour): mean departure delay, departures, cancellations."""
    return df.groupBy(
        F.col("origin").alias("airport"), quarter_hour("flight_date", "crs_dep_hhmm").alias("bucket")
    ).agg(
        F.avg("dep_delay_min").alias("mean_dep_delay_min"),
        F.count(F.lit(1)).alias("dep_count"),
        F.sum("cancelled").alias("cancellations"),
    )


def arrival_ops(df: DataFrame) -> DataFrame:
    """Per (dest, quarter hour): mean arrival delay, arrivals."""
    return df.groupBy(
        F.col("dest").alias("airport"), quarter_hour("flight_date", "crs_arr_hhmm").alias("bucket")
    ).agg(
        F.avg("arr_delay_min").alias("mean_arr_delay_min"),
        F.count(F.lit(1)).alias("arr_count"),
    )


def merge_ops(dep: DataFrame, arr: DataFrame) -> DataFrame:
    """Full outer merge on (airport, bucket); both sides are already partitioned by it."""
    return dep.join(arr, ["airport", "bucket"], "full_outer")


def airport_set(df: DataFrame) -> DataFrame:
    """All airports of a flights table."""
    return (
        df.select(F.col("origin").alias("airport"))
        .unionByName(df.select(F.col("dest").alias("airport")))
        .distinct()
    )


def flow_edges(df: DataFrame) -> DataFrame:
    """Traffic edges: flights in both directions, normalised per source (a loop counts twice)."""
    pairs = df.groupBy("origin", "dest").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("origin").alias("src"), F.col("dest").alias("dst"), "n").unionByName(
        pairs.select(F.col("dest").alias("src"), F.col("origin").alias("dst"), "n")
    )
    return _normalised(both.groupBy("src", "dst").agg(F.sum("n").alias("n")))


def _normalised(edges: DataFrame) -> DataFrame:
    """Weights per source. At most one row per airport pair reaches this window."""
    return edges.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def with_previous_leg(df: DataFrame, fields: list[str]) -> DataFrame:
    """Flights with a tail number and ``prev``: ``fields`` of the tail's previous leg.

    Legs are ordered by date, planned departure and then all identifying columns. An aircraft flies
    a few legs a day, so one window holds all legs of a tail: some thousands a year.
    """
    order = ["flight_date", "_dep", "carrier", "flight_number", "origin", "dest", "crs_arr_hhmm"]
    legs = (
        df.where(F.col("tail_number").isNotNull())
        .withColumn("_dep", hhmm_minutes("crs_dep_hhmm", nulls="zero"))
    )
    earlier = Window.partitionBy("tail_number").orderBy(*order)
    return legs.withColumn("prev", F.lag(F.struct(*fields)).over(earlier)).drop("_dep")


def rotation_edges(df: DataFrame) -> DataFrame:
    """Aircraft-rotation edges: a tail leaving from where it last arrived adds (origin, dest)."""
    turned = with_previous_leg(
        df.select("tail_number", "flight_date", "crs_dep_hhmm", "crs_arr_hhmm", "carrier",
                  "flight_number", "origin", "dest"),
        ["dest"],
    ).where(F.col("prev.dest") == F.col("origin"))
    counts = turned.groupBy(F.col("origin").alias("src"), F.col("dest").alias("dst")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _normalised(counts)


def rotation_link(df: DataFrame) -> DataFrame:
    """Each leg with the id of the tail's previous leg."""
    keyed = df.withColumn("flight_id", flight_key("carrier", "flight_number", "flight_date"))
    linked = with_previous_leg(keyed, ["flight_id"])
    return linked.withColumn("prev_leg_flight_id", F.col("prev.flight_id")).drop("prev")


def month_facts(df: DataFrame) -> DataFrame:
    """Distinct airports and flight ids, first date and the day after the last one."""
    ids = df.select(flight_key("carrier", "flight_number", "flight_date").alias("id")).distinct()
    span = df.agg(
        F.min("flight_date").alias("month_start"),
        F.date_add(F.max("flight_date"), 1).alias("month_end"),
    )
    return span.withColumn(
        "n_airports", airport_set(df).agg(F.count(F.lit(1)).alias("n")).scalar()
    ).withColumn("n_flight_ids", ids.agg(F.count(F.lit(1)).alias("n")).scalar())
