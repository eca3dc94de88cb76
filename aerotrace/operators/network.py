"""Airport-by-quarter-hour grid, its features and targets, and graph diffusion on edge lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions.clock import calendar_cols
from aerotrace.operators.schedule import (
    BUCKET_MIN,
    BUCKETS_PER_DAY,
    airport_set,
    arrival_ops,
    bucket_start,
    departure_ops,
    merge_ops,
)
from aerotrace.operators.slicing import HOME, SLICE, with_halo

# Horizons in buckets (1 to 6 hours) and the trailing history.
HORIZONS = (4, 8, 12, 16, 20, 24)
TRAILING = 8
MEASURES = ("mean_dep_delay_min", "mean_arr_delay_min", "ops_count", "cancellations")
CALENDAR = ("hour_of_day", "day_of_week", "is_holiday")
NODE_FEATURES = (*MEASURES, *CALENDAR)


def dense_grid(flights: DataFrame) -> DataFrame:
    """One row per airport and quarter hour from the first to the last flight date.

    Cells without operations are kept with zeros, the calendar columns included (only observed
    cells get a calendar). Size is airports x 96 x days, whatever the traffic.
    """
    lo, hi = flights.agg(
        F.unix_date(F.min("flight_date")), F.unix_date(F.max("flight_date"))
    ).first()
    axis = F.sequence(
        F.lit(lo * BUCKETS_PER_DAY).cast("long"), F.lit((hi + 1) * BUCKETS_PER_DAY - 1).cast("long")
    )
    cells = airport_set(flights).select("airport", F.explode(axis).alias("bucket"))
    ops = merge_ops(departure_ops(flights), arrival_ops(flights)).withColumn("_seen", F.lit(True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    calendar = calendar_cols(bucket_start("bucket"))
    return cells.join(ops, ["airport", "bucket"], "left").select(
        "airport",
        "bucket",
        F.coalesce("mean_dep_delay_min", F.lit(0.0)).alias("mean_dep_delay_min"),
        F.coalesce("mean_arr_delay_min", F.lit(0.0)).alias("mean_arr_delay_min"),
        (zero("dep_count") + zero("arr_count")).alias("ops_count"),
        zero("cancellations").cast("long").alias("cancellations"),
        *[F.when(F.col("_seen"), c).otherwise(0).alias(name) for name, c in calendar.items()],
    )


def future_targets(grid: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Add ``y_<h>``: mean arrival delay ``h`` buckets ahead, null unless that cell has traffic.

    Windows run per (airport, day) with the next hours copied in, not per whole airport.
    """
    spread = with_halo(grid, F.col("bucket"), BUCKETS_PER_DAY, 0, max(horizons))
    w = Window.partitionBy("airport", SLICE).orderBy("bucket")
    seen = F.when(F.col("ops_count") > 0, F.col("mean_arr_delay_min"))
    return (
        spread.select("*", *[F.lead(seen, h).over(w).alias(f"y_{h}") for h in horizons])
        .where(HOME)
        .drop(HOME, SLICE)
    )


def trailing(
    grid: DataFrame, length: int = TRAILING, cols: tuple[str, ...] = NODE_FEATURES
) -> DataFrame:
    """Add ``seq``: the last ``length`` cells of the airport in order; shorter histories dropped."""
    spread = with_halo(grid, F.col("bucket"), BUCKETS_PER_DAY, length - 1, 0)
    w = Window.partitionBy("airport", SLICE).orderBy("bucket")
    return (
        spread.withColumn("seq", F.collect_list(F.struct(*cols)).over(w.rowsBetween(1 - length, 0)))
        .where(F.col(HOME) & (F.size("seq") == length))
        .drop(HOME, SLICE)
    )


def long_targets(
    grid: DataFrame, keep: tuple[str, ...] = (), horizons: tuple[int, ...] = HORIZONS
) -> DataFrame:
    """One row per (airport, bucket, horizon) that has a target."""
    wide = future_targets(grid, horizons)
    each = F.explode(
        F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"y_{h}").alias("y")) for h in horizons])
    )
    return (
        wide.select("airport", "bucket", *keep, each.alias("t"))
        .select("airport", "bucket", *keep, F.col("t.h").alias("horizon"), F.col("t.y").alias("y"))
        .where("y is not null")
    )


def _issue_calendar(df: DataFrame) -> DataFrame:
    t = bucket_start("bucket")
    return df.withColumn("_hour", F.hour(t)).withColumn("_dow", F.weekday(t))


def historical_mean(train: DataFrame, test: DataFrame) -> DataFrame:
    """Add ``pred``: training mean by (airport, hour, weekday) of the issuing bucket.

    Horizons are pooled; unseen combinations get the overall training mean. Both inputs are
    long target tables.
    """
    known = _issue_calendar(train).groupBy("airport", "_hour", "_dow").agg(
        F.avg("y").alias("_mean")
    )
    overall = train.agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("m")).scalar()
    return (
        _issue_calendar(test)
        .join(known, ["airport", "_hour", "_dow"], "left")
        .withColumn("pred", F.coalesce("_mean", overall))
        .drop("_mean", "_hour", "_dow")
    )


def spread_once(
    values: DataFrame, edges: DataFrame, cols: list[str], keys: tuple[str, ...] = ("bucket",)
) -> DataFrame:
    """One hop: per source airport the weighted sum of its targets' values.

    Zero rows add nothing and are left out before the join, so the work follows the observed
    cells, not the dense grid; partial sums are made before the shuffle.
    """
    some = values.where(F.greatest(*[F.abs(F.col(c).cast("double")) for c in cols], F.lit(0.0)) > 0)
    return (
        some.join(edges.select("src", F.col("dst").alias("airport"), "w"), "airport")
        .groupBy(F.col("src").alias("airport"), *keys)
        .agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])
    )


def neighbor_delay(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """Add the flow-weighted mean of the neighbours' current arrival delay."""
    col = "mean_arr_delay_min"
    around = spread_once(grid.select("airport", "bucket", col), edges, [col])
    return grid.join(
        around.withColumnRenamed(col, "neighbor_delay"), ["airport", "bucket"], "left"
    ).withColumn("neighbor_delay", F.coalesce("neighbor_delay", F.lit(0.0)))


def diffuse(
    grid: DataFrame,
    edges: dict[str, DataFrame],
    hops: int = 2,
    cols: tuple[str, ...] = NODE_FEATURES,
) -> DataFrame:
    """Add ``<graph>_<hop>_<feature>``: features spread over each graph for 1..hops steps."""
    spread = []
    for name, graph in edges.items():
        state = grid.select("airport", "bucket", *cols)
        for hop in range(1, hops + 1):
            state = spread_once(state, graph, list(cols))
            spread.append(state.select("airport", "bucket", F.lit(f"{name}_{hop}").alias("_step"), *cols))
    added = [f"{n}_{h}_{c}" for n in edges for h in range(1, hops + 1) for c in cols]
    if not spread:
        return grid
    steps = reduce(DataFrame.unionByName, spread)
    wide = steps.groupBy("airport", "bucket").agg(*[
        F.max(F.when(F.col("_step") == f"{n}_{h}", F.col(c))).alias(f"{n}_{h}_{c}")
        for n in edges for h in range(1, hops + 1) for c in cols
    ])
    return grid.join(wide, ["airport", "bucket"], "left").fillna(0.0, subset=added)


def recent_node_ops(legs: DataFrame, as_of, buckets: int = TRAILING) -> DataFrame:
    """Operations and cancellations per airport in the ``buckets`` quarter hours before ``as_of``.

    Delays are zero, as the live table has none. A leg is read if either end lies in the
    window; an end less than one bucket too early is then counted in the first bucket, because
    the offset is cut towards zero as in the reference.
    """
    end = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    start = end - F.expr(f"INTERVAL {BUCKET_MIN * buckets} MINUTES")
    used = legs.where((F.col("actual_dep") >= start) | (F.col("actual_arr") >= start))
    flag = F.col("cancelled") if "cancelled" in legs.columns else F.lit(False)

    def side(airport: str, ts: str, cancelled: Column) -> DataFrame:
        offset = (F.unix_micros(ts) - F.unix_micros(start)) / F.lit(BUCKET_MIN * 60e6)
        return used.where(F.col(ts).isNotNull() & F.col(airport).isNotNull()).select(
            F.col(airport).alias("airport"),
            offset.cast("int").alias("b"),
            cancelled.cast("int").alias("c"),
        )

    events = side("origin_icao", "actual_dep", flag).unionByName(
        side("dest_icao", "actual_arr", F.lit(False))
    )
    counted = events.where((F.col("b") >= 0) & (F.col("b") < buckets)).groupBy("airport", "b").agg(
        F.count(F.lit(1)).alias("ops_count"), F.sum("c").alias("cancellations")
    )
    t = F.timestamp_micros(F.unix_micros(start) + F.col("b").cast("long") * F.lit(BUCKET_MIN * 60_000_000))
    return counted.select(
        "airport",
        "b",
        F.lit(0.0).alias("mean_dep_delay_min"),
        F.lit(0.0).alias("mean_arr_delay_min"),
        "ops_count",
        "cancellations",
        *[c.alias(n) for n, c in calendar_cols(t).items()],
    )


RIPPLE_MEASURES = ("mean_dep_delay_min", "mean_arr_delay_min", "ops_count", "cancellations")


def ripple(
    grid: DataFrame,
    edges: dict[str, DataFrame],
    closures: DataFrame,
    neighbors: DataFrame,
    window: int = TRAILING,
    hops: int = 2,
    measures: tuple[str, ...] = RIPPLE_MEASURES,
) -> DataFrame:
    """Diffusion delta of a closure: change of the spread measures at the strongest neighbours.

    ``closures`` has ``airport, bucket, closed_for`` (minutes). The airport's values in the last
    ceil(closed_for / 15) cells of the ``window`` before the bucket are set to zero. Spreading
    is linear, so only the removed values are spread instead of two whole grids, each measure
    over each graph of ``edges``. Not a trained effect.
    """
    affected = F.least(F.lit(window), F.ceil(F.col("closed_for") / BUCKET_MIN))
    cells = closures.select(
        F.col("airport").alias("closed_airport"),
        F.col("airport"),
        F.col("bucket").alias("closed_bucket"),
        F.explode(F.sequence(F.col("bucket") - affected, F.col("bucket") - 1)).alias("bucket"),
    )
    values = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    )
    scenario = ("closed_airport", "closed_bucket")
    removed = (
        cells.join(grid.select("airport", "bucket", values.alias("m")), ["airport", "bucket"])
        .groupBy(*scenario, "airport", F.col("m.measure").alias("measure"))
        .agg((-F.sum("m.value") / window).alias("delta"))
    )
    total = None
    for name, graph in edges.items():
        state = removed
        for hop in range(1, hops + 1):
            state = spread_once(state, graph, ["delta"], (*scenario, "measure"))
            part = state.withColumn("hop", F.lit(hop)).withColumn("graph", F.lit(name))
            total = part if total is None else total.unionByName(part)
    listed = (
        closures.select(
            F.col("airport").alias("closed_airport"), F.col("bucket").alias("closed_bucket")
        )
        .join(
            neighbors.select(
                F.col("src").alias("closed_airport"), F.col("dst").alias("airport"), "rank"
            ),
            "closed_airport",
        )
        .withColumn("hop", F.explode(F.sequence(F.lit(1), F.lit(hops))))
        .withColumn("graph", F.explode(F.array(*map(F.lit, edges))))
        .withColumn("measure", F.explode(F.array(*map(F.lit, measures))))
    )
    return listed.join(
        total, [*scenario, "airport", "measure", "graph", "hop"], "left"
    ).select(
        *scenario,
        F.col("airport").alias("neighbor"),
        "rank",
        "graph",
        "measure",
        "hop",
        F.coalesce("delta", F.lit(0.0)).alias("delta"),
    )
