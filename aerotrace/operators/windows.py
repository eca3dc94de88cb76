"""Trajectory datasets: segments, sliding windows, kinematics, targets, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerotrace.functions.clock import PHASES, WAKE_CATEGORIES, one_hot
from aerotrace.functions.geo import (
    EARTH_RADIUS_M,
    bearing_deg,
    bearing_delta,
    enu_east,
    enu_north,
    haversine_m,
)
from aerotrace.operators.slicing import HOME, SLICE, with_halo
from aerotrace.operators.tracks import (
    APPROACH_ALT_FT,
    CLIMB_FPM,
    CRUISE_ALT_FT,
    DESCENT_FPM,
    KEY,
    SLICE_S,
    seconds_between,
    track_states,
)

# Fixed values of the trajectory dataset.
WINDOW = 12
STRIDE = 4
SEGMENT_GAP_S = 15
HORIZONS_S = (60, 180, 300, 600, 900)
TOLERANCE_S = 3
NATIVE_STEP_S = 5.0
MPS_TO_KT = 1.94384
RESAMPLE_POINTS = 128

_POINT = ("ts", "lat", "lon", "baro_alt_ft", "vert_rate_fpm", "heading_deg")


def segments(df: DataFrame, gap_s: float = SEGMENT_GAP_S, slice_s: int = SLICE_S) -> DataFrame:
    """Add the gap-free segment: its start, the position in it, and the phase folded from its start."""
    states = track_states(df, gap_s=gap_s, slice_s=slice_s)
    return states.select(*df.columns, "segment_start", "segment_pos", "phase")


def windows(
    df: DataFrame,
    size: int = WINDOW,
    stride: int = STRIDE,
    horizons: tuple[int, ...] = (),
    tol_s: int = TOLERANCE_S,
    gap_s: float = SEGMENT_GAP_S,
    slice_s: int = SLICE_S,
) -> DataFrame:
    """One row per window of ``size`` reports, every ``stride`` reports from a segment's start.

    ``points`` holds the reports in order; anchor columns describe the last one. With
    ``horizons``, ``targets`` has per horizon the report of the same segment nearest to anchor
    plus horizon, within ``tol_s`` (the earlier one on a tie).

    A window spans at most ``(size - 1) * gap_s`` seconds and a target at most the longest
    horizon, so a halo around each time slice holds all that is needed.
    """
    segs = segments(df, gap_s, slice_s).withColumn("_ms", F.unix_millis("ts"))
    before = int((size - 1) * gap_s * 1000)
    after = (max(horizons) + tol_s) * 1000 + 1 if horizons else 0
    length = max(slice_s * 1000, before, after)
    spread = with_halo(segs, F.col("_ms"), length, before, after)
    # Within one slice of one segment no frame reaches into another segment.
    w = Window.partitionBy(KEY, SLICE, "segment_start").orderBy("_ms")
    built = spread.withColumn(
        "points", F.collect_list(F.struct(*_POINT)).over(w.rowsBetween(1 - size, 0))
    )
    for h in horizons:
        built = built.withColumn(f"_near_{h}", _nearest(w, h, tol_s))
    anchored = built.where(
        F.col(HOME)
        & (F.col("segment_pos") >= size)
        & ((F.col("segment_pos") - size) % stride == 0)
    )
    targets = F.array(*[_target(F.col(f"_near_{h}"), h) for h in horizons])
    keep = [c for c in ("type_code", "wtc") if c in df.columns]
    return anchored.select(
        KEY,
        "segment_start",
        "segment_pos",
        F.col("ts").alias("anchor_ts"),
        "phase",
        *keep,
        "points",
        *([targets.alias("targets")] if horizons else []),
    )


def _nearest(w: WindowSpec, horizon: int, tol_s: int) -> Column:
    """The report nearest to this one's time plus ``horizon``: the last one up to that time or
    the first one after it, so a frame keeps one row, not a list. The earlier one on a tie."""
    at, tol = horizon * 1000, tol_s * 1000
    us = F.unix_micros("ts")
    place = ("lat", "lon", F.col("baro_alt_ft").alias("alt"))
    # of reports in the same millisecond the first counts
    upto = F.max(F.struct(F.col("_ms").alias("ms"), (-us).alias("us"), *place)).over(
        w.rangeBetween(at - tol, at)
    )
    after = F.min(F.struct(F.col("_ms").alias("ms"), us.alias("us"), *place)).over(
        w.rangeBetween(at + 1, at + tol)
    )
    return F.struct((F.col("_ms") + at).alias("wanted"), upto.alias("upto"), after.alias("after"))


def _target(near: Column, horizon: int) -> Column:
    upto, after, wanted = near["upto"], near["after"], near["wanted"]
    earlier = after.isNull() | (wanted - upto["ms"] <= after["ms"] - wanted)
    pick = lambda f: F.when(earlier, upto[f]).otherwise(after[f])
    return F.struct(
        F.lit(horizon).alias("horizon_s"),
        pick("ms").alias("ms"),
        pick("lat").alias("lat"),
        pick("lon").alias("lon"),
        pick("alt").alias("alt_ft"),
    )


def nearest_in_time(
    df: DataFrame,
    horizons: tuple[int, ...] = HORIZONS_S,
    tol_s: int = TOLERANCE_S,
    gap_s: float = SEGMENT_GAP_S,
    slice_s: int = SLICE_S,
) -> DataFrame:
    """Every report joined to the one nearest to its time plus each horizon, same segment."""
    return (
        windows(df, 1, 1, horizons, tol_s, gap_s, slice_s)
        .select(KEY, "anchor_ts", F.explode("targets").alias("t"))
        .select(
            KEY,
            "anchor_ts",
            "t.horizon_s",
            F.timestamp_millis("t.ms").alias("target_ts"),
            "t.lat",
            "t.lon",
            "t.alt_ft",
        )
    )


def window_features(w: DataFrame) -> DataFrame:
    """Add ``steps``: per report after the first, offsets from it and the step's kinematics.

    Offsets east/north are cumulative; altitude change, rates and turn are per step and 0 where
    an input is missing. Windows whose times do not strictly increase are left out.
    """
    # The anchor is worked out once per window; inside the array only differences are taken.
    w = w.withColumn("_p0", F.col("points")[0]).withColumn(
        "_cos0", F.cos(F.radians(F.col("_p0.lat")))
    )
    east = lambda p: F.radians(p["lon"] - F.col("_p0.lon")) * EARTH_RADIUS_M * F.col("_cos0")
    north = lambda p: F.radians(p["lat"] - F.col("_p0.lat")) * EARTH_RADIUS_M

    def step(cur: Column, prev: Column) -> Column:
        dt_s = F.nullif(seconds_between(cur["ts"], prev["ts"]), F.lit(0.0))
        e, n, pe, pn = east(cur), north(cur), east(prev), north(prev)
        rise = cur["baro_alt_ft"] - prev["baro_alt_ft"]
        turn = bearing_delta(prev["heading_deg"], cur["heading_deg"])
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return F.struct(
            e.alias("east_m"),
            n.alias("north_m"),
            zero(rise).alias("alt_delta_ft"),
            (F.sqrt((e - pe) * (e - pe) + (n - pn) * (n - pn)) / dt_s * MPS_TO_KT).alias("gs_kt"),
            zero(rise / dt_s * 60).alias("vrate_fpm"),
            zero(turn / dt_s).alias("turn_deg_s"),
            dt_s.alias("dt_s"),
        )

    last = F.size("points") - 1
    later, earlier = F.slice("points", F.lit(2), last), F.slice("points", F.lit(1), last)
    # Asked of the times alone: a condition on ``steps`` would work them out a second time.
    rising = F.forall(
        F.zip_with(later, earlier, lambda c, p: F.coalesce(c["ts"] > p["ts"], F.lit(False))),
        lambda up: up,
    )
    return w.where(rising).withColumn("steps", F.zip_with(later, earlier, step)).drop("_p0", "_cos0")


def dest_context(w: DataFrame, lat: str, lon: str) -> DataFrame:
    """Bearing and distance in km from the window's last report to a destination."""
    p = F.element_at("points", -1)
    return w.withColumn(
        "dest_bearing_deg", bearing_deg(p["lat"], p["lon"], lat, lon)
    ).withColumn("dest_km", haversine_m(p["lat"], p["lon"], lat, lon) / 1000)


def training_table(w: DataFrame) -> DataFrame:
    """Windows with steps, static one-hots and ENU targets; windows without any target dropped."""
    p = F.element_at("points", -1)

    def target(t: Column) -> Column:
        found = t["ms"].isNotNull()
        rise = F.coalesce(t["alt_ft"] - p["baro_alt_ft"], F.lit(0.0))
        return F.struct(
            t["horizon_s"].alias("horizon_s"),
            enu_east(t["lat"], t["lon"], p["lat"], p["lon"]).alias("east_m"),
            enu_north(t["lat"], t["lon"], p["lat"], p["lon"]).alias("north_m"),
            F.when(found, rise).alias("alt_ft"),
        )

    wtc = F.col("wtc") if "wtc" in w.columns else F.lit("unknown")
    return (
        window_features(w)
        .withColumn("y", F.transform("targets", target))
        .where(F.exists("y", lambda t: t["east_m"].isNotNull()))
        .select(
            KEY,
            "anchor_ts",
            "phase",
            "steps",
            "y",
            *one_hot("phase", PHASES, "phase"),
            *one_hot(wtc, WAKE_CATEGORIES, "wtc"),
        )
    )


def constant_velocity(w: DataFrame, horizons: tuple[int, ...] = HORIZONS_S) -> DataFrame:
    """Dead reckoning: the last step's displacement per 5 s, carried to each horizon."""
    last, prev = F.element_at("steps", -1), F.element_at("steps", -2)
    h = F.col("horizon_s")
    speed = lambda f: (last[f] - prev[f]) / NATIVE_STEP_S * h
    return w.withColumn(
        "horizon_s", F.explode(F.array(*[F.lit(x) for x in horizons]))
    ).select(
        *w.columns,
        "horizon_s",
        speed("east_m").alias("pred_east_m"),
        speed("north_m").alias("pred_north_m"),
        speed("alt_delta_ft").alias("pred_alt_ft"),
    )


def folded_phase(points: Column) -> Column:
    """Phase after a short array of reports, starting from nothing and ignoring gaps."""

    def advance(prev: Column, r: Column) -> Column:
        alt, vrate = r["baro_alt_ft"], r["vert_rate_fpm"]
        return (
            F.when(r["on_ground"], "ground")
            .when(alt.isNull(), "unknown")
            .when((alt < APPROACH_ALT_FT) & prev.isin("descent", "approach"), "approach")
            .when(vrate >= CLIMB_FPM, "climb")
            .when(vrate <= DESCENT_FPM, "descent")
            .when(alt >= CRUISE_ALT_FT, "cruise")
            .otherwise(prev)
        )

    return F.aggregate(points, F.lit("unknown"), advance)


def latest_window(df: DataFrame, size: int = WINDOW) -> DataFrame:
    """The last ``size`` reports of each aircraft that has as many, with steps and phase.

    The rank filter is applied before the shuffle too, so each task sends at most ``size`` rows
    per aircraft.
    """
    newest = Window.partitionBy(KEY).orderBy(F.col("ts").desc())
    fields = [*_POINT, "on_ground"]
    grouped = (
        df.select(KEY, *fields)
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= size)
        .groupBy(KEY)
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("points"))
        .where(F.size("points") == size)
    )
    return window_features(
        grouped.withColumn("phase", folded_phase(F.col("points"))).withColumn(
            "anchor_ts", F.element_at("points", -1)["ts"]
        )
    )


def resample(
    df: DataFrame,
    n: int = RESAMPLE_POINTS,
    gap_s: float = SEGMENT_GAP_S,
    slice_s: int = SLICE_S,
) -> DataFrame:
    """Each segment of at least ``n`` reports as ``n`` evenly spaced, interpolated points.

    Channels: metres east and north of the first report, altitude and speed (missing read as
    0). A report owns the sample times up to its successor; the segment's last sample belongs
    to the last pair. The successor is at most one gap away, so a short halo supplies it.
    """
    segs = segments(df, gap_s, slice_s).select(
        KEY,
        "segment_start",
        "segment_pos",
        F.unix_millis("ts").alias("_ms"),
        "lat",
        "lon",
        F.coalesce("baro_alt_ft", F.lit(0.0)).alias("alt_ft"),
        F.coalesce("velocity_kt", F.lit(0.0)).alias("gs_kt"),
    )
    bounds = segs.groupBy(KEY, "segment_start").agg(
        F.min("_ms").alias("t0"),
        F.max("_ms").alias("t1"),
        F.count(F.lit(1)).alias("rows"),
        F.min_by("lat", "_ms").alias("lat0"),
        F.min_by("lon", "_ms").alias("lon0"),
    ).where(F.col("rows") >= n)
    chan = ("lat", "lon", "alt_ft", "gs_kt")
    w = Window.partitionBy(KEY, SLICE).orderBy("_ms")
    pairs = (
        with_halo(segs, F.col("_ms"), slice_s * 1000, 0, int(gap_s * 1000) + 1)
        .withColumn("_next", F.lead(F.struct("_ms", "segment_start", *chan)).over(w))
        .where(F.col(HOME) & (F.col("_next.segment_start") == F.col("segment_start")))
        .join(bounds, [KEY, "segment_start"])
    )
    step = (F.col("t1") - F.col("t0")) / F.lit(float(n - 1))
    first = F.ceil((F.col("_ms") - F.col("t0")) / step)
    upto = F.when(F.col("_next._ms") == F.col("t1"), F.lit(n - 1)).otherwise(
        F.ceil((F.col("_next._ms") - F.col("t0")) / step) - 1
    )
    sampled = (
        pairs.withColumn("_lo", first)
        .withColumn("_hi", upto)
        .where("_lo <= _hi")
        .withColumn("k", F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int"))))
    )
    at = F.least(F.col("t1").cast("double"), F.col("t0") + F.col("k") * step)
    part = (at - F.col("_ms")) / (F.col("_next._ms") - F.col("_ms"))
    blend = lambda a, b: a + (b - a) * part
    # The local frame is linear in latitude and longitude, so blending those is the same.
    lat, lon = blend(F.col("lat"), F.col("_next.lat")), blend(F.col("lon"), F.col("_next.lon"))
    return sampled.select(
        KEY,
        "segment_start",
        "k",
        enu_east(lat, lon, "lat0", "lon0").alias("east_m"),
        enu_north(lat, lon, "lat0", "lon0").alias("north_m"),
        blend(F.col("alt_ft"), F.col("_next.alt_ft")).alias("alt_ft"),
        blend(F.col("gs_kt"), F.col("_next.gs_kt")).alias("gs_kt"),
    )
