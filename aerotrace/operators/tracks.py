"""Batch track pipeline: phases, takeoff/landing edges, legs, events, anomalies, sampling.

Reports must be unique per (icao24, ts); ``operators.ingest.upsert`` makes them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerotrace.functions.clock import leg_id
from aerotrace.functions.geo import bearing_delta
from aerotrace.operators.slicing import SLICE, attach_carry, lag_sliced, time_slice
from aerotrace.operators.spatial import nearest_airport, with_mass, with_type

# Thresholds of the phase rules and the leg and sampling limits.
COVERAGE_GAP_S = 120
APPROACH_ALT_FT = 3000
CRUISE_ALT_FT = 18000
CLIMB_FPM = 300
DESCENT_FPM = -300
MIN_LEG_S = 2 * 60
MAX_LEG_S = 8 * 3600
CRUISE_SAMPLE_S = 15

# Thresholds of the anomaly rules.
EMERGENCY_SQUAWKS = ("7500", "7600", "7700")
RAPID_DESCENT_FPM = -4000
RAPID_DESCENT_ALT_FT = 10000
GO_AROUND_ALT_FT = 3000
GO_AROUND_FPM = 500

SLICE_S = 3600
KEY = "icao24"


def seconds_between(later, earlier) -> Column:
    """Elapsed seconds between two timestamps, with sub-second part."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def gap_flag(df: DataFrame, gap_s: float = COVERAGE_GAP_S, slice_s: int = SLICE_S) -> DataFrame:
    """Add ``gap``: more than ``gap_s`` seconds since the aircraft's previous report."""
    rows = df.withColumn(SLICE, time_slice("ts", slice_s))
    linked = lag_sliced(rows, [KEY], ["ts"], ["ts"])
    return linked.withColumn(
        "gap",
        F.coalesce(seconds_between(F.col("ts"), F.col("prev.ts")) > gap_s, F.lit(False)),
    ).drop("prev", SLICE)


def fixed_phase() -> Column:
    """Phase of a row that does not depend on the row before it, else null."""
    alt, vrate = F.col("baro_alt_ft"), F.col("vert_rate_fpm")
    return (
        F.when(F.col("on_ground"), "ground")
        .when(alt.isNull(), "unknown")
        .when(alt < APPROACH_ALT_FT, F.lit(None).cast("string"))
        .when(vrate >= CLIMB_FPM, "climb")
        .when(vrate <= DESCENT_FPM, "descent")
        .when(alt >= CRUISE_ALT_FT, "cruise")
    )


def _descent_flags(df: DataFrame, w: WindowSpec) -> DataFrame:
    """What has happened so far since the last start, for rows or for whole slices.

    Needs ``_pos`` (order within ``w``), ``_start`` (a new stretch begins here), ``_start_phase``
    (set on starts) and the facts ``_low``, ``_sink``, ``_climb``, ``_appr``: the row or slice
    has a report below the approach altitude, one of them sinking, one climbing, one already
    known as an approach. Adds ``_from`` and the running answers ``_is_low`` etc.
    """
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda flag, frame: F.max(F.when(F.col(flag), F.col("_pos"))).over(frame)
    marked = df.select(
        "*",
        F.coalesce(last("_start", upto), F.lit(0)).alias("_from"),
        F.last("_start_phase", ignorenulls=True).over(upto).alias("_from_phase"),
        last("_sink", past).alias("_sank_at"),
        last("_sink", upto).alias("_sink_at"),
        last("_climb", upto).alias("_climb_at"),
        last("_low", upto).alias("_low_at"),
    ).withColumn(
        # low again after a sinking row: the approach has begun
        "_began", F.col("_appr") | (F.col("_low") & (F.col("_sank_at") >= F.col("_from")))
    )
    since = lambda c: F.coalesce(c >= F.greatest(F.col("_from"), F.lit(1)), F.lit(False))
    return marked.select(
        "*",
        since(last("_began", upto)).alias("_is_appr"),
        since(F.col("_sink_at")).alias("_is_sink"),
        since(F.col("_climb_at")).alias("_is_climb"),
        since(F.col("_low_at")).alias("_is_low"),
    ).drop("_sank_at", "_sink_at", "_climb_at", "_low_at", "_began")


def _continued(phase0: Column) -> Column:
    """Phase after a stretch that began in ``phase0`` and had the running facts."""
    return (
        F.when(phase0 == "approach", "approach")
        .when(phase0 == "descent", F.when(F.col("_is_low"), "approach").otherwise("descent"))
        .when(F.col("_is_appr"), "approach")
        .when(F.col("_is_sink"), "descent")
        .when(F.col("_is_climb"), "climb")
        .otherwise(phase0)
    )


def track_states(
    df: DataFrame, gap_s: float = COVERAGE_GAP_S, slice_s: int = SLICE_S
) -> DataFrame:
    """Per report: phase, previous phase, edges, the last edge before it, segment and position.

    Added columns: ``gap`` (the phase was reset here), ``phase``, ``prev_phase`` (before any
    reset), ``prev_ts``, ``took_off``, ``landed``, ``open_edge`` (struct of the last edge
    *before* this report), ``segment_start`` and ``segment_pos`` (stretches without a gap).

    The phase depends on the whole past of an aircraft, but only through the last phase. Rows
    whose phase is fixed by the row alone start a stretch, and so does a gap; in between four
    running facts decide (see ``_continued``). The same rule is applied to slice summaries to
    get the phase each slice begins with.
    """
    here = Window.partitionBy(KEY, SLICE).orderBy("ts")
    low = ~F.col("on_ground") & (F.col("baro_alt_ft") < APPROACH_ALT_FT)
    yes = lambda c: F.coalesce(c, F.lit(False))
    edge = lambda kind: F.struct(
        kind.alias("kind"), F.col("ts"), F.col("lat"), F.col("lon")
    )

    rows = df.withColumn(SLICE, time_slice("ts", slice_s)).select(
        "*",
        F.row_number().over(here).alias("_pos"),
        F.lag("ts").over(here).alias("_pts"),
        F.lag("on_ground").over(here).alias("_pground"),
        fixed_phase().alias("_fixed"),
    )
    rows = rows.select(
        "*",
        yes(seconds_between(F.col("ts"), F.col("_pts")) > gap_s).alias("_gap"),
        yes(low).alias("_low"),
        yes(low & (F.col("vert_rate_fpm") <= DESCENT_FPM)).alias("_sink"),
        yes(low & (F.col("vert_rate_fpm") >= CLIMB_FPM)).alias("_climb"),
        F.lit(False).alias("_appr"),
        F.when(
            F.col("_pground") != F.col("on_ground"),
            edge(F.when(F.col("on_ground"), "landing").otherwise("takeoff")),
        ).alias("_edge"),
    ).withColumn("_start", F.col("_gap") | F.col("_fixed").isNotNull()).withColumn(
        "_start_phase", F.when(F.col("_start"), F.coalesce("_fixed", F.lit("unknown")))
    )
    rows = _descent_flags(rows, here).select(
        "*",
        F.last("_edge", ignorenulls=True)
        .over(here.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_edge_here"),
        F.last(F.when(F.col("_gap"), F.struct("ts", "_pos")), ignorenulls=True)
        .over(here.rowsBetween(Window.unboundedPreceding, 0))
        .alias("_cut"),
    ).withColumn(
        "_phase_here",
        F.when(F.col("_fixed").isNotNull(), F.col("_fixed")).when(
            F.col("_from") > 0, _continued(F.col("_from_phase"))
        ),
    )

    # One summary row per slice.
    tail = ["ts", "on_ground", "_phase_here", "_is_appr", "_is_sink", "_is_climb", "_is_low",
            "_cut", "_pos"]
    slices = rows.groupBy(KEY, SLICE).agg(
        F.max_by(F.struct(*tail), "ts").alias("t"),
        F.min_by(F.struct("ts", "on_ground", "lat", "lon"), "ts").alias("h"),
        F.max_by("_edge", F.when(F.col("_edge").isNotNull(), F.col("ts"))).alias("_last_edge"),
    )
    by_key = Window.partitionBy(KEY).orderBy(SLICE)
    past = by_key.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        KEY,
        SLICE,
        "t",
        "h",
        "_last_edge",
        F.lag("t.ts").over(by_key).alias("_pts0"),
        F.lag("t.on_ground").over(by_key).alias("_pground0"),
        F.row_number().over(by_key).alias("_pos"),
    ).select(
        "*",
        yes(seconds_between(F.col("h.ts"), F.col("_pts0")) > gap_s).alias("_gap0"),
        F.when(
            F.col("_pground0") != F.col("h.on_ground"),
            F.struct(
                F.when(F.col("h.on_ground"), "landing").otherwise("takeoff").alias("kind"),
                F.col("h.ts"),
                F.col("h.lat"),
                F.col("h.lon"),
            ),
        ).alias("_edge0"),
        F.col("t._phase_here").alias("_end_fixed"),
    ).select(
        "*",
        # A slice whose end phase is known alone is a start, like a fixed row.
        (F.col("_end_fixed").isNotNull() | F.col("_gap0") | F.col("_pts0").isNull()).alias(
            "_start"
        ),
        *[
            (F.col("_end_fixed").isNull() & F.col(f"t._is_{f}")).alias(f"_{f}")
            for f in ("appr", "sink", "climb", "low")
        ],
        # Segment bookkeeping: where the open segment began, rows in it at the slice's end.
        F.when(F.col("t._cut").isNotNull(), F.col("t._cut.ts"))
        .when(F.col("_gap0") | F.col("_pts0").isNull(), F.col("h.ts"))
        .alias("_seg_new"),
        F.when(F.col("t._cut").isNotNull(), F.col("t._pos") - F.col("t._cut._pos") + 1)
        .otherwise(F.col("t._pos"))
        .alias("_seg_rows"),
    ).withColumn(
        "_start_phase", F.when(F.col("_start"), F.coalesce("_end_fixed", F.lit("unknown")))
    )
    slices = _descent_flags(slices, by_key).select(
        "*",
        F.coalesce("_end_fixed", _continued(F.col("_from_phase"))).alias("_end"),
        F.sum("_seg_rows").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("_rows"),
    ).select(
        "*",
        F.last(
            F.when(F.col("_seg_new").isNotNull(), F.col("_rows") - F.col("_seg_rows")),
            ignorenulls=True,
        ).over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("_rows0"),
    )
    carry = slices.select(
        KEY,
        SLICE,
        "_pts0",
        "_pground0",
        "_gap0",
        "_edge0",
        F.lag("_end").over(by_key).alias("_phase0"),
        F.last(F.coalesce("_last_edge", "_edge0"), ignorenulls=True).over(past).alias("_edge_in"),
        F.last("_seg_new", ignorenulls=True).over(past).alias("_seg_in"),
        F.lag(F.col("_rows") - F.col("_rows0")).over(by_key).alias("_seg_rows_in"),
        F.col("h.ts").alias("_first_ts"),
    )

    first = F.col("_pos") == 1
    fresh = F.col("_gap0") | F.col("_pts0").isNull()
    joined = rows.join(carry, [KEY, SLICE]).select(
        "*",
        F.coalesce(
            "_phase_here",
            _continued(F.when(fresh, "unknown").otherwise(F.col("_phase0"))),
        ).alias("phase"),
        (F.col("_gap") | (first & F.col("_gap0"))).alias("gap"),
        F.coalesce("_pts", "_pts0").alias("prev_ts"),
        F.coalesce("_pground", "_pground0").alias("_was_ground"),
    )
    added = ["phase", "gap", "prev_ts"]
    out = joined.select(
        *df.columns,
        *added,
        F.coalesce(F.lag("phase").over(here), F.col("_phase0")).alias("prev_phase"),
        yes(F.col("_was_ground") & ~F.col("on_ground")).alias("took_off"),
        yes(~F.col("_was_ground") & F.col("on_ground")).alias("landed"),
        F.when(first, F.col("_edge_in"))
        .otherwise(F.coalesce("_edge_here", "_edge0", "_edge_in"))
        .alias("open_edge"),
        F.when(F.col("_cut").isNotNull(), F.col("_cut.ts"))
        .when(fresh, F.col("_first_ts"))
        .otherwise(F.col("_seg_in"))
        .alias("segment_start"),
        F.when(F.col("_cut").isNotNull(), F.col("_pos") - F.col("_cut._pos") + 1)
        .when(fresh, F.col("_pos"))
        .otherwise(F.col("_pos") + F.col("_seg_rows_in"))
        .cast("long")
        .alias("segment_pos"),
    )
    return out


def flight_phase(df: DataFrame, **kw) -> DataFrame:
    """Reports with their flight phase."""
    return track_states(df, **kw).select(*df.columns, "gap", "phase")


def ground_edges(states: DataFrame) -> DataFrame:
    """Takeoff and landing reports; the edge survives a coverage gap."""
    return states.where("took_off or landed").select(
        KEY,
        "ts",
        "lat",
        "lon",
        F.when(F.col("took_off"), "takeoff").otherwise("landing").alias("edge"),
        "open_edge",
    )


def pair_legs(states: DataFrame) -> DataFrame:
    """One row per landing: the leg it closes, or a rejection.

    Edges alternate, so the last edge before a landing is its takeoff if there is one. A leg
    must last between 2 minutes and 8 hours, both included.
    """
    landings = states.where("landed")
    opened = F.col("open_edge.kind") == "takeoff"
    duration = seconds_between(F.col("ts"), F.col("open_edge.ts"))
    closed = opened & duration.between(MIN_LEG_S, MAX_LEG_S)
    return landings.select(
        KEY,
        F.when(opened, F.col("open_edge.ts")).alias("dep_ts"),
        F.when(opened, F.col("open_edge.lat")).alias("dep_lat"),
        F.when(opened, F.col("open_edge.lon")).alias("dep_lon"),
        F.col("ts").alias("arr_ts"),
        F.col("lat").alias("arr_lat"),
        F.col("lon").alias("arr_lon"),
        F.when(F.coalesce(closed, F.lit(False)), "closed").otherwise("rejected").alias("outcome"),
    )


def leg_edges(states: DataFrame) -> DataFrame:
    """Takeoffs and the landings that close a leg, each with the leg's departure, in one pass."""
    duration = seconds_between(F.col("ts"), F.col("open_edge.ts"))
    closes = (
        F.col("landed")
        & (F.col("open_edge.kind") == "takeoff")
        & duration.between(MIN_LEG_S, MAX_LEG_S)
    )
    return states.where(F.col("took_off") | F.coalesce(closes, F.lit(False))).select(
        KEY,
        "ts",
        "lat",
        "lon",
        F.when(F.col("took_off"), "takeoff").otherwise("landing").alias("type"),
        F.when(F.col("took_off"), F.col("ts")).otherwise(F.col("open_edge.ts")).alias("dep_ts"),
    )


def flight_rows(states: DataFrame, airports: DataFrame) -> DataFrame:
    """The flights table: one row per takeoff, completed by its landing.

    A leg whose landing was rejected stays ``airborne``. Both ends of a leg carry its departure,
    so they meet in one aggregate and the states are computed once.
    """
    up, down = F.col("type") == "takeoff", F.col("type") == "landing"
    ends = nearest_airport(leg_edges(states), airports)
    legs = ends.groupBy(KEY, "dep_ts").agg(
        F.max(F.when(up, F.col("airport"))).alias("origin_icao"),
        F.max(F.when(down, F.col("airport"))).alias("dest_icao"),
        F.max(F.when(down, F.col("ts"))).alias("actual_arr"),
    )
    return legs.select(
        leg_id(KEY, "dep_ts").alias("flight_id"),
        KEY,
        "origin_icao",
        "dest_icao",
        F.col("dep_ts").alias("actual_dep"),
        "actual_arr",
        F.when(F.col("actual_arr").isNotNull(), "landed").otherwise("airborne").alias("status"),
    )


def leg_events(states: DataFrame) -> DataFrame:
    """Event feed: a takeoff per opened leg, a landing per closed leg, with a JSON payload."""
    flight_id = leg_id(KEY, "dep_ts")
    return leg_edges(states).select(
        flight_id.alias("key"),
        KEY,
        "ts",
        "type",
        F.to_json(F.struct("type", flight_id.alias("flight_id"), KEY)).alias("value"),
    )


def open_leg_start() -> Column:
    """Departure of the leg that was open before this report, else null."""
    return F.when(F.col("open_edge.kind") == "takeoff", F.col("open_edge.ts"))


def enrich(states: DataFrame, flights: DataFrame, registry: DataFrame, perf: DataFrame) -> DataFrame:
    """Reports with phase, origin of the leg open before them, type code and assumed mass."""
    legs = flights.select(KEY, F.col("actual_dep").alias("_dep"), "origin_icao")
    with_origin = states.withColumn("_dep", open_leg_start()).join(legs, [KEY, "_dep"], "left")
    return with_mass(with_type(with_origin.drop("_dep", "open_edge"), registry), perf)


# --- anomaly rules -------------------------------------------------------------------------


def is_emergency_squawk() -> Column:
    return F.coalesce(F.col("squawk").isin(*EMERGENCY_SQUAWKS), F.lit(False))


def is_rapid_descent() -> Column:
    return F.coalesce(
        ~F.col("on_ground")
        & (F.col("vert_rate_fpm") <= RAPID_DESCENT_FPM)
        & (F.col("baro_alt_ft") <= RAPID_DESCENT_ALT_FT),
        F.lit(False),
    )


def is_go_around() -> Column:
    """Approach before this report (before any gap reset), climbing low now.

    Below 3000 ft an approach stays an approach even while climbing, so this fires only at
    exactly 3000 ft or right after a coverage gap; kept as the reference behaves.
    """
    return F.coalesce(
        (F.col("prev_phase") == "approach")
        & (F.col("phase") == "climb")
        & (F.col("baro_alt_ft") <= GO_AROUND_ALT_FT)
        & (F.col("vert_rate_fpm") >= GO_AROUND_FPM),
        F.lit(False),
    )


def emergency_squawk(df: DataFrame) -> DataFrame:
    return df.where(is_emergency_squawk())


def rapid_descent(df: DataFrame) -> DataFrame:
    return df.where(is_rapid_descent())


def go_around(states: DataFrame) -> DataFrame:
    return states.where(is_go_around())


def anomaly_hits() -> Column:
    """Array of the rule hits of one report, each with kind, score and evidence."""
    text = lambda c: F.col(c).cast("string")

    def hit(kind: str, test: Column, *evidence: tuple[str, str]) -> Column:
        pairs = [x for name, col in evidence for x in (F.lit(name), text(col))]
        return F.when(
            test,
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(1.0).alias("score"),
                F.create_map(*pairs).alias("evidence"),
            ),
        )

    return F.array_compact(
        F.array(
            hit("squawk_emergency", is_emergency_squawk(), ("squawk", "squawk")),
            hit(
                "rapid_descent",
                is_rapid_descent(),
                ("vert_rate_fpm", "vert_rate_fpm"),
                ("alt_ft", "baro_alt_ft"),
            ),
            hit(
                "go_around",
                is_go_around(),
                ("alt_ft", "baro_alt_ft"),
                ("vert_rate_fpm", "vert_rate_fpm"),
            ),
        )
    )


def all_anomalies(states: DataFrame) -> DataFrame:
    """Every rule hit as its own row, tied to the leg open before the report."""
    return (
        states.withColumn("_hit", F.explode(anomaly_hits()))
        .withColumn("_dep", open_leg_start())
        .select(
            KEY,
            "ts",
            F.col("_hit.kind").alias("kind"),
            F.col("_hit.score").alias("score"),
            F.col("_hit.evidence").alias("evidence"),
            F.when(F.col("_dep").isNotNull(), leg_id(KEY, "_dep")).alias("flight_id"),
        )
    )


def label_segments(df: DataFrame, gap_s: float = 15, slice_s: int = SLICE_S) -> DataFrame:
    """Per gap-free segment: does any rule (squawk left out) fire inside it?

    The phase starts afresh in each segment, so a hit never looks across the cut.
    """
    states = track_states(df, gap_s=gap_s, slice_s=slice_s).withColumn(
        "prev_phase", F.when(~F.col("gap"), F.col("prev_phase"))
    )
    return states.groupBy(KEY, "segment_start").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(is_rapid_descent() | is_go_around()).alias("flagged"),
    )


def holding(df: DataFrame, turns: float = 2.0, slice_s: int = SLICE_S) -> DataFrame:
    """Stretches of turning one way through at least ``turns`` full circles.

    A stretch ends when the turn changes sign (a straight step keeps it) or the heading is
    missing. The heading change is summed per stretch, so nothing is collected.
    """
    rows = df.withColumn(SLICE, time_slice("ts", slice_s))
    linked = lag_sliced(rows, [KEY], ["ts"], ["heading_deg"]).withColumn(
        "_turn", bearing_delta(F.col("prev.heading_deg"), F.col("heading_deg"))
    )
    signed = linked.withColumn(
        "_way",
        F.when(F.col("_turn").isNull(), 0)
        .when(F.col("_turn") > 0, 1)
        .when(F.col("_turn") < 0, -1)
        .cast("int"),
    )
    turning = lag_known(signed, "_way", "_prev_way")
    cuts = turning.withColumn(
        "_cut",
        F.when((F.col("_way") == 0) | (F.col("_way") != F.coalesce("_prev_way", F.lit(0))),
               F.col("ts")),
    )
    runs = lag_known(cuts, "_cut", "_run", include_self=True)
    return (
        runs.groupBy(KEY, F.col("_run").alias("start_ts"))
        .agg(
            F.max("ts").alias("end_ts"),
            F.sum(F.coalesce("_turn", F.lit(0.0))).alias("turn_deg"),
        )
        .where(F.abs("turn_deg") >= 360.0 * turns)
    )


def lag_known(
    rows: DataFrame, col: str, out: str, include_self: bool = False, slice_col: str = SLICE
) -> DataFrame:
    """Last non-null value of ``col`` before (or up to) each row of the aircraft, over slices."""
    here = (
        Window.partitionBy(KEY, slice_col)
        .orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    )
    carried = attach_carry(
        rows,
        [KEY],
        [F.max_by(col, F.when(F.col(col).isNotNull(), F.col("ts"))).alias("_known")],
        lambda earlier: [F.last("_known", ignorenulls=True).over(earlier).alias("_carry")],
        slice_col,
    )
    return carried.withColumn(
        out, F.coalesce(F.last(col, ignorenulls=True).over(here), F.col("_carry"))
    ).drop("_carry")
