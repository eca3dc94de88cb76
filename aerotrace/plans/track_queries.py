"""C1-C3, D1, D13, E3-E11, F: the track pipeline over all reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.functions.clock import PHASES, WAKE_CATEGORIES, one_hot
from aerotrace.operators import rollups, sampling, serving, spatial, tracks, windows
from aerotrace.plans import fixtures as fx
from aerotrace.plans.oracle_views import rnd, sql, turn
from aerotrace.plans.registry import query


def states(spark, sf):
    return tracks.track_states(fx.reports(spark, sf))


@query(
    "c1_nearest_airport",
    sql(
        "SELECT icao24, ts, CASE WHEN took_off THEN 'takeoff' ELSE 'landing' END AS edge, airport"
        " FROM edge_near",
        "edge_near",
    ),
)
def c1(spark, sf):
    edges = tracks.ground_edges(states(spark, sf)).drop("open_edge")
    return spatial.nearest_airport(edges, fx.airports(spark, sf)).drop("lat", "lon")


@query(
    "c2_with_type",
    sql(
        "SELECT icao24, ts, type_code FROM fx_reports LEFT JOIN fx_registry USING (icao24)",
        "fx_reports",
        "fx_registry",
    ),
)
def c2(spark, sf):
    rows = fx.reports(spark, sf).select("icao24", "ts")
    return spatial.with_type(rows, fx.registry(spark, sf))


MASS_SQL = """
    CASE WHEN NOT on_ground AND baro_alt_ft IS NOT NULL AND velocity_kt IS NOT NULL
         THEN oew_kg + 0.5e0*(mtow_kg - oew_kg) END AS mass_kg
"""


@query(
    "c3_with_mass",
    sql(
        f"""
        SELECT icao24, ts, type_code, {MASS_SQL}, coalesce(wtc, 'unknown') AS wtc
        FROM fx_reports LEFT JOIN fx_registry USING (icao24) LEFT JOIN fx_perf USING (type_code)
        """,
        "fx_reports",
        "fx_registry",
        "fx_perf",
    ),
)
def c3(spark, sf):
    typed = spatial.with_type(fx.reports(spark, sf), fx.registry(spark, sf))
    return spatial.with_mass(typed, fx.perf(spark)).select(
        "icao24", "ts", "type_code", "mass_kg", "wtc"
    )


def rollup_sql(seconds: int) -> str:
    return sql(
        f"""
        SELECT icao24, to_timestamp(epoch(ts)::BIGINT // {seconds} * {seconds})::TIMESTAMP AS bucket,
               {rnd('avg(lat)', 'lat')}, {rnd('avg(lon)', 'lon')},
               {rnd('avg(baro_alt_ft)', 'baro_alt_ft')}, {rnd('avg(velocity_kt)', 'velocity_kt')},
               {rnd('avg(vert_rate_fpm)', 'vert_rate_fpm')},
               arg_max(heading_deg, ts) AS heading_deg, bool_and(on_ground) AS on_ground
        FROM fx_reports GROUP BY ALL
        """,
        "fx_reports",
    )


@query("d1_rollup_15s", rollup_sql(15))
def d1_15(spark, sf):
    return rollups.rollup(fx.reports(spark, sf), 15)


@query("d1_rollup_60s", rollup_sql(60))
def d1_60(spark, sf):
    return rollups.rollup(fx.reports(spark, sf), 60)


@query("d13_anomaly_counts", sql("SELECT kind, count(*) AS n FROM hits GROUP BY 1", "hits"))
def d13(spark, sf):
    return serving.counts_by(tracks.all_anomalies(states(spark, sf)), ["kind"])


@query("e3_gap_flag", sql("SELECT icao24, ts, gap FROM states", "states"))
def e3(spark, sf):
    return tracks.gap_flag(fx.reports(spark, sf)).select("icao24", "ts", "gap")


@query("e4_flight_phase", sql("SELECT icao24, ts, gap, phase FROM states", "states"))
def e4(spark, sf):
    return tracks.flight_phase(fx.reports(spark, sf)).select("icao24", "ts", "gap", "phase")


_ONE_HOTS = ", ".join(
    [f"(phase = '{p}')::INT AS phase_{p}" for p in PHASES]
    + [f"(coalesce(wtc, 'unknown') = '{w}')::INT AS wtc_{w.lower()}" for w in WAKE_CATEGORIES]
)


@query(
    "b12_one_hot",
    sql(
        f"""
        SELECT icao24, ts, {_ONE_HOTS} FROM states
        LEFT JOIN fx_registry USING (icao24) LEFT JOIN fx_perf USING (type_code)
        """,
        "states",
        "fx_registry",
        "fx_perf",
    ),
)
def b12(spark, sf):
    typed = spatial.with_type(tracks.flight_phase(fx.reports(spark, sf)), fx.registry(spark, sf))
    return spatial.with_mass(typed, fx.perf(spark)).select(
        "icao24", "ts", *one_hot("phase", PHASES, "phase"), *one_hot("wtc", WAKE_CATEGORIES, "wtc")
    )


@query(
    "e5_ground_edges",
    sql(
        "SELECT icao24, ts, CASE WHEN took_off THEN 'takeoff' ELSE 'landing' END AS edge FROM edges",
        "edges",
    ),
)
def e5(spark, sf):
    return tracks.ground_edges(states(spark, sf)).select("icao24", "ts", "edge")


@query("e6_pair_legs", sql("SELECT icao24, dep_ts, arr_ts, outcome FROM pairs_legs", "pairs_legs"))
def e6(spark, sf):
    return tracks.pair_legs(states(spark, sf)).select("icao24", "dep_ts", "arr_ts", "outcome")


@query("e7_flight_rows", sql("SELECT * FROM fx_legs", "fx_legs"))
def e7(spark, sf):
    return tracks.flight_rows(states(spark, sf), fx.airports(spark, sf))


@query(
    "e8_leg_events",
    sql(
        """
        SELECT flight_id AS key, icao24, ts, type,
               '{"type":"' || type || '","flight_id":"' || flight_id || '","icao24":"' || icao24 || '"}' AS value
        FROM (SELECT flight_id, icao24, actual_dep AS ts, 'takeoff' AS type FROM fx_legs
              UNION ALL
              SELECT flight_id, icao24, actual_arr, 'landing' FROM fx_legs WHERE status = 'landed')
        """,
        "fx_legs",
    ),
)
def e8(spark, sf):
    return tracks.leg_events(states(spark, sf))


@query(
    "e9_enrich",
    sql(
        f"""
        SELECT s.icao24, s.ts, phase, origin_icao, type_code, {MASS_SQL}
        FROM states s
        LEFT JOIN fx_legs f ON f.icao24 = s.icao24 AND s.e_kind = 'takeoff' AND f.actual_dep = s.e_ts
        LEFT JOIN fx_registry r ON r.icao24 = s.icao24 LEFT JOIN fx_perf USING (type_code)
        """,
        "states",
        "fx_legs",
        "fx_registry",
        "fx_perf",
    ),
)
def e9(spark, sf):
    st = states(spark, sf)
    flights = tracks.flight_rows(st, fx.airports(spark, sf))
    return tracks.enrich(st, flights, fx.registry(spark, sf), fx.perf(spark)).select(
        "icao24", "ts", "phase", "origin_icao", "type_code", "mass_kg"
    )


SAMPLED_SQL = """
    , walk AS (
      SELECT icao24, i, ts, phase, true AS kept, ts AS last FROM states WHERE i = 1
      UNION ALL
      SELECT n.icao24, n.i, n.ts, n.phase,
             n.phase <> 'cruise' OR epoch_us(n.ts) - epoch_us(w.last) >= 15000000,
             CASE WHEN n.phase <> 'cruise' OR epoch_us(n.ts) - epoch_us(w.last) >= 15000000
                  THEN n.ts ELSE w.last END
      FROM walk w JOIN states n ON n.icao24 = w.icao24 AND n.i = w.i + 1)
    SELECT icao24, ts, phase FROM walk WHERE kept
"""


@query("e10_adaptive_sample", sql(SAMPLED_SQL, "states"))
def e10(spark, sf):
    phased = tracks.flight_phase(fx.reports(spark, sf)).select("icao24", "ts", "phase")
    return sampling.adaptive_sample(phased)


@query(
    "e11_segments", sql("SELECT icao24, ts, segment_start, segment_pos FROM states15", "states15")
)
def e11(spark, sf):
    return windows.segments(fx.reports(spark, sf)).select(
        "icao24", "ts", "segment_start", "segment_pos"
    )


def hit_sql(kind: str) -> str:
    return sql(
        f"SELECT icao24, ts, baro_alt_ft, vert_rate_fpm, squawk FROM hits WHERE kind = '{kind}'",
        "hits",
    )


_HIT = ("icao24", "ts", "baro_alt_ft", "vert_rate_fpm", "squawk")


@query("f1_emergency_squawk", hit_sql("squawk_emergency"))
def f1(spark, sf):
    return tracks.emergency_squawk(fx.reports(spark, sf)).select(*_HIT)


@query("f2_rapid_descent", hit_sql("rapid_descent"))
def f2(spark, sf):
    return tracks.rapid_descent(fx.reports(spark, sf)).select(*_HIT)


@query("f3_go_around", hit_sql("go_around"))
def f3(spark, sf):
    return tracks.go_around(states(spark, sf)).select(*_HIT)


@query(
    "f4_all_anomalies",
    sql(
        """
        SELECT icao24, ts, kind, 1e0 AS score,
               CASE WHEN kind = 'squawk_emergency' THEN squawk END AS squawk,
               CASE WHEN kind <> 'squawk_emergency' THEN baro_alt_ft END AS alt_ft,
               CASE WHEN e_kind = 'takeoff'
                    THEN md5(icao24 || '|' || epoch_ms(e_ts)::VARCHAR) END AS flight_id
        FROM hits
        """,
        "hits",
    ),
)
def f4(spark, sf):
    return tracks.all_anomalies(states(spark, sf)).select(
        "icao24",
        "ts",
        "kind",
        "score",
        F.col("evidence")["squawk"].alias("squawk"),
        F.col("evidence")["alt_ft"].cast("double").alias("alt_ft"),
        "flight_id",
    )


@query(
    "f5_label_segments",
    sql(
        """
        SELECT icao24, segment_start, count(*) AS n,
               bool_or(coalesce(NOT on_ground AND vert_rate_fpm <= -4000 AND baro_alt_ft <= 10000, false)
                 OR coalesce(NOT gap AND prev_phase = 'approach' AND phase = 'climb'
                             AND baro_alt_ft <= 3000 AND vert_rate_fpm >= 500, false)) AS flagged
        FROM states15 GROUP BY ALL
        """,
        "states15",
    ),
)
def f5(spark, sf):
    return tracks.label_segments(fx.reports(spark, sf))


@query(
    "f6_holding",
    sql(
        f"""
        , t AS (SELECT icao24, ts, i, {turn('lag(heading_deg) OVER w', 'heading_deg')} AS d
                FROM num WINDOW w AS (PARTITION BY icao24 ORDER BY ts)),
        runs AS (
          SELECT icao24, i, ts, d, CASE WHEN d > 0 THEN 1 WHEN d < 0 THEN -1 ELSE 0 END AS way,
                 ts AS start_ts FROM t WHERE i = 1
          UNION ALL
          SELECT t.icao24, t.i, t.ts, t.d,
                 CASE WHEN t.d > 0 THEN 1 WHEN t.d < 0 THEN -1 WHEN t.d = 0 THEN r.way ELSE 0 END,
                 CASE WHEN t.d IS NULL OR (t.d > 0 AND r.way <> 1) OR (t.d < 0 AND r.way <> -1)
                      THEN t.ts ELSE r.start_ts END
          FROM runs r JOIN t ON t.icao24 = r.icao24 AND t.i = r.i + 1)
        SELECT icao24, start_ts, max(ts) AS end_ts, sum(coalesce(d, 0)) AS turn_deg
        FROM runs GROUP BY icao24, start_ts HAVING abs(sum(coalesce(d, 0))) >= 720
        """,
        "num",
    ),
)
def f6(spark, sf):
    return tracks.holding(fx.reports(spark, sf))
