"""C4, C5, C9, E12-E17, I, J5-J7, J11: trajectory datasets, forecasts and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.functions.draws import hash_uniforms, triangular
from aerotrace.operators import conflict, evaluation, spatial, windows
from aerotrace.operators.tracks import label_segments
from aerotrace.plans import fixtures as fx
from aerotrace.plans.oracle_views import VIEWS, bearing, east, hav, north, rnd, sql, turn, view
from aerotrace.plans.registry import query

HORIZONS = windows.HORIZONS_S
RESAMPLED = 128
BOX = (39.0, 39.4, -98.0, -97.0)
AS_OF = "2024-01-01 14:03:20"
DEST = ("39.16e0", "-97.84e0")

# --- SQL views ---------------------------------------------------------------------------------

view(
    "win",
    """
    SELECT icao24, i, ts AS anchor_ts, segment_start, segment_pos, phase
    FROM states15 WHERE segment_pos >= 12 AND (segment_pos - 12) % 4 = 0
    """,
    "states15",
)
_E = east("c.lat", "c.lon", "z.lat", "z.lon")
_N = north("c.lat", "c.lon", "z.lat", "z.lon")
_PE = east("p.lat", "p.lon", "z.lat", "z.lon")
_PN = north("p.lat", "p.lon", "z.lat", "z.lon")
_DT = "((epoch_us(c.ts) - epoch_us(p.ts)) / 1e6)"


def steps_sql(source: str) -> str:
    """Steps of each window: anchor at row ``i``, first point eleven rows before."""
    return f"""
    SELECT w.icao24, w.anchor_ts, w.i, w.phase, s.k, {_E} AS east_m, {_N} AS north_m,
           coalesce(c.baro_alt_ft - p.baro_alt_ft, 0) AS alt_delta_ft,
           sqrt(pow({_E} - {_PE}, 2) + pow({_N} - {_PN}, 2)) / {_DT} * 1.94384e0 AS gs_kt,
           coalesce((c.baro_alt_ft - p.baro_alt_ft) / {_DT} * 60, 0) AS vrate_fpm,
           coalesce({turn('p.heading_deg', 'c.heading_deg')} / {_DT}, 0) AS turn_deg_s
    FROM {source} w CROSS JOIN (SELECT unnest(range(1, 12)) AS k) s
    JOIN num z ON z.icao24 = w.icao24 AND z.i = w.i - 11
    JOIN num c ON c.icao24 = w.icao24 AND c.i = w.i - 11 + s.k
    JOIN num p ON p.icao24 = w.icao24 AND p.i = w.i - 12 + s.k
    """


view("steps", steps_sql("win"), "win", "num")
_OFF = "abs(epoch_ms(t.ts) - epoch_ms(w.ts) - h*1000)"
view(
    "near15",
    f"""
    SELECT * FROM (
      SELECT w.icao24, w.i, w.ts AS anchor_ts, w.lat AS lat0, w.lon AS lon0, w.baro_alt_ft AS alt0,
             h AS horizon_s, t.ts AS target_ts, t.lat, t.lon, t.baro_alt_ft AS alt_ft,
             row_number() OVER (PARTITION BY w.icao24, w.i, h ORDER BY {_OFF}, t.ts) AS rn
      FROM states15 w CROSS JOIN (VALUES (60), (180), (300), (600), (900)) v(h)
      JOIN states15 t ON t.icao24 = w.icao24 AND t.segment_start = w.segment_start
                     AND {_OFF} <= 3000)
    WHERE rn = 1
    """,
    "states15",
)
view(
    "cv",
    """
    SELECT l.icao24, l.anchor_ts, l.i, l.phase, h AS horizon_s,
           (l.east_m - p.east_m) / 5 * h AS pred_east_m,
           (l.north_m - p.north_m) / 5 * h AS pred_north_m,
           (l.alt_delta_ft - p.alt_delta_ft) / 5 * h AS pred_alt_ft
    FROM (SELECT * FROM steps WHERE k = 11) l JOIN (SELECT * FROM steps WHERE k = 10) p
      USING (icao24, anchor_ts)
    CROSS JOIN (VALUES (60), (180), (300), (600), (900)) v(h)
    """,
    "steps",
)
_FOLD = "CASE WHEN epoch_us(c.anchor_ts) < lo + span*0.7e0 THEN 'train' WHEN epoch_us(c.anchor_ts) < lo + span*0.85e0 THEN 'val' ELSE 'test' END"
view(
    "scored",
    f"""
    SELECT c.*, {east('n.lat', 'n.lon', 'n.lat0', 'n.lon0')} AS y_east_m,
           {north('n.lat', 'n.lon', 'n.lat0', 'n.lon0')} AS y_north_m,
           CASE WHEN n.i IS NOT NULL THEN coalesce(n.alt_ft - n.alt0, 0) END AS y_alt_ft,
           {_FOLD} AS fold
    FROM cv c LEFT JOIN near15 n
      ON n.icao24 = c.icao24 AND n.i = c.i AND n.horizon_s = c.horizon_s
    CROSS JOIN (SELECT min(epoch_us(anchor_ts)) AS lo,
                       (max(epoch_us(anchor_ts)) - min(epoch_us(anchor_ts)))::DOUBLE AS span FROM win)
    """,
    "cv",
    "near15",
)
_RESIDUALS = """
    FROM (SELECT horizon_s, phase, 'east_m' AS axis, y_east_m - pred_east_m AS r, fold FROM scored
          UNION ALL SELECT horizon_s, phase, 'north_m', y_north_m - pred_north_m, fold FROM scored
          UNION ALL SELECT horizon_s, phase, 'alt_ft', y_alt_ft - pred_alt_ft, fold FROM scored)
    WHERE r IS NOT NULL AND fold = 'train' GROUP BY ALL
"""
_QUANTILES = "quantile_cont(r, 0.1) AS q10, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.9) AS q90"
view("model", f"SELECT horizon_s, phase, axis, {_QUANTILES}, count(*) AS n {_RESIDUALS}", "scored")
view("pooled", f"SELECT horizon_s, axis, {_QUANTILES} {_RESIDUALS}", "scored")
_PIVOT = ", ".join(
    f"max(CASE WHEN axis = '{a}' THEN {q} END) AS r_{q}_{a}"
    for a in conflict.AXES
    for q in conflict.QUANTILES
)
_QCOLS = ", ".join(
    f"f.pred_{a} + coalesce(m.r_{q}_{a}, p.r_{q}_{a}) AS {q}_{a}"
    for a in conflict.AXES
    for q in conflict.QUANTILES
)


def widened(source: str) -> str:
    return f"""
    SELECT f.*, {_QCOLS} FROM {source} f
    LEFT JOIN (SELECT horizon_s, phase, {_PIVOT} FROM model GROUP BY 1, 2) m
      ON m.horizon_s = f.horizon_s AND m.phase = f.phase
    LEFT JOIN (SELECT horizon_s, {_PIVOT} FROM pooled GROUP BY 1) p ON p.horizon_s = f.horizon_s
    """


view("quantiles", widened("scored"), "scored", "model", "pooled")


def pin(y: str, pred: str, q: float) -> str:
    return f"greatest({q}e0*({y} - {pred}), ({q}e0 - 1)*({y} - {pred}))"


_CRPS = "(" + " + ".join(
    pin(f"y_{a}", f"{k}_{a}", p)
    for a in ("east_m", "north_m")
    for k, p in evaluation.QUANTILE_PROBS.items()
) + ") / 6"

# --- windows -----------------------------------------------------------------------------------


def wins(spark, sf, horizons=HORIZONS):
    return windows.windows(fx.reports(spark, sf), horizons=horizons)


@query(
    "e12_windows",
    sql(
        """
        SELECT w.icao24, anchor_ts, segment_start, segment_pos, phase, z.ts AS first_ts,
               round(z.lat, 6) + 0.0 AS first_lat, 12 AS n_points
        FROM win w JOIN num z ON z.icao24 = w.icao24 AND z.i = w.i - 11
        """,
        "win",
        "num",
    ),
)
def e12(spark, sf):
    return wins(spark, sf, ()).select(
        "icao24",
        "anchor_ts",
        "segment_start",
        "segment_pos",
        "phase",
        F.col("points")[0]["ts"].alias("first_ts"),
        F.col("points")[0]["lat"].alias("first_lat"),
        F.size("points").alias("n_points"),
    )


_STEP = ("east_m", "north_m", "alt_delta_ft", "gs_kt", "vrate_fpm", "turn_deg_s")


@query(
    "e13_window_features",
    sql(
        f"SELECT icao24, anchor_ts, k::INT AS k, {', '.join(rnd(c, c) for c in _STEP)} FROM steps",
        "steps",
    ),
)
def e13(spark, sf):
    steps = windows.window_features(wins(spark, sf, ()))
    return steps.select("icao24", "anchor_ts", F.posexplode("steps").alias("p", "s")).select(
        "icao24", "anchor_ts", (F.col("p") + 1).alias("k"), *[F.col(f"s.{c}") for c in _STEP]
    )


@query(
    "e14_dest_context",
    sql(
        f"""
        SELECT w.icao24, anchor_ts, {rnd(bearing('a.lat', 'a.lon', *DEST), 'dest_bearing_deg')},
               {rnd(hav('a.lat', 'a.lon', *DEST) + ' / 1000', 'dest_km')}
        FROM win w JOIN num a USING (icao24, i)
        """,
        "win",
        "num",
    ),
)
def e14(spark, sf):
    w = wins(spark, sf, ()).withColumn("dlat", F.lit(39.16)).withColumn("dlon", F.lit(-97.84))
    return windows.dest_context(w, "dlat", "dlon").select(
        "icao24", "anchor_ts", "dest_bearing_deg", "dest_km"
    )


view(
    "last12",
    """
    SELECT icao24, max(i) AS i FROM num GROUP BY icao24 HAVING count(*) >= 12
    """,
    "num",
)
view(
    "last_phase",
    """
    SELECT l.icao24, l.i AS last_i, n.i,
           CASE WHEN n.on_ground THEN 'ground' WHEN n.baro_alt_ft IS NULL THEN 'unknown'
                WHEN n.baro_alt_ft < 3000 AND false THEN 'approach'
                WHEN n.vert_rate_fpm >= 300 THEN 'climb' WHEN n.vert_rate_fpm <= -300 THEN 'descent'
                WHEN n.baro_alt_ft >= 18000 THEN 'cruise' ELSE 'unknown' END AS phase
    FROM last12 l JOIN num n ON n.icao24 = l.icao24 AND n.i = l.i - 11
    UNION ALL
    SELECT s.icao24, s.last_i, n.i,
           CASE WHEN n.on_ground THEN 'ground' WHEN n.baro_alt_ft IS NULL THEN 'unknown'
                WHEN n.baro_alt_ft < 3000 AND s.phase IN ('descent', 'approach') THEN 'approach'
                WHEN n.vert_rate_fpm >= 300 THEN 'climb' WHEN n.vert_rate_fpm <= -300 THEN 'descent'
                WHEN n.baro_alt_ft >= 18000 THEN 'cruise' ELSE s.phase END
    FROM last_phase s JOIN num n ON n.icao24 = s.icao24 AND n.i = s.i + 1 AND n.i <= s.last_i
    """,
    "last12",
    "num",
)
view(
    "last_win",
    "SELECT l.icao24, l.i, n.ts AS anchor_ts, p.phase FROM last12 l JOIN num n USING (icao24, i)"
    " JOIN last_phase p ON p.icao24 = l.icao24 AND p.i = l.i",
    "last_phase",
)
view("last_steps", steps_sql("last_win"), "last_win", "num")


@query(
    "e15_latest_window",
    sql(
        f"SELECT icao24, anchor_ts, phase, k::INT AS k, {', '.join(rnd(c, c) for c in _STEP)}"
        " FROM last_steps",
        "last_steps",
    ),
)
def e15(spark, sf):
    latest = windows.latest_window(fx.reports(spark, sf))
    return latest.select(
        "icao24", "anchor_ts", "phase", F.posexplode("steps").alias("p", "s")
    ).select(
        "icao24", "anchor_ts", "phase", (F.col("p") + 1).alias("k"), *[F.col(f"s.{c}") for c in _STEP]
    )


@query(
    "c5_nearest_in_time",
    sql(
        f"""
        SELECT icao24, anchor_ts, v.h AS horizon_s, target_ts, {rnd('n.lat', 'lat')},
               {rnd('n.lon', 'lon')}, n.alt_ft
        FROM (SELECT icao24, i, ts FROM states15) w CROSS JOIN (VALUES (60), (180), (300), (600), (900)) v(h)
        LEFT JOIN near15 n ON n.icao24 = w.icao24 AND n.i = w.i AND n.horizon_s = v.h
        """.replace("SELECT icao24, anchor_ts,", "SELECT w.icao24, w.ts AS anchor_ts,"),
        "near15",
    ),
)
def c5(spark, sf):
    return windows.nearest_in_time(fx.reports(spark, sf), HORIZONS)


_STEP_K = "((epoch_ms(b.t1) - epoch_ms(b.t0)) / {m}e0)".format(m=RESAMPLED - 1)
_AT = f"(epoch_ms(b.t0) + s.k * {_STEP_K})"
_FR = f"(({_AT} - epoch_ms(a.ts)) / (epoch_ms(z.ts) - epoch_ms(a.ts)))"


def _mix(c: str) -> str:
    return f"(coalesce(a.{c}, 0) + (coalesce(z.{c}, 0) - coalesce(a.{c}, 0)) * {_FR})"


@query(
    "e16_resample",
    sql(
        f"""
        , b AS (SELECT icao24, segment_start, min(ts) AS t0, max(ts) AS t1, min(i) AS i0
                FROM states15 GROUP BY 1, 2 HAVING count(*) >= {RESAMPLED}),
        o AS (SELECT b.*, n.lat AS lat0, n.lon AS lon0 FROM b JOIN num n ON n.icao24 = b.icao24 AND n.i = b.i0),
        picked AS (
          SELECT b.icao24, b.segment_start, s.k, {_mix('lat')} AS lat, {_mix('lon')} AS lon,
                 {_mix('baro_alt_ft')} AS alt, {_mix('velocity_kt')} AS gs, lat0, lon0,
                 row_number() OVER (PARTITION BY b.icao24, b.segment_start, s.k ORDER BY a.ts DESC) AS rn
          FROM o b CROSS JOIN (SELECT unnest(range({RESAMPLED})) AS k) s
          JOIN states15 a ON a.icao24 = b.icao24 AND a.segment_start = b.segment_start
          JOIN states15 z ON z.icao24 = a.icao24 AND z.segment_start = a.segment_start AND z.i = a.i + 1
          WHERE {_AT} >= epoch_ms(a.ts) - 1e-3 AND {_AT} <= epoch_ms(z.ts) + 1e-3)
        SELECT icao24, segment_start, k::INT AS k,
               {rnd(east('lat', 'lon', 'lat0', 'lon0'), 'east_m')},
               {rnd(north('lat', 'lon', 'lat0', 'lon0'), 'north_m')}, {rnd('alt', 'alt_ft')},
               {rnd('gs', 'gs_kt')}
        FROM picked WHERE rn = 1
        """,
        "states15",
        "num",
    ),
)
def e16(spark, sf):
    return windows.resample(fx.reports(spark, sf), RESAMPLED)


_PRED = ", ".join(rnd(f"pred_{a}", f"pred_{a}") for a in conflict.AXES)


@query(
    "e17_constant_velocity",
    sql(f"SELECT icao24, anchor_ts, horizon_s, {_PRED} FROM cv", "cv"),
)
def e17(spark, sf):
    w = windows.window_features(wins(spark, sf, ()))
    return windows.constant_velocity(w, HORIZONS).select(
        "icao24", "anchor_ts", "horizon_s", *[f"pred_{a}" for a in conflict.AXES]
    )


def forecast(spark, sf):
    """Point forecasts with targets and fold, stored: the fit and the scoring both read it."""

    def points():
        w = windows.window_features(wins(spark, sf))
        return evaluation.with_targets(windows.constant_velocity(w, HORIZONS)).drop(
            "points", "targets", "steps"
        )

    return evaluation.chronological_split(fx.kept(spark, sf, "forecast", points), "anchor_ts")


@query(
    "j5_trajectory_errors",
    sql(
        f"""
        SELECT horizon_s, {rnd('quantile_cont(km, 0.5)', 'median_error_km')},
               {rnd('quantile_cont(km, 0.9)', 'p90_error_km')}, count(*) AS n
        FROM (SELECT horizon_s, sqrt(pow(pred_east_m - y_east_m, 2) + pow(pred_north_m - y_north_m, 2)) / 1000 AS km
              FROM scored WHERE y_east_m IS NOT NULL) GROUP BY 1
        """,
        "scored",
    ),
)
def j5(spark, sf):
    return evaluation.trajectory_errors(forecast(spark, sf))


@query(
    "e17_training_table",
    sql(
        f"""
        SELECT icao24, anchor_ts, phase, 11 AS n_steps, count(y_east_m) AS n_targets,
               {rnd('max(CASE WHEN horizon_s = 60 THEN y_east_m END)', 'east_60_m')},
               CASE WHEN phase = 'cruise' THEN 1e0 ELSE 0e0 END AS phase_cruise, 1e0 AS wtc_unknown
        FROM scored GROUP BY icao24, anchor_ts, phase HAVING count(y_east_m) > 0
        """,
        "scored",
    ),
)
def e17_training(spark, sf):
    table = windows.training_table(wins(spark, sf))
    near = F.filter("y", lambda t: t["east_m"].isNotNull())
    first = F.filter("y", lambda t: t["horizon_s"] == 60)[0]["east_m"]
    return table.select(
        "icao24", "anchor_ts", "phase", F.size("steps").alias("n_steps"),
        F.size(near).cast("long").alias("n_targets"), first.alias("east_60_m"),
        F.col("phase_cruise").cast("double").alias("phase_cruise"),
        F.col("wtc_unknown").cast("double").alias("wtc_unknown"),
    )


@query(
    "j7_quantile_model",
    sql(
        f"SELECT horizon_s, phase, axis, {rnd('q10', 'q10')}, {rnd('q50', 'q50')},"
        f" {rnd('q90', 'q90')}, n FROM model",
        "model",
    ),
)
def j7(spark, sf):
    return evaluation.quantile_forecast(forecast(spark, sf).where("fold = 'train'"))


def quantile_forecasts(spark, sf):
    rows = forecast(spark, sf)
    return evaluation.apply_quantiles(rows, evaluation.quantile_model(rows.where("fold = 'train'")))


@query(
    "j6_calibration",
    sql(
        f"""
        SELECT horizon_s, count(*) AS n,
          {rnd("avg((y_east_m BETWEEN q10_east_m AND q90_east_m AND y_north_m BETWEEN q10_north_m AND q90_north_m)::INT)", 'coverage_80')},
          {rnd('avg((y_alt_ft < q10_alt_ft)::INT)', 'below_q10')},
          {rnd('avg((y_alt_ft >= q10_alt_ft AND y_alt_ft < q50_alt_ft)::INT)', 'q10_to_q50')},
          {rnd('avg((y_alt_ft >= q50_alt_ft AND y_alt_ft < q90_alt_ft)::INT)', 'q50_to_q90')},
          {rnd('avg((y_alt_ft >= q90_alt_ft)::INT)', 'above_q90')}, {rnd(f'avg({_CRPS})', 'crps')}
        FROM quantiles WHERE y_east_m IS NOT NULL GROUP BY 1
        """,
        "quantiles",
    ),
)
def j6(spark, sf):
    return evaluation.calibration(quantile_forecasts(spark, sf), pit_axis="alt_ft")


def scored_sql(join: str, flag: str = "BOOLEAN") -> str:
    """Forecasts with their scores; with a left join also those that never met a report."""
    inside = "y_east_m BETWEEN q10_east_m AND q90_east_m AND y_north_m BETWEEN q10_north_m AND q90_north_m"
    return sql(
        f"""
        , truth AS (
          SELECT * FROM (
            SELECT q.icao24, q.i, q.horizon_s, t.ts AS truth_ts,
                   {east('t.lat', 't.lon', 'a.lat', 'a.lon')} AS y_east_m,
                   {north('t.lat', 't.lon', 'a.lat', 'a.lon')} AS y_north_m,
                   row_number() OVER (PARTITION BY q.icao24, q.i, q.horizon_s
                     ORDER BY abs(epoch_ms(t.ts) - epoch_ms(a.ts) - q.horizon_s*1000), t.ts) AS rn
            FROM quantiles q JOIN num a ON a.icao24 = q.icao24 AND a.i = q.i
            JOIN num t ON t.icao24 = q.icao24
             AND abs(epoch_ms(t.ts) - epoch_ms(a.ts) - q.horizon_s*1000) <= 3000)
          WHERE rn = 1)
        SELECT icao24, anchor_ts AS issued_at, horizon_s, phase, truth_ts,
               {rnd('sqrt(pow(q50_east_m - y_east_m, 2) + pow(q50_north_m - y_north_m, 2)) / 1000', 'error_km')},
               {rnd(_CRPS, 'crps')}, ({inside})::{flag} AS in_80
        FROM (SELECT * EXCLUDE (y_east_m, y_north_m) FROM quantiles) q {join} truth USING (icao24, i, horizon_s)
        """,
        "quantiles",
        "num",
    )


def issued_forecasts(spark, sf):
    """Quantile forecasts of every window, with the position they start from."""
    issued = quantile_forecasts(spark, sf).withColumnRenamed("anchor_ts", "issued_at")
    start = fx.reports(spark, sf).select("icao24", F.col("ts").alias("issued_at"),
                                         F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    # both grow with the input: neither is broadcast
    return issued.join(start.hint("merge"), ["icao24", "issued_at"]).select(
        "icao24", "issued_at", "horizon_s", "phase", "lat0", "lon0",
        *[f"{q}_{a}" for q in conflict.QUANTILES for a in ("east_m", "north_m")],
    )


@query("c9_score_predictions", scored_sql("JOIN"))
def c9(spark, sf):
    return evaluation.score_predictions(issued_forecasts(spark, sf), fx.reports(spark, sf))


@query(
    "j11_ranking_metrics",
    sql(
        f"""
        , s AS (SELECT icao24, segment_start, min(coalesce(vert_rate_fpm, 0)) AS low,
                       bool_or(coalesce(NOT on_ground AND vert_rate_fpm <= -4000 AND baro_alt_ft <= 10000, false)
                         OR coalesce(NOT gap AND prev_phase = 'approach' AND phase = 'climb'
                             AND baro_alt_ft <= 3000 AND vert_rate_fpm >= 500, false))::INT AS l
                FROM states15 GROUP BY 1, 2),
        g AS (SELECT -low AS score, count(*) AS n, sum(l) AS p FROM s GROUP BY 1),
        c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM g
              WINDOW w AS (ORDER BY score DESC)),
        t AS (SELECT sum(n) AS nn, sum(p) AS pp FROM g)
        SELECT max(nn)::BIGINT AS n, max(pp)::BIGINT AS n_positive,
               {rnd('sum(p * cp / cn) / max(pp)', 'pr_auc')},
               {rnd('sum(p * greatest(0, least(n, pp - (cn - n))) / n) / max(pp)', 'precision_at_k')}
        FROM c, t
        """,
        "states15",
    ),
)
def j11(spark, sf):
    reports = fx.reports(spark, sf)
    labels = label_segments(reports)
    sink = windows.segments(reports).groupBy("icao24", "segment_start").agg(
        (-F.min(F.coalesce("vert_rate_fpm", F.lit(0.0)))).alias("score")
    )
    scored = labels.join(sink, ["icao24", "segment_start"])
    return evaluation.ranking_metrics(scored, "score", "flagged")


# --- conflicts ---------------------------------------------------------------------------------

_FRESH = f"ts > TIMESTAMP '{AS_OF}' - INTERVAL 120 SECOND AND ts <= TIMESTAMP '{AS_OF}'"
view(
    "snap",
    f"""
    SELECT * FROM (
      SELECT icao24, lat, lon, baro_alt_ft AS alt_ft,
             row_number() OVER (PARTITION BY icao24 ORDER BY ts DESC) AS rn
      FROM fx_reports WHERE {_FRESH} AND lat BETWEEN 39.0 AND 39.4 AND lon BETWEEN -98.0 AND -97.0
        AND baro_alt_ft IS NOT NULL) WHERE rn = 1
    """,
    "fx_reports",
)
view(
    "cand",
    """
    SELECT a.icao24 AS icao24_a, b.icao24 AS icao24_b, a.lat AS lat_a, a.lon AS lon_a,
           a.alt_ft AS alt_ft_a, b.lat AS lat_b, b.lon AS lon_b, b.alt_ft AS alt_ft_b
    FROM snap a JOIN snap b ON a.icao24 < b.icao24 AND abs(a.alt_ft - b.alt_ft) <= 2000
     AND abs(floor(a.lat / 0.3e0) - floor(b.lat / 0.3e0)) <= 1
     AND abs(floor(a.lon / 0.3e0) - floor(b.lon / 0.3e0)) <= 1
    """,
    "snap",
)


@query("c4_candidate_pairs", sql("SELECT icao24_a, icao24_b, alt_ft_a, alt_ft_b FROM cand", "cand"))
def c4(spark, sf):
    snap = conflict.snapshot(fx.reports(spark, sf), BOX, AS_OF)
    return spatial.candidate_pairs(snap).select("icao24_a", "icao24_b", "alt_ft_a", "alt_ft_b")


def _u(parts: str, i: int) -> str:
    """Digits 5i+1..5i+5 of the digest as a fraction."""
    digits = f"substr(md5('20240101|' || {parts}), {1 + 5 * i}, 5)"
    return f"(('0x' || {digits})::BIGINT / 1048576e0)"


def _tri(u: str, a: str, b: str, c: str) -> str:
    lo, hi = f"least({a}, {b}, {c})", f"greatest({a}, {b}, {c})"
    return (
        f"CASE WHEN {hi} - {lo} < 1e-9 THEN {b} WHEN {u}*({hi} - {lo}) < {b} - {lo}"
        f" THEN {lo} + sqrt({u}*({hi} - {lo})*({b} - {lo}))"
        f" ELSE {hi} - sqrt((1 - {u})*({hi} - {lo})*({hi} - {b})) END"
    )


@query(
    "i2_hash_uniform",
    sql(f"SELECT icao24, seq, {rnd(_u('icao24 || chr(124) || seq::VARCHAR', 0), 'u0')}, {rnd(_u('icao24 || chr(124) || seq::VARCHAR', 1), 'u1')} FROM fx_reports", "fx_reports"),
)
def i2(spark, sf):
    u0, u1 = hash_uniforms(conflict.SEED, "icao24", "seq", count=2)
    return fx.reports(spark, sf).select("icao24", "seq", u0.alias("u0"), u1.alias("u1"))


_Q = ("coalesce(vert_rate_fpm, 0)", "lat", "heading_deg")


@query(
    "i1_triangular",
    sql(
        f"SELECT icao24, seq, {rnd(_tri(_u('seq::VARCHAR', 0), *_Q), 'draw')} FROM fx_reports",
        "fx_reports",
    ),
)
def i1(spark, sf):
    (u,) = hash_uniforms(conflict.SEED, "seq")
    q10 = F.coalesce("vert_rate_fpm", F.lit(0.0))
    return fx.reports(spark, sf).select(
        "icao24", "seq", triangular(u, q10, "lat", "heading_deg").alias("draw")
    )


view(
    "known_num",
    f"SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY ts) AS j FROM num WHERE ts <= TIMESTAMP '{AS_OF}'",
    "num",
)
view(
    "k_last12",
    "SELECT icao24, max(i) AS i FROM known_num GROUP BY icao24 HAVING count(*) >= 12",
    "known_num",
)
view("k_phase", VIEWS["last_phase"][1].replace("last12", "k_last12").replace("last_phase", "k_phase"), "k_last12", "num")
view("k_win", VIEWS["last_win"][1].replace("last12", "k_last12").replace("last_phase", "k_phase"), "k_phase")
view("k_steps", steps_sql("k_win"), "k_win", "num")
view("k_cv", VIEWS["cv"][1].replace("FROM steps", "FROM k_steps"), "k_steps")
view("k_quant", widened("k_cv"), "k_cv", "model", "pooled")


def _draw(side: str, axis: str, i: int) -> str:
    parts = " || '|' || ".join(
        ["c.icao24_a", "c.icao24_b", "s.d::VARCHAR", "qa.horizon_s::VARCHAR"]
    )
    return _tri(_u(parts, i + 3 * "ab".index(side)), *[f"q{side}.{q}_{axis}" for q in conflict.QUANTILES])


view(
    "draws",
    f"""
    SELECT c.*, s.d, qa.horizon_s,
           {', '.join(f'{_draw(x, a, i)} AS d_{a}_{x}' for x in 'ab' for i, a in enumerate(conflict.AXES))}
    FROM cand c CROSS JOIN (SELECT unnest(range(1, 201)) AS d) s
    JOIN k_quant qa ON qa.icao24 = c.icao24_a
    JOIN k_quant qb ON qb.icao24 = c.icao24_b AND qb.horizon_s = qa.horizon_s
    """,
    "cand",
    "k_quant",
)
view(
    "prob",
    f"""
    SELECT icao24_a, icao24_b, avg(hit) AS probability FROM (
      SELECT icao24_a, icao24_b, d,
             max((sqrt(pow(d_east_m_a - {east('lat_b', 'lon_b', 'lat_a', 'lon_a')} - d_east_m_b, 2)
                     + pow(d_north_m_a - {north('lat_b', 'lon_b', 'lat_a', 'lon_a')} - d_north_m_b, 2)) < 9260
                  AND abs(alt_ft_a + d_alt_ft_a - alt_ft_b - d_alt_ft_b) < 1000)::INT)::DOUBLE AS hit
      FROM draws GROUP BY 1, 2, 3) GROUP BY 1, 2
    """,
    "draws",
)


def conflict_inputs(spark, sf):
    """Reports and fitted model as stored tables: the composition reads both several times."""
    reports = fx.kept(spark, sf, "reports")
    model = fx.kept(
        spark, sf, "model",
        lambda: evaluation.quantile_model(forecast(spark, sf).where("fold = 'train'")),
    )
    return reports, model


@query(
    "i3_conflict_probability",
    sql(f"SELECT icao24_a, icao24_b, {rnd('probability', 'probability')} FROM prob", "prob"),
)
def i3(spark, sf):
    reports, model = conflict_inputs(spark, sf)
    pairs = spatial.candidate_pairs(conflict.snapshot(reports, BOX, AS_OF))
    known = reports.where(F.col("ts") <= F.lit(AS_OF).cast("timestamp"))
    forecasts = conflict.forecasts_for(known, model, HORIZONS)
    return conflict.conflict_probability(pairs, forecasts, horizons=HORIZONS)


@query(
    "i4_conflicts",
    sql(
        f"SELECT icao24_a, icao24_b, {rnd('probability', 'probability')} FROM prob"
        " WHERE probability >= 0.1",
        "prob",
    ),
)
def i4(spark, sf):
    reports, model = conflict_inputs(spark, sf)
    return conflict.conflicts(reports, BOX, AS_OF, model, horizons=HORIZONS)


def near_sql() -> str:
    """Error of every forecast against the report nearest to its due time, within the tolerance."""
    e = east("t.lat", "t.lon", "a.lat", "a.lon")
    n = north("t.lat", "t.lon", "a.lat", "a.lon")
    error = f"sqrt(pow(pred_east_m - {e}, 2) + pow(pred_north_m - {n}, 2)) / 1000"
    return sql(
        f"""
        SELECT c.icao24, c.anchor_ts AS issued_at, horizon_s, t.ts AS truth_ts,
               {rnd(error, 'error_km')}
        FROM cv c JOIN num a ON a.icao24 = c.icao24 AND a.i = c.i
        JOIN num t ON t.icao24 = c.icao24
         AND abs(epoch_ms(t.ts) - epoch_ms(a.ts) - horizon_s*1000) <= 3000
        QUALIFY row_number() OVER (PARTITION BY c.icao24, c.anchor_ts, horizon_s
          ORDER BY abs(epoch_ms(t.ts) - epoch_ms(a.ts) - horizon_s*1000), t.ts) = 1
        """,
        "cv",
        "num",
    )
