"""B, C6, C7, C10, D2-D12, D14, E18-E21, G7-G9, H, J1-J4, J12: schedule, network and capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.functions.clock import only_arrivals
from aerotrace.operators import capacity, evaluation, network, schedule, serving
from aerotrace.operators.tracks import flight_rows, track_states
from aerotrace.plans import fixtures as fx
from aerotrace.plans.oracle_views import mins, rnd, sql, view
from aerotrace.plans.registry import query

# --- SQL views ---------------------------------------------------------------------------------

_BUCKET = "((flight_date - DATE '1970-01-01') * 96 + {m} // 15)::BIGINT"
view(
    "dep_ops",
    f"""
    SELECT origin AS airport, {_BUCKET.format(m=mins('crs_dep_hhmm'))} AS bucket,
           avg(dep_delay_min) AS mean_dep_delay_min, count(*) AS dep_count,
           sum(cancelled) AS cancellations
    FROM fx_flights GROUP BY 1, 2
    """,
    "fx_flights",
)
view(
    "arr_ops",
    f"""
    SELECT dest AS airport, {_BUCKET.format(m=mins('crs_arr_hhmm'))} AS bucket,
           avg(arr_delay_min) AS mean_arr_delay_min, count(*) AS arr_count
    FROM fx_flights GROUP BY 1, 2
    """,
    "fx_flights",
)
view(
    "airport_set",
    "SELECT origin AS airport FROM fx_flights UNION SELECT dest FROM fx_flights",
    "fx_flights",
)
_T = "to_timestamp(bucket * 900)::TIMESTAMP"
view(
    "grid",
    f"""
    SELECT airport, bucket, coalesce(mean_dep_delay_min, 0) AS mean_dep_delay_min,
           coalesce(mean_arr_delay_min, 0) AS mean_arr_delay_min,
           coalesce(dep_count, 0) + coalesce(arr_count, 0) AS ops_count,
           coalesce(cancellations, 0)::BIGINT AS cancellations,
           CASE WHEN seen THEN hour({_T}) ELSE 0 END::INT AS hour_of_day,
           CASE WHEN seen THEN isodow({_T}) - 1 ELSE 0 END::INT AS day_of_week,
           CASE WHEN seen AND strftime({_T}, '%Y-%m-%d') IN ('2024-01-01', '2024-01-15')
                THEN 1 ELSE 0 END::INT AS is_holiday
    FROM (SELECT airport, unnest(range(lo, hi)) AS bucket
          FROM airport_set,
               (SELECT (min(flight_date) - DATE '1970-01-01')*96 AS lo,
                       (max(flight_date) - DATE '1970-01-01' + 1)*96 AS hi FROM fx_flights))
    LEFT JOIN (SELECT *, true AS seen FROM dep_ops FULL JOIN arr_ops USING (airport, bucket)) o
      USING (airport, bucket)
    """,
    "airport_set",
    "dep_ops",
    "arr_ops",
)
view(
    "flow",
    """
    SELECT src, dst, n, n / sum(n) OVER (PARTITION BY src) AS w FROM (
      SELECT src, dst, count(*) AS n FROM (
        SELECT origin AS src, dest AS dst FROM fx_flights
        UNION ALL SELECT dest, origin FROM fx_flights) GROUP BY 1, 2)
    """,
    "fx_flights",
)
_LEG_ORDER = (
    f"PARTITION BY tail_number ORDER BY flight_date, {mins('crs_dep_hhmm')}, carrier,"
    " flight_number, origin, dest, crs_arr_hhmm"
)
view(
    "rotation",
    f"""
    SELECT src, dst, n, n / sum(n) OVER (PARTITION BY src) AS w FROM (
      SELECT b AS src, c AS dst, count(*) AS n FROM (
        SELECT dest AS b, lead(origin) OVER o AS nb, lead(dest) OVER o AS c
        FROM fx_flights WHERE tail_number IS NOT NULL WINDOW o AS ({_LEG_ORDER}))
      WHERE b = nb GROUP BY 1, 2)
    """,
    "fx_flights",
)
view(
    "long_y",
    """
    SELECT g.airport, g.bucket, h AS horizon, t.mean_arr_delay_min AS y
    FROM grid g CROSS JOIN (VALUES (4), (8), (12), (16), (20), (24)) v(h)
    JOIN grid t ON t.airport = g.airport AND t.bucket = g.bucket + h AND t.ops_count > 0
    """,
    "grid",
)
view(
    "folded",
    """
    SELECT g.*, CASE WHEN bucket - lo < floor(n*0.7e0) THEN 'train'
                     WHEN bucket - lo < floor(n*0.85e0) THEN 'val' ELSE 'test' END AS fold
    FROM grid g, (SELECT min(bucket) AS lo, (max(bucket) - min(bucket) + 1)::DOUBLE AS n FROM grid)
    """,
    "grid",
)
view(
    "hist",
    """
    SELECT l.airport, l.bucket, horizon, y, fold, hour(to_timestamp(l.bucket*900)::TIMESTAMP) AS hh,
           isodow(to_timestamp(l.bucket*900)::TIMESTAMP) AS dd
    FROM long_y l JOIN folded f USING (airport, bucket)
    """,
    "long_y",
    "folded",
)
view(
    "hist_pred",
    """
    SELECT t.airport, t.bucket, t.horizon, t.y,
           coalesce(m.m, (SELECT avg(y) FROM hist WHERE fold = 'train')) AS pred
    FROM (SELECT * FROM hist WHERE fold = 'test') t
    LEFT JOIN (SELECT airport, hh, dd, avg(y) AS m FROM hist WHERE fold = 'train' GROUP BY ALL) m
      USING (airport, hh, dd)
    """,
    "hist",
)
_US = "epoch_us(flight_date::TIMESTAMP)"
view(
    "arrived",
    f"""
    SELECT f.*, CASE WHEN us < lo + span*0.7e0 THEN 'train'
                     WHEN us < lo + span*0.85e0 THEN 'val' ELSE 'test' END AS fold
    FROM (SELECT *, {_US} AS us FROM fx_flights
          WHERE cancelled = 0 AND diverted = 0 AND arr_delay_min IS NOT NULL) f,
         (SELECT min({_US}) AS lo, (max({_US}) - min({_US}))::DOUBLE AS span FROM fx_flights
          WHERE cancelled = 0 AND diverted = 0 AND arr_delay_min IS NOT NULL)
    """,
    "fx_flights",
)
view(
    "eta",
    f"""
    SELECT fold, distance_mi, sched_elapsed_min,
           distance_mi / (sched_elapsed_min / 60) * 0.868976e0 AS sched_block_speed_kt,
           dep_delay_min, (crs_dep_hhmm::INT // 100 % 24)::INT AS hour_of_day, day_of_week, month,
           count(*) OVER (PARTITION BY flight_date, dest, {mins('crs_arr_hhmm')} // 30, fold) - 1
             AS dest_sched_arrivals_30min,
           coalesce(p.m, s.m, (SELECT median(taxi_in_min) FROM arrived WHERE fold = 'train'), 10e0)
             AS historic_taxi_in_p50_min,
           carrier, origin, dest, arr_delay_min
    FROM arrived
    LEFT JOIN (SELECT dest, carrier, median(taxi_in_min) AS m FROM arrived WHERE fold = 'train'
               GROUP BY ALL) p USING (dest, carrier)
    LEFT JOIN (SELECT dest, median(taxi_in_min) AS m FROM arrived WHERE fold = 'train'
               GROUP BY ALL) s USING (dest)
    """,
    "arrived",
)
view(
    "demand",
    f"""
    SELECT origin AS airport, flight_date AS day, {mins('crs_dep_hhmm')} AS scheduled_minute,
           carrier || flight_number || '_' || strftime(flight_date, '%Y-%m-%d') || '_dep' AS flight_id,
           'departure' AS operation
    FROM fx_flights WHERE cancelled <> 1
    UNION ALL
    SELECT dest, flight_date, {mins('crs_arr_hhmm')},
           carrier || flight_number || '_' || strftime(flight_date, '%Y-%m-%d') || '_arr', 'arrival'
    FROM fx_flights WHERE cancelled <> 1
    """,
    "fx_flights",
)
# One flight after the other: each starts when it is due, the runway is free and open.
_START = """
    CASE WHEN greatest(d.scheduled_minute, {busy}) < d.cs + 90 AND greatest(d.scheduled_minute, {busy}) + 1.5e0 > d.cs
         THEN d.cs + 90 ELSE greatest(d.scheduled_minute, {busy}) END"""
view(
    "ordered",
    """
    SELECT d.*, closed_from AS cs,
           row_number() OVER (PARTITION BY airport, day ORDER BY scheduled_minute, flight_id) AS k
    FROM demand d JOIN fx_closures USING (airport)
    """,
    "demand",
    "fx_closures",
)
view(
    "served",
    f"""
    SELECT d.*, greatest(d.scheduled_minute, 0e0) + 1.5e0 AS free1,
           {_START.format(busy='0e0')} + 1.5e0 AS free2
    FROM ordered d WHERE k = 1
    UNION ALL
    SELECT d.*, greatest(d.scheduled_minute, s.free1) + 1.5e0,
           {_START.format(busy='s.free2')} + 1.5e0
    FROM served s JOIN ordered d ON d.airport = s.airport AND d.day = s.day AND d.k = s.k + 1
    """,
    "ordered",
)
view(
    "waits",
    """
    SELECT airport, day, scheduled_minute, flight_id, operation, k AS queue_pos,
           free1 - 1.5e0 - scheduled_minute AS baseline_wait_min,
           free2 - 1.5e0 - scheduled_minute AS scenario_wait_min, free2 - free1 AS added_delay_min
    FROM served
    """,
    "served",
)

# --- graphs and links --------------------------------------------------------------------------


@query(
    "c6_merge_ops",
    sql(
        f"""
        SELECT airport, bucket, {rnd('mean_dep_delay_min', 'mean_dep_delay_min')},
               {rnd('mean_arr_delay_min', 'mean_arr_delay_min')},
               coalesce(dep_count, 0) AS dep_count, coalesce(arr_count, 0) AS arr_count,
               cancellations
        FROM dep_ops FULL JOIN arr_ops USING (airport, bucket)
        """,
        "dep_ops",
        "arr_ops",
    ),
)
def c6(spark, sf):
    flights = fx.kept(spark, sf, "flights")
    return schedule.merge_ops(
        schedule.departure_ops(flights), schedule.arrival_ops(flights)
    ).fillna(0, subset=["dep_count", "arr_count"])


@query(
    "d4_departure_ops",
    sql(
        f"SELECT airport, bucket, {rnd('mean_dep_delay_min', 'mean_dep_delay_min')}, dep_count,"
        " cancellations FROM dep_ops",
        "dep_ops",
    ),
)
def d4(spark, sf):
    return schedule.departure_ops(fx.kept(spark, sf, "flights"))


@query(
    "d5_arrival_ops",
    sql(
        f"SELECT airport, bucket, {rnd('mean_arr_delay_min', 'mean_arr_delay_min')}, arr_count"
        " FROM arr_ops",
        "arr_ops",
    ),
)
def d5(spark, sf):
    return schedule.arrival_ops(fx.kept(spark, sf, "flights"))


_GRID = (
    f"airport, bucket, {rnd('mean_dep_delay_min', 'mean_dep_delay_min')},"
    f" {rnd('mean_arr_delay_min', 'mean_arr_delay_min')}, ops_count, cancellations, hour_of_day,"
    " day_of_week, is_holiday"
)


def dense(spark, sf):
    """The grid as a stored table, for plans that read it several times."""
    return fx.kept(spark, sf, "grid", lambda: network.dense_grid(fx.kept(spark, sf, "flights")))


@query("d6_dense_grid", sql(f"SELECT {_GRID} FROM grid", "grid"))
def d6(spark, sf):
    return network.dense_grid(fx.kept(spark, sf, "flights"))


NODE_OPS_AT = "2024-01-01 15:20:00"
_B = f"trunc((epoch_us({{t}}) - epoch_us(TIMESTAMP '{NODE_OPS_AT}') + 7200000000) / 900000000e0)::INT"
_BT = f"(TIMESTAMP '{NODE_OPS_AT}' - INTERVAL 2 HOUR + to_minutes(b * 15))"


@query(
    "d7_recent_node_ops",
    sql(
        f"""
        SELECT airport, b, 0e0 AS mean_dep_delay_min, 0e0 AS mean_arr_delay_min,
               count(*) AS ops_count, 0::BIGINT AS cancellations, hour({_BT})::INT AS hour_of_day,
               (isodow({_BT}) - 1)::INT AS day_of_week,
               (strftime({_BT}, '%Y-%m-%d') = '2024-01-01')::INT AS is_holiday
        FROM (SELECT origin_icao AS airport, {_B.format(t='actual_dep')} AS b, actual_dep, actual_arr
              FROM fx_legs
              UNION ALL
              SELECT dest_icao, {_B.format(t='actual_arr')}, actual_dep, actual_arr
              FROM fx_legs WHERE actual_arr IS NOT NULL)
        WHERE airport IS NOT NULL AND b BETWEEN 0 AND 7
          AND (actual_dep >= TIMESTAMP '{NODE_OPS_AT}' - INTERVAL 2 HOUR
               OR actual_arr >= TIMESTAMP '{NODE_OPS_AT}' - INTERVAL 2 HOUR)
        GROUP BY airport, b
        """,
        "fx_legs",
    ),
)
def d7(spark, sf):
    legs = flight_rows(track_states(fx.reports(spark, sf)), fx.airports(spark, sf))
    return network.recent_node_ops(legs, NODE_OPS_AT)


_EDGE = "src, dst, n::BIGINT AS n, round(w, 6) + 0.0 AS w"


@query("d8_flow_edges", sql(f"SELECT {_EDGE} FROM flow", "flow"))
def d8(spark, sf):
    return schedule.flow_edges(fx.kept(spark, sf, "flights"))


@query("d9_rotation_edges", sql(f"SELECT {_EDGE} FROM rotation", "rotation"))
def d9(spark, sf):
    return schedule.rotation_edges(fx.kept(spark, sf, "flights"))


_KEY = "carrier || flight_number || '_' || strftime(flight_date, '%Y-%m-%d')"


@query(
    "c10_rotation_link",
    sql(
        f"""
        SELECT tail_number, {_KEY} AS flight_id, lag({_KEY}) OVER ({_LEG_ORDER}) AS prev_leg_flight_id
        FROM fx_flights WHERE tail_number IS NOT NULL
        """,
        "fx_flights",
    ),
)
def c10(spark, sf):
    return schedule.rotation_link(fx.kept(spark, sf, "flights")).select(
        "tail_number", "flight_id", "prev_leg_flight_id"
    )


@query(
    "d2_dest_congestion",
    sql(
        f"""
        SELECT flight_date, dest, carrier, flight_number, crs_arr_hhmm,
               count(*) OVER (PARTITION BY flight_date, dest, {mins('crs_arr_hhmm')} // 30) - 1
                 AS dest_sched_arrivals_30min
        FROM fx_flights
        """,
        "fx_flights",
    ),
)
def d2(spark, sf):
    rows = fx.kept(spark, sf, "flights").select(
        "flight_date", "dest", "carrier", "flight_number", "crs_arr_hhmm"
    )
    return schedule.dest_congestion(rows)


@query(
    "d3_taxi_in_medians",
    sql(
        """
        SELECT dest, carrier, median(taxi_in_min) AS p50 FROM arrived WHERE fold = 'train' GROUP BY ALL
        UNION ALL BY NAME
        SELECT dest, '*' AS carrier, median(taxi_in_min) AS p50 FROM arrived WHERE fold = 'train' GROUP BY ALL
        UNION ALL BY NAME
        SELECT '*' AS dest, '*' AS carrier, median(taxi_in_min) AS p50 FROM arrived WHERE fold = 'train'
        """,
        "arrived",
    ),
)
def d3(spark, sf):
    m = schedule.taxi_in_medians(folds(spark, sf).where("fold = 'train'"))
    star = F.lit("*")
    return (
        m["pair"].select("dest", "carrier", F.col("pair_p50").alias("p50"))
        .unionByName(m["single"].select("dest", star.alias("carrier"), F.col("single_p50").alias("p50")))
        .unionByName(m["overall"].select(star.alias("dest"), star.alias("carrier"), F.col("overall_p50").alias("p50")))
    )


def folds(spark, sf):
    return evaluation.chronological_split(only_arrivals(fx.kept(spark, sf, "flights")), "flight_date")


@query(
    "e20_chronological_split",
    sql(
        "SELECT fold, flight_date, count(*) AS n FROM arrived GROUP BY ALL",
        "arrived",
    ),
)
def e20(spark, sf):
    return folds(spark, sf).groupBy("fold", "flight_date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e20_bucket_split",
    sql("SELECT fold, bucket, count(*) AS n FROM folded GROUP BY ALL", "folded"),
)
def e20b(spark, sf):
    grid = evaluation.bucket_split(network.dense_grid(fx.kept(spark, sf, "flights")))
    return grid.groupBy("fold", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c7_lookup_fallback",
    sql(
        """
        SELECT dest, carrier, coalesce(p.m, s.m, (SELECT median(taxi_in_min) FROM arrived WHERE fold = 'train')) AS p50,
               count(*) AS n
        FROM (SELECT dest, CASE WHEN flight_number::INT % 10 = 0 THEN 'ZZ' ELSE carrier END AS carrier
              FROM fx_flights
              UNION ALL SELECT 'K999', carrier FROM fx_flights) f
        LEFT JOIN (SELECT dest, carrier, median(taxi_in_min) AS m FROM arrived WHERE fold = 'train'
                   GROUP BY ALL) p USING (dest, carrier)
        LEFT JOIN (SELECT dest, median(taxi_in_min) AS m FROM arrived WHERE fold = 'train'
                   GROUP BY ALL) s USING (dest)
        GROUP BY ALL
        """,
        "arrived",
    ),
)
def c7(spark, sf):
    medians = schedule.taxi_in_medians(folds(spark, sf).where("fold = 'train'"))
    flights = fx.kept(spark, sf, "flights")
    strange = F.col("flight_number").cast("int") % 10 == 0
    asked = flights.select(
        "dest", F.when(strange, "ZZ").otherwise(F.col("carrier")).alias("carrier")
    ).unionByName(flights.select(F.lit("K999").alias("dest"), "carrier"))
    return (
        schedule.lookup_fallback(asked, medians, "p50")
        .groupBy("dest", "carrier", "p50")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "j1_eta_features",
    sql(
        f"""
        SELECT fold, distance_mi, sched_elapsed_min, {rnd('sched_block_speed_kt', 'sched_block_speed_kt')},
               dep_delay_min, hour_of_day, day_of_week, month, dest_sched_arrivals_30min,
               historic_taxi_in_p50_min, carrier, origin, dest,
               {rnd('arr_delay_min', 'arr_delay_min')}
        FROM eta
        """,
        "eta",
    ),
)
def j1(spark, sf):
    return eta_tables(spark, sf)


def eta_tables(spark, sf):
    """Feature tables of the three folds (each counts its own congestion), stacked."""
    split = folds(spark, sf)
    medians = schedule.taxi_in_medians(split.where("fold = 'train'"))
    parts = [
        schedule.eta_features(split.where(F.col("fold") == f), medians, keep=("fold",))
        for f in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DURATION = """
    CASE WHEN sched_elapsed_min < 15 THEN '<15min' WHEN sched_elapsed_min < 45 THEN '15-45min'
         WHEN sched_elapsed_min < 120 THEN '45-120min' ELSE '>120min' END
"""


@query(
    "j2_j3_eta_metrics",
    sql(
        f"""
        SELECT model, bucket, {rnd('avg(err)', 'mae_min')}, {rnd('quantile_cont(err, 0.9)', 'p90_min')},
               count(*) AS n
        FROM (SELECT model, unnest(['overall', {_DURATION}]) AS bucket, err
              FROM (SELECT sched_elapsed_min, unnest(['zero', 'carry']) AS model,
                           unnest([arr_delay_min, abs(arr_delay_min - dep_delay_min)]) AS err
                    FROM arrived WHERE fold = 'test'))
        GROUP BY ALL
        """,
        "arrived",
    ),
)
def j3(spark, sf):
    test = evaluation.eta_baselines(folds(spark, sf).where("fold = 'test'"))
    out = [
        evaluation.eta_metrics(test, "arr_delay_min", f"pred_{m}", "sched_elapsed_min").withColumn(
            "model", F.lit(m)
        )
        for m in ("zero", "carry")
    ]
    return out[0].unionByName(out[1])


@query(
    "d14_month_facts",
    sql(
        f"""
        SELECT min(flight_date) AS month_start, max(flight_date) + 1 AS month_end,
               (SELECT count(*) FROM airport_set) AS n_airports,
               count(DISTINCT {_KEY}) AS n_flight_ids
        FROM fx_flights
        """,
        "fx_flights",
        "airport_set",
    ),
)
def d14(spark, sf):
    return schedule.month_facts(fx.kept(spark, sf, "flights"))


# --- network features ---------------------------------------------------------------------------


@query(
    "e18_future_targets",
    sql(
        "SELECT g.airport, g.bucket, "
        + ", ".join(
            rnd(f"max(CASE WHEN horizon = {h} THEN y END)", f"y_{h}") for h in network.HORIZONS
        )
        + " FROM grid g LEFT JOIN long_y l USING (airport, bucket) GROUP BY 1, 2",
        "grid",
        "long_y",
    ),
)
def e18(spark, sf):
    grid = network.dense_grid(fx.kept(spark, sf, "flights"))
    return network.future_targets(grid).select(
        "airport", "bucket", *[f"y_{h}" for h in network.HORIZONS]
    )


@query(
    "e19_trailing",
    sql(
        f"""
        SELECT airport, bucket, n, first_ops, {rnd('delays', 'delays')} FROM (
          SELECT airport, bucket, count(*) OVER w AS n, first_value(ops_count) OVER w AS first_ops,
                 sum(mean_arr_delay_min) OVER w AS delays
          FROM grid WINDOW w AS (PARTITION BY airport ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
        WHERE n = 8
        """,
        "grid",
    ),
)
def e19(spark, sf):
    seq = network.trailing(network.dense_grid(fx.kept(spark, sf, "flights")))
    return seq.select(
        "airport",
        "bucket",
        F.size("seq").cast("long").alias("n"),
        F.col("seq")[0]["ops_count"].alias("first_ops"),
        F.aggregate("seq", F.lit(0.0), lambda a, x: a + x["mean_arr_delay_min"]).alias("delays"),
    )


def folded_targets(spark, sf):
    """Long target table with its fold."""
    grid = evaluation.bucket_split(dense(spark, sf))
    return network.long_targets(grid, keep=("fold",))


def historical(spark, sf):
    long = folded_targets(spark, sf)
    return network.historical_mean(long.where("fold = 'train'"), long.where("fold = 'test'"))


@query(
    "d10_historical_mean",
    sql(
        f"SELECT airport, bucket, horizon, {rnd('y', 'y')}, {rnd('pred', 'pred')} FROM hist_pred",
        "hist_pred",
    ),
)
def d10(spark, sf):
    return historical(spark, sf).drop("fold")


@query(
    "j4_horizon_mae_rmse",
    sql(
        f"""
        SELECT horizon, {rnd('avg(abs(pred - y))', 'mae_min')},
               {rnd('sqrt(avg((pred - y)*(pred - y)))', 'rmse_min')}, count(*) AS n
        FROM hist_pred GROUP BY horizon
        """,
        "hist_pred",
    ),
)
def j4(spark, sf):
    return evaluation.horizon_mae_rmse(historical(spark, sf))


@query(
    "d11_neighbor_delay",
    sql(
        f"""
        SELECT g.airport, g.bucket, {rnd('coalesce(sum(w * x.mean_arr_delay_min), 0)', 'neighbor_delay')}
        FROM grid g LEFT JOIN flow ON src = g.airport
        LEFT JOIN grid x ON x.airport = dst AND x.bucket = g.bucket GROUP BY 1, 2
        """,
        "grid",
        "flow",
    ),
)
def d11(spark, sf):
    flights = fx.kept(spark, sf, "flights")
    return network.neighbor_delay(dense(spark, sf), schedule.flow_edges(flights)).select(
        "airport", "bucket", "neighbor_delay"
    )


def _hop(src: str, edges: str) -> str:
    cols = ", ".join(f"sum(w * x.{c}) AS {c}" for c in network.NODE_FEATURES)
    return (
        f"SELECT src AS airport, x.bucket, {cols} FROM {edges} JOIN {src} x ON x.airport = dst"
        " GROUP BY 1, 2"
    )


for _name, _edges in (("flow", "flow"), ("rot", "rotation")):
    view(f"{_name}_1", _hop("grid", _edges), "grid", _edges)
    view(f"{_name}_2", _hop(f"{_name}_1", _edges), f"{_name}_1", _edges)


@query(
    "d12_diffuse",
    sql(
        "SELECT g.airport, g.bucket, "
        + ", ".join(
            rnd(f"coalesce({v}.{c}, 0)", f"{n}_{h}_{c}")
            for n, s in (("flow", "flow"), ("rotation", "rot"))
            for h in (1, 2)
            for v in [f"{s}_{h}"]
            for c in network.NODE_FEATURES
        )
        + " FROM grid g "
        + " ".join(
            f"LEFT JOIN {v} ON {v}.airport = g.airport AND {v}.bucket = g.bucket"
            for v in ("flow_1", "flow_2", "rot_1", "rot_2")
        ),
        "flow_2",
        "rot_2",
    ),
)
def d12(spark, sf):
    flights = fx.kept(spark, sf, "flights")
    graphs = {"flow": schedule.flow_edges(flights), "rotation": schedule.rotation_edges(flights)}
    return network.diffuse(dense(spark, sf), graphs).drop(*network.NODE_FEATURES)


@query(
    "g8_top_neighbors",
    sql(
        """
        SELECT src, dst, n::BIGINT AS n, round(w, 6) + 0.0 AS w, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank
          FROM flow WHERE src <> dst) WHERE rank <= 5
        """,
        "flow",
    ),
)
def g8(spark, sf):
    return serving.top_neighbors(schedule.flow_edges(fx.kept(spark, sf, "flights")))


RIPPLE_DAY = (19724 + 4) * 96  # fourth day after 2024-01-02


@query(
    "j12_ripple",
    sql(
        f"""
        , shut AS (SELECT airport AS a, {RIPPLE_DAY} + floor(closed_from / 15)::BIGINT AS b FROM fx_closures),
        m AS (SELECT airport, bucket, unnest({list(network.RIPPLE_MEASURES)}) AS measure,
                     unnest([{", ".join(f"{c}::DOUBLE" for c in network.RIPPLE_MEASURES)}]) AS v FROM grid),
        e AS (SELECT 'flow' AS graph, src, dst, w FROM flow
              UNION ALL SELECT 'rotation', src, dst, w FROM rotation),
        cut AS (SELECT a, b, measure, sum(v) / 8 AS x FROM shut
                JOIN m ON m.airport = a AND m.bucket BETWEEN b - 6 AND b - 1 GROUP BY ALL),
        one AS (SELECT graph, a, b, measure, src AS airport, -w*x AS delta FROM cut JOIN e ON dst = a),
        two AS (SELECT one.graph, a, b, measure, src AS airport, sum(w*delta) AS delta
                FROM one JOIN e ON e.dst = airport AND e.graph = one.graph GROUP BY ALL),
        top AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank
                FROM flow WHERE src <> dst),
        asked AS (SELECT a, b, dst AS airport, rank, unnest([1, 2]) AS hop, graph, measure
                  FROM shut JOIN top ON src = a CROSS JOIN (VALUES ('flow'), ('rotation')) g(graph)
                  CROSS JOIN (SELECT unnest({list(network.RIPPLE_MEASURES)}) AS measure) WHERE rank <= 5)
        SELECT a AS closed_airport, b AS closed_bucket, airport AS neighbor, rank, graph, measure, hop,
               {rnd('coalesce(delta, 0)', 'delta')}
        FROM asked
        LEFT JOIN (SELECT *, 1 AS hop FROM one UNION ALL BY NAME SELECT *, 2 AS hop FROM two)
          USING (a, b, airport, graph, measure, hop)
        """,
        "grid",
        "flow",
        "rotation",
        "fx_closures",
    ),
)
def j12(spark, sf):
    flights = fx.kept(spark, sf, "flights")
    graphs = {"flow": schedule.flow_edges(flights), "rotation": schedule.rotation_edges(flights)}
    shut = fx.closures(spark, sf).withColumn(
        "bucket", F.lit(RIPPLE_DAY) + F.floor(F.col("closed_from") / 15)
    )
    return network.ripple(dense(spark, sf), graphs, shut, serving.top_neighbors(graphs["flow"]))


# --- model registry -----------------------------------------------------------------------------


@query(
    "e21_promotion_gate",
    sql(
        """
        SELECT kind, version, trained_at, metric, champion_metric,
               champion_metric IS NULL OR metric < champion_metric AS promoted
        FROM (SELECT *, min(metric) OVER (PARTITION BY kind ORDER BY trained_at, version
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion_metric
              FROM fx_runs)
        """,
        "fx_runs",
    ),
)
def e21(spark, sf):
    return evaluation.promotion_gate(fx.model_runs(spark, sf))


@query(
    "g9_scorecard",
    sql(
        """
        SELECT kind, version, trained_at, metric FROM (
          SELECT *, row_number() OVER (PARTITION BY kind ORDER BY metric, trained_at, version) AS rn
          FROM fx_runs) WHERE rn = 1
        """,
        "fx_runs",
    ),
)
def g9(spark, sf):
    return evaluation.scorecard(fx.model_runs(spark, sf))


# --- capacity -----------------------------------------------------------------------------------


def waits(spark, sf):
    return capacity.queue_waits(
        capacity.runway_demand(fx.kept(spark, sf, "flights")), fx.closures(spark, sf)
    )


@query("h1_runway_demand", sql("SELECT * FROM demand", "demand"))
def h1(spark, sf):
    return capacity.runway_demand(fx.kept(spark, sf, "flights"))


_WAIT = "airport, day, scheduled_minute, flight_id, operation, queue_pos, baseline_wait_min"


@query("h2_queue_wait", sql(f"SELECT {_WAIT} FROM waits", "waits"))
def h2(spark, sf):
    return capacity.queue_wait(capacity.runway_demand(fx.kept(spark, sf, "flights")))


@query(
    "h3_queue_wait_closed",
    sql(f"SELECT {_WAIT}, scenario_wait_min, added_delay_min FROM waits", "waits"),
)
def h3(spark, sf):
    return waits(spark, sf)


@query(
    "h4_closure_report",
    sql(
        f"""
        SELECT airport, day, sum(added_delay_min) AS total_added_delay_min,
               count(*) FILTER (added_delay_min > 1e-9) AS affected_flight_count,
               max(added_delay_min) AS max_added_delay_min, count(*) AS flights_simulated,
               {rnd('avg(baseline_wait_min)', 'baseline_mean_wait_min')},
               max(baseline_wait_min) AS baseline_max_wait_min,
               avg(baseline_wait_min) > 30 AS already_saturated
        FROM waits GROUP BY 1, 2
        """,
        "waits",
    ),
)
def h4(spark, sf):
    return capacity.closure_report(waits(spark, sf))


@query(
    "g7_top_delayed",
    sql(
        f"""
        SELECT {_WAIT}, scenario_wait_min, added_delay_min FROM waits
        ORDER BY added_delay_min DESC, airport, day, scheduled_minute, flight_id, queue_pos LIMIT 20
        """,
        "waits",
    ),
)
def g7(spark, sf):
    return serving.top_delayed(waits(spark, sf))


