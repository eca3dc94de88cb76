"""A: scans, sources, sinks, dedupe. B: scalar geodesy and clock columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.functions import clock, geo
from aerotrace.operators import ingest
from aerotrace.operators.spatial import with_cell
from aerotrace.plans import fixtures as fx
from aerotrace.plans.oracle_views import bearing, east, hav, mins, north, rnd, sql, turn
from aerotrace.plans.registry import query
from aerotrace.session import scratch_dir
from aerotrace.sources import archive, readers

AS_OF = "2024-01-01 20:05:00"
BBOX = (39.0, 39.4, -98.0, -97.0)
REPORT_COLS = (
    "icao24, ts, lat, lon, baro_alt_ft, velocity_kt, heading_deg, vert_rate_fpm, on_ground, "
    "squawk, seq"
)


def report_rounded(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return (
        f"{p}icao24, {p}ts, {rnd(f'{p}lat', 'lat')}, {rnd(f'{p}lon', 'lon')}, "
        f"{p}baro_alt_ft, {p}velocity_kt, {p}heading_deg, {p}vert_rate_fpm, {p}on_ground"
    )


@query(
    "a1_normalize_reports",
    sql(
        """
        SELECT seq, icao24, ts - to_seconds(seq % 4) AS ts, round(lat, 6) + 0.0 AS lat,
               round(lon, 6) + 0.0 AS lon,
               CASE WHEN NOT on_ground THEN baro_alt_ft END AS baro_alt_ft,
               velocity_kt, heading_deg, vert_rate_fpm, on_ground, squawk, 'adsb_lol' AS source
        FROM fx_reports WHERE seq % 50 <> 0 AND seq % 61 <> 0
        """,
        "fx_reports",
    ),
)
def a1(spark, sf):
    return ingest.normalize_reports(fx.raw_json(spark, sf)).drop("received_at", "geo_alt_ft")


@query(
    "a2_rejected_reports",
    sql(
        """
        SELECT seq, ts AS received_at,
               CASE WHEN seq % 61 = 0 THEN 'no_position' ELSE 'not_icao' END AS reason
        FROM fx_reports WHERE seq % 50 = 0 OR seq % 61 = 0
        """,
        "fx_reports",
    ),
)
def a2(spark, sf):
    return ingest.split_valid(ingest.parse_reports(fx.raw_json(spark, sf)))[1].drop(
        "rejected_value"
    )


def snapshot_files(spark, sf) -> str:
    """Historical snapshots written from the reports: one JSON object per instant and id digit."""
    path = scratch_dir(spark, "snapshots")
    aircraft = F.struct(
        F.when(F.col("seq") % 50 == 0, F.concat(F.lit("~"), "icao24")).otherwise(F.col("icao24")).alias("hex"),
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" F"), "icao24", F.lit("  "))).otherwise(" ").alias("flight"),
        F.when(F.col("on_ground"), "ground")
        .otherwise(F.col("baro_alt_ft").cast("int").cast("string"))
        .alias("alt_baro"),
        F.col("velocity_kt").alias("gs"),
        F.col("heading_deg").alias("track"),
        F.when(F.col("seq") % 4 != 0, F.col("vert_rate_fpm")).alias("baro_rate"),
        F.lit(64.0).alias("geom_rate"),
        F.when(F.col("seq") % 61 != 0, F.col("lat")).alias("lat"),
        F.col("lon"),
    )
    fx.reports(spark, sf).groupBy("ts", F.substring("icao24", 6, 1).alias("part")).agg(
        F.collect_list(aircraft).alias("aircraft")
    ).select(F.unix_timestamp("ts").cast("double").alias("now"), "aircraft").write.json(path)
    return path


@query(
    "a3_read_snapshots",
    sql(
        """
        SELECT icao24, ts, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon,
               CASE WHEN NOT on_ground THEN baro_alt_ft END AS baro_alt_ft, velocity_kt,
               heading_deg,
               CASE WHEN seq % 4 = 0 THEN 64e0 ELSE coalesce(vert_rate_fpm, 64e0) END AS vert_rate_fpm,
               on_ground, CASE WHEN seq % 3 = 0 THEN 'F' || icao24 END AS callsign
        FROM fx_reports WHERE seq % 50 <> 0 AND seq % 61 <> 0
          AND lat BETWEEN 39.0 AND 39.4 AND lon BETWEEN -98.0 AND -97.0
        """,
        "fx_reports",
    ),
)
def a3(spark, sf):
    return readers.read_snapshots(spark, snapshot_files(spark, sf), BBOX).drop(
        "registration", "type_code"
    )


def ontime_files(spark, sf) -> list[str]:
    """Two on-time files with the source's column names and some columns nobody reads."""
    from aerotrace.schemas import ONTIME_COLUMNS

    path = scratch_dir(spark, "ontime")
    flights = fx.flights(spark, sf)
    named = [
        (F.col(dst) if dst in flights.columns else F.lit(None)).cast("string").alias(src)
        for src, dst, _ in ONTIME_COLUMNS
    ]
    table = flights.select(F.lit("x").alias("Unused1"), *named, F.lit("y").alias("Unused2"))
    early = F.col("FlightDate") < "2024-01-16"
    table.where(early).write.option("header", True).csv(f"{path}/a")
    table.where(~early).write.option("header", True).csv(f"{path}/b")
    return [f"{path}/a", f"{path}/b"]


ONTIME_SQL = """
    SELECT flight_date, carrier, tail_number, flight_number, origin, dest, crs_dep_hhmm,
           crs_arr_hhmm, dep_delay_min, round(arr_delay_min, 6) + 0.0 AS arr_delay_min,
           cancelled, diverted, sched_elapsed_min, taxi_in_min, distance_mi, day_of_week,
           year, month
    FROM fx_flights {where}
"""
ONTIME_DROP = ("dep_hhmm", "arr_hhmm", "actual_elapsed_min", "air_time_min", "taxi_out_min")


@query("a4_read_ontime", sql(ONTIME_SQL.format(where=""), "fx_flights"))
def a4(spark, sf):
    months = ontime_files(spark, sf)
    first = readers.read_ontime(spark, months[0])
    return first.unionByName(readers.read_ontime(spark, months[1])).drop(*ONTIME_DROP)


@query("a5_read_ontime_months", sql(ONTIME_SQL.format(where=""), "fx_flights"))
def a5(spark, sf):
    return readers.read_ontime(spark, ontime_files(spark, sf)).drop(*ONTIME_DROP)


def airports_csv(spark, sf) -> str:
    """An airport list with the code spread over three columns, small fields and foreign ones."""
    path = scratch_dir(spark, "airports")
    k = F.substring("icao", 2, 3).cast("int")
    fx.airports(spark, sf).select(
        F.when(k % 3 == 0, F.col("icao")).otherwise("").alias("icao_code"),
        F.when(k % 3 == 1, F.lower("icao")).otherwise("").alias("gps_code"),
        F.when(k % 3 == 2, F.col("icao")).otherwise("US-0001").alias("ident"),
        F.when(k % 7 == 6, "small_airport").when(k % 2 == 0, "large_airport")
        .otherwise("medium_airport").alias("type"),
        F.col("name"),
        F.when(k == 5, "?").otherwise(F.col("lat").cast("string")).alias("latitude_deg"),
        F.col("lon").cast("string").alias("longitude_deg"),
        F.when(k % 5 == 4, "").otherwise("900").alias("elevation_ft"),
        F.when(k == 8, "CA").otherwise("US").alias("iso_country"),
        F.lit("").alias("iata_code"),
        F.when(k % 2 == 0, "Town").otherwise("").alias("municipality"),
    ).write.option("header", True).csv(path)
    return path


SEEDED_SQL = """
    SELECT icao, name, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon,
           CASE WHEN k % 5 <> 4 THEN 900e0 END AS elevation_ft,
           CASE WHEN k % 2 = 0 THEN 'Town' END AS city
    FROM (SELECT *, substr(icao, 2, 3)::INT AS k FROM fx_airports)
    WHERE k % 7 <> 6 AND k NOT IN (5, 8)
"""


@query("a6_load_airports", sql(SEEDED_SQL, "fx_airports"))
def a6(spark, sf):
    rows = readers.load_airports(readers.read_csv(spark, airports_csv(spark, sf)))
    return rows.drop("iata", "country")


def runways_csv(spark, sf) -> str:
    path = scratch_dir(spark, "runways")
    k = F.substring("icao", 2, 3).cast("int")
    fx.airports(spark, sf).select(
        F.concat(F.lit(" "), F.lower("icao")).alias("airport_ident"),
        (F.lit(6000) + k * 100).cast("string").alias("length_ft"),
        F.lit("09").alias("le_ident"),
        F.when(k % 4 == 0, "").otherwise("27").alias("he_ident"),
        F.lit("90.0").alias("le_heading_degT"),
        F.lit("bad").alias("he_heading_degT"),
        *[F.lit("").alias(f"{e}_{c}_deg") for e in ("le", "he") for c in ("latitude", "longitude")],
    ).write.option("header", True).csv(path)
    return path


@query(
    "a7_load_runways",
    sql(
        f"""
        SELECT icao AS airport_icao, ident,
               CASE WHEN ident = '09' THEN 90e0 END AS true_heading_deg,
               6000e0 + 100*k AS length_ft
        FROM (SELECT *, substr(icao, 2, 3)::INT AS k FROM ({SEEDED_SQL}))
        CROSS JOIN (VALUES ('09'), ('27')) e(ident)
        WHERE ident = '09' OR k % 4 <> 0
        """,
        "fx_airports",
    ),
)
def a7(spark, sf):
    ports = readers.load_airports(readers.read_csv(spark, airports_csv(spark, sf)))
    return readers.load_runways(readers.read_csv(spark, runways_csv(spark, sf)), ports).drop(
        "lat", "lon"
    )


@query(
    "a9_archive",
    sql(
        """
        SELECT strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hour, icao24, ts,
               round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, baro_alt_ft,
               NULL::DOUBLE AS geo_alt_ft, velocity_kt, heading_deg, vert_rate_fpm, on_ground,
               squawk, floor(lat / 0.3e0)::INT || ':' || floor(lon / 0.3e0)::INT AS cell, source
        FROM fx_reports
        """,
        "fx_reports",
    ),
)
def a9(spark, sf):
    path = scratch_dir(spark, "archive")
    archive.write_archive(with_cell(fx.reports(spark, sf)), path)
    return archive.read_archive(spark, path)


@query(
    "a10_upsert",
    sql(
        f"""
        SELECT {REPORT_COLS.replace('lat, lon', 'round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon')}
        FROM (SELECT *, row_number() OVER (PARTITION BY icao24, ts ORDER BY seq DESC) AS rn FROM fx_dup)
        WHERE rn = 1
        """,
        "fx_dup",
    ),
)
def a10(spark, sf):
    return ingest.upsert(fx.reports(spark, sf), fx.redelivered(spark, sf)).drop("source")


@query(
    "a11_replace_keys",
    sql(
        """
        SELECT 'K' || lpad(n_nationkey::VARCHAR, 3, '0') AS airport_icao, ident,
               CASE WHEN n_nationkey % 3 = 0 THEN 0e0 ELSE ident::INT * 10e0 END AS true_heading_deg,
               6000e0 + 100*n_nationkey AS length_ft
        FROM nation CROSS JOIN (VALUES ('09'), ('27')) e(ident)
        """,
    ),
)
def a11(spark, sf):
    old = fx.runways(spark, sf)
    new = old.where(F.substring("airport_icao", 2, 3).cast("int") % 3 == 0).withColumn(
        "true_heading_deg", F.lit(0.0)
    )
    return ingest.replace_keys(old, new, "airport_icao")


@query(
    "a12_retain",
    sql(
        f"""
        SELECT icao24, ts, seq, tier FROM fx_reports
        CROSS JOIN (VALUES ('raw', 6), ('15s', 720), ('60s', 8760)) t(tier, h)
        WHERE ts >= TIMESTAMP '{AS_OF}' - to_hours(h)
        """,
        "fx_reports",
    ),
)
def a12(spark, sf):
    rows = fx.reports(spark, sf).select("icao24", "ts", "seq")
    kept = [
        ingest.retain(rows, AS_OF, tier).withColumn("tier", F.lit(tier))
        for tier in ingest.RETENTION_H
    ]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


# --- B: every report against the airport of its aircraft (id modulo 25) -----------------------

LEG_LAT, LEG_LON = "39.16e0", "-97.84e0"


@query(
    "b1_b2_distance_bearing",
    sql(
        f"""
        SELECT icao24, ts, {rnd(hav('lat', 'lon', LEG_LAT, LEG_LON), 'dist_m')},
               {rnd(bearing('lat', 'lon', LEG_LAT, LEG_LON), 'bearing')}
        FROM fx_reports
        """,
        "fx_reports",
    ),
)
def b1(spark, sf):
    return fx.reports(spark, sf).select(
        "icao24",
        "ts",
        geo.haversine_m("lat", "lon", 39.16, -97.84).alias("dist_m"),
        geo.bearing_deg("lat", "lon", 39.16, -97.84).alias("bearing"),
    )


_D = "(velocity_kt*100/6371008.8e0)"
_LAT2 = (
    f"asin(sin(radians(lat))*cos({_D}) + cos(radians(lat))*sin({_D})*cos(radians(heading_deg)))"
)


@query(
    "b3_destination_point",
    sql(
        f"""
        SELECT icao24, ts, {rnd(f'degrees({_LAT2})', 'lat2')},
               {rnd(f"fmod(179e0 + lon + degrees(atan2(sin(radians(heading_deg))*sin({_D})*cos(radians(lat)), cos({_D}) - sin(radians(lat))*sin({_LAT2}))) + 540.0, 360.0) - 180.0", 'lon2')}
        FROM fx_reports
        """,
        "fx_reports",
    ),
)
def b3(spark, sf):
    shifted = F.col("lon") + F.lit(179.0)
    args = ("lat", shifted, "heading_deg", F.col("velocity_kt") * 100)
    return fx.reports(spark, sf).select(
        "icao24",
        "ts",
        geo.destination_lat(*args).alias("lat2"),
        geo.destination_lon(*args).alias("lon2"),
    )


@query(
    "b4_enu_round_trip",
    sql(
        f"""
        SELECT icao24, ts, {rnd(east('lat', 'lon', LEG_LAT, LEG_LON), 'east_m')},
               {rnd(north('lat', 'lon', LEG_LAT, LEG_LON), 'north_m')},
               {rnd('lat', 'lat2')}, {rnd('lon', 'lon2')}
        FROM fx_reports
        """,
        "fx_reports",
    ),
)
def b4(spark, sf):
    frame = fx.reports(spark, sf).select(
        "icao24",
        "ts",
        geo.enu_east("lat", "lon", 39.16, -97.84).alias("east_m"),
        geo.enu_north("lat", "lon", 39.16, -97.84).alias("north_m"),
    )
    return frame.withColumn("lat2", geo.from_enu_lat("east_m", "north_m", 39.16, -97.84)).withColumn(
        "lon2", geo.from_enu_lon("east_m", "north_m", 39.16, -97.84)
    )


@query(
    "b5_in_bbox",
    sql(
        """
        SELECT lat BETWEEN 39.0 AND 39.4 AND lon BETWEEN -98.0 AND -97.0 AS inside, count(*) AS n
        FROM fx_reports GROUP BY 1
        """,
        "fx_reports",
    ),
)
def b5(spark, sf):
    inside = geo.in_bbox("lat", "lon", BBOX).alias("inside")
    return fx.reports(spark, sf).groupBy(inside).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b6_cell_ring_counts",
    sql(
        """
        SELECT r + dr AS cell_row, (c + dc + 1200) % 1200 AS cell_col, count(*) AS n
        FROM (SELECT floor(lat / 0.3e0)::INT AS r, floor(lon / 0.3e0)::INT AS c FROM fx_reports)
        CROSS JOIN (VALUES (-1), (0), (1)) a(dr) CROSS JOIN (VALUES (-1), (0), (1)) b(dc)
        GROUP BY 1, 2
        """,
        "fx_reports",
    ),
)
def b6(spark, sf):
    # Counting per cell first keeps the ring fan-out small.
    cells = fx.reports(spark, sf).groupBy(
        geo.cell_index("lat", 0.3).alias("r"), geo.cell_column("lon", 0.3).alias("c")
    ).agg(F.count(F.lit(1)).alias("m"))
    ring = geo.explode_ring(cells, 1, "r", "c", ("cell_row", "cell_col"), 0.3)
    return ring.groupBy("cell_row", "cell_col").agg(F.sum("m").alias("n"))


@query(
    "b7_bearing_delta",
    sql(
        f"SELECT icao24, ts, {turn('350e0', 'heading_deg')} AS turn FROM fx_reports", "fx_reports"
    ),
)
def b7(spark, sf):
    return fx.reports(spark, sf).select(
        "icao24", "ts", geo.bearing_delta(F.lit(350.0), F.col("heading_deg")).alias("turn")
    )


@query(
    "b8_b9_time_of_day",
    sql(
        f"""
        SELECT h AS hour, m AS minutes, z AS minutes_zero, count(*) AS n FROM (
          SELECT coalesce((t::INT // 100) % 24, -1) AS h, coalesce({mins('t')}, -1) AS m, coalesce({mins('t')}, 0) AS z
          FROM (SELECT CASE WHEN crs_dep_hhmm = '0' THEN '2400' WHEN cancelled = 0 THEN crs_dep_hhmm END AS t
                FROM fx_flights))
        GROUP BY ALL
        """,
        "fx_flights",
    ),
)
def b8(spark, sf):
    t = F.when(F.col("crs_dep_hhmm") == "0", "2400").when(
        F.col("cancelled") == 0, F.col("crs_dep_hhmm")
    )
    return (
        fx.flights(spark, sf)
        .groupBy(
            F.coalesce(clock.hhmm_hour(t), F.lit(-1)).alias("hour"),
            F.coalesce(clock.hhmm_minutes(t), F.lit(-1)).alias("minutes"),
            clock.hhmm_minutes(t, nulls="zero").alias("minutes_zero"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "b10_flight_key",
    sql(
        "SELECT carrier || flight_number || '_' || strftime(flight_date, '%Y-%m-%d') AS flight_id,"
        " count(*) AS n FROM fx_flights GROUP BY 1",
        "fx_flights",
    ),
)
def b10(spark, sf):
    key = clock.flight_key("carrier", "flight_number", "flight_date").alias("flight_id")
    return fx.flights(spark, sf).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b11_only_arrivals",
    sql(
        """
        SELECT flight_date, carrier, flight_number, origin, dest,
               round(arr_delay_min, 6) + 0.0 AS arr_delay_min
        FROM fx_flights WHERE cancelled = 0 AND diverted = 0 AND arr_delay_min IS NOT NULL
        """,
        "fx_flights",
    ),
)
def b11(spark, sf):
    return clock.only_arrivals(fx.flights(spark, sf)).select(
        "flight_date", "carrier", "flight_number", "origin", "dest", "arr_delay_min"
    )


@query(
    "b13_calendar",
    sql(
        """
        SELECT hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week,
               (strftime(ts, '%Y-%m-%d') IN ('2024-01-01', '2024-01-15'))::INT AS is_holiday,
               count(*) AS n
        FROM events GROUP BY ALL
        """
    ),
)
def b13(spark, sf):
    cal = clock.calendar_cols(F.col("ts"))
    return (
        fx.table(spark, sf, "events")
        .groupBy(*[c.alias(n) for n, c in cal.items()])
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- E1, E2 ------------------------------------------------------------------------------------

_POS = "icao24, ts, baro_alt_ft, seq"


@query(
    "e1_dedupe_latest",
    sql(
        f"SELECT {_POS} FROM (SELECT *, row_number() OVER"
        " (PARTITION BY icao24 ORDER BY ts DESC, seq) AS rn FROM fx_dup) WHERE rn = 1",
        "fx_dup",
    ),
)
def e1(spark, sf):
    return ingest.dedupe_latest(fx.reports_dup(spark, sf)).select(*_POS.split(", "))


@query(
    "e2_first_per_key",
    sql(
        f"SELECT {_POS} FROM (SELECT *, row_number() OVER"
        " (PARTITION BY icao24 ORDER BY seq) AS rn FROM fx_dup) WHERE rn = 1",
        "fx_dup",
    ),
)
def e2(spark, sf):
    return ingest.first_per_key(fx.reports_dup(spark, sf)).select(*_POS.split(", "))


