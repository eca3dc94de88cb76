"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

# One raw record of the live feed. ``alt_baro`` is a number or the word "ground", and any number
# may come as text, so all are read as text and cast.
RAW_REPORT = (
    "hex STRING, flight STRING, r STRING, t STRING, alt_baro STRING, alt_geom STRING, "
    "gs STRING, track STRING, baro_rate STRING, squawk STRING, lat STRING, lon STRING, "
    "seen_pos STRING"
)

# A position report, as archived (``cell`` is the grid cell of the storage column).
REPORT = (
    "icao24 STRING, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, baro_alt_ft DOUBLE, "
    "geo_alt_ft DOUBLE, velocity_kt DOUBLE, heading_deg DOUBLE, vert_rate_fpm DOUBLE, "
    "on_ground BOOLEAN, squawk STRING, cell STRING, source STRING"
)

# A historical snapshot file: one object with all aircraft.
SNAPSHOT = (
    "now DOUBLE, aircraft ARRAY<STRUCT<hex: STRING, flight: STRING, r: STRING, t: STRING, "
    "alt_baro: STRING, gs: DOUBLE, track: DOUBLE, baro_rate: DOUBLE, geom_rate: DOUBLE, "
    "lat: DOUBLE, lon: DOUBLE>>"
)

# Columns kept from the monthly on-time file, their names here and their types.
ONTIME_COLUMNS = (
    ("FlightDate", "flight_date", "DATE"),
    ("Reporting_Airline", "carrier", "STRING"),
    ("Tail_Number", "tail_number", "STRING"),
    ("Flight_Number_Reporting_Airline", "flight_number", "STRING"),
    ("Origin", "origin", "STRING"),
    ("Dest", "dest", "STRING"),
    ("CRSDepTime", "crs_dep_hhmm", "STRING"),
    ("DepTime", "dep_hhmm", "STRING"),
    ("DepDelayMinutes", "dep_delay_min", "DOUBLE"),
    ("CRSArrTime", "crs_arr_hhmm", "STRING"),
    ("ArrTime", "arr_hhmm", "STRING"),
    ("ArrDelayMinutes", "arr_delay_min", "DOUBLE"),
    ("Cancelled", "cancelled", "DOUBLE"),
    ("Diverted", "diverted", "DOUBLE"),
    ("CRSElapsedTime", "sched_elapsed_min", "DOUBLE"),
    ("ActualElapsedTime", "actual_elapsed_min", "DOUBLE"),
    ("AirTime", "air_time_min", "DOUBLE"),
    ("TaxiIn", "taxi_in_min", "DOUBLE"),
    ("TaxiOut", "taxi_out_min", "DOUBLE"),
    ("Distance", "distance_mi", "DOUBLE"),
    ("DayOfWeek", "day_of_week", "INT"),
)
