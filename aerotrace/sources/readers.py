"""File sources with declared schemas: snapshots, on-time months, airports, runways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.functions.geo import in_bbox
from aerotrace.schemas import ONTIME_COLUMNS, SNAPSHOT

# Box of the contiguous US (min_lat, max_lat, min_lon, max_lon).
CONUS_BBOX = (24.5, 49.5, -125.0, -66.5)


def read_snapshots(
    spark: SparkSession, path: str | list[str], bbox: tuple[float, float, float, float] = CONUS_BBOX
) -> DataFrame:
    """Historical snapshots (one JSON object per line or file) to one row per aircraft.

    Ids that are not plain hex, missing positions and positions outside the box are dropped.
    The geometric climb rate stands in where the barometric one is missing or null.
    """
    ac = spark.read.schema(SNAPSHOT).json(path).select(
        F.timestamp_micros(F.round(F.col("now") * 1_000_000).cast("long")).alias("ts"),
        F.explode("aircraft").alias("a"),
    )
    ground = F.coalesce(F.col("a.alt_baro") == "ground", F.lit(False))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return ac.where(
        F.col("a.hex").rlike("^[0-9a-fA-F]+$")
        & F.col("a.lat").isNotNull()
        & F.col("a.lon").isNotNull()
        & in_bbox("a.lat", "a.lon", bbox)
    ).select(
        F.col("a.hex").alias("icao24"),
        "ts",
        F.col("a.lat").alias("lat"),
        F.col("a.lon").alias("lon"),
        F.when(~ground, F.col("a.alt_baro").try_cast("double")).alias("baro_alt_ft"),
        F.col("a.gs").alias("velocity_kt"),
        F.col("a.track").alias("heading_deg"),
        F.coalesce("a.baro_rate", "a.geom_rate").alias("vert_rate_fpm"),
        ground.alias("on_ground"),
        blank(F.col("a.flight")).alias("callsign"),
        F.col("a.r").alias("registration"),
        F.col("a.t").alias("type_code"),
    )


def read_ontime(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """On-time months (unpacked CSV with header): 21 of the columns, renamed and typed.

    Columns are taken by name, so only those 21 are parsed. Year and month come from the date.
    Rows keep no global order; sort where it is needed.
    """
    if not paths:
        raise ValueError("no months given")
    # each header is checked against the first one, so no column of a later month is misread
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    table = raw.select(*[F.col(src).try_cast(kind).alias(dst) for src, dst, kind in ONTIME_COLUMNS])
    return table.withColumn("year", F.year("flight_date")).withColumn(
        "month", F.month("flight_date")
    )


def _text(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV with header, all columns as text."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def load_airports(
    df: DataFrame, bbox: tuple[float, float, float, float] = CONUS_BBOX
) -> DataFrame:
    """Large and medium US airports inside the box that have a four-letter code."""
    icao = F.upper(F.trim(F.coalesce(_text("icao_code"), _text("gps_code"), _text("ident"))))
    return (
        df.withColumn("icao", icao)
        .withColumn("lat", F.col("latitude_deg").try_cast("double"))
        .withColumn("lon", F.col("longitude_deg").try_cast("double"))
        .where(
            (F.length("icao") == 4)
            & F.col("type").isin("large_airport", "medium_airport")
            & (F.col("iso_country") == "US")
            & in_bbox("lat", "lon", bbox)
        )
        .select(
            "icao",
            _text("iata_code").alias("iata"),
            F.substring("name", 1, 128).alias("name"),
            _text("municipality").alias("city"),
            F.lit("US").alias("country"),
            "lat",
            "lon",
            F.col("elevation_ft").try_cast("double").alias("elevation_ft"),
        )
    )


def load_runways(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Physical runways of known airports as one row per end; ends without a name dropped."""
    num = lambda c: F.col(c).try_cast("double")
    end = lambda p: F.struct(
        _text(f"{p}_ident").alias("ident"),
        num(f"{p}_heading_degT").alias("true_heading_deg"),
        num(f"{p}_latitude_deg").alias("lat"),
        num(f"{p}_longitude_deg").alias("lon"),
    )
    ends = df.select(
        F.upper(F.trim("airport_ident")).alias("airport_icao"),
        num("length_ft").alias("length_ft"),
        F.explode(F.array(end("le"), end("he"))).alias("e"),
    ).where(F.col("e.ident").isNotNull())
    known = airports.select(F.col("icao").alias("airport_icao"))
    return ends.join(known, "airport_icao", "left_semi").select(
        "airport_icao", "e.ident", "e.true_heading_deg", "length_ft", "e.lat", "e.lon"
    )
