"""Time-bucket rollups of reports, batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(df: DataFrame, seconds: int) -> DataFrame:
    """Per aircraft and bucket: mean position and rates, last heading, on the ground throughout."""
    return (
        df.groupBy("icao24", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(
            *[
                F.avg(c).alias(c)
                for c in ("lat", "lon", "baro_alt_ft", "velocity_kt", "vert_rate_fpm")
            ],
            F.max_by("heading_deg", "ts").alias("heading_deg"),
            F.bool_and("on_ground").alias("on_ground"),
        )
        .select(
            "icao24",
            F.col("w.start").alias("bucket"),
            "lat",
            "lon",
            "baro_alt_ft",
            "velocity_kt",
            "vert_rate_fpm",
            "heading_deg",
            "on_ground",
        )
    )
