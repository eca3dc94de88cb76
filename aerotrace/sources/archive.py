"""Parquet archive of reports, laid out by event date and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.schemas import REPORT

ARCHIVE_COLUMNS = (
    "icao24", "ts", "lat", "lon", "baro_alt_ft", "geo_alt_ft", "velocity_kt", "heading_deg",
    "vert_rate_fpm", "on_ground", "squawk", "cell", "source",
)
TYPES = dict(part.strip().split(" ", 1) for part in REPORT.split(","))


def archive_rows(df: DataFrame) -> DataFrame:
    """The 13 archive columns (missing ones null) plus ``dt`` and ``hour`` of the event time."""
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(TYPES[c]).alias(c)
            for c in ARCHIVE_COLUMNS
        ],
        F.date_format("ts", "yyyy-MM-dd").alias("dt"),
        F.date_format("ts", "HH").alias("hour"),
    )


def write_archive(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write reports under ``dt=/hour=``, clustered by cell, aircraft and time inside each file.

    Range partitioning cuts a busy hour, a busy cell or one busy aircraft into several tasks and
    files of similar size, and the clustering lets row groups be skipped by cell.
    """
    (
        archive_rows(df)
        .repartitionByRange("dt", "hour", "cell", "icao24", "ts")
        .sortWithinPartitions("dt", "hour", "cell", "icao24", "ts")
        .write.mode(mode)
        .partitionBy("dt", "hour")
        .parquet(path)
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive; filters on ``dt`` and ``hour`` skip folders."""
    return spark.read.schema(f"{REPORT}, dt STRING, hour STRING").parquet(path)


def stream_archive(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream of reports to the archive; the trigger interval is the flush interval."""
    return (
        archive_rows(df)
        .writeStream.format("parquet")
        .partitionBy("dt", "hour")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )
