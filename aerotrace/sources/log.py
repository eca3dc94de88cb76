"""Keyed JSON log as a stream: files, or a Kafka topic where the connector is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(
    spark: SparkSession,
    source: str,
    schema: str,
    *,
    servers: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Messages of a topic, parsed by a declared schema.

    With ``servers`` the source is a Kafka topic read from its start; else a folder of JSON
    lines. Progress is kept by the checkpoint of the query that writes the result.
    """
    if servers is not None:
        raw = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", source)
            .option("startingOffsets", "earliest")
            .load()
        )
        parsed = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m"))
        return parsed.select("m.*")
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(source)


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Rows as (key, JSON value) messages."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_log(
    df: DataFrame,
    target: str,
    checkpoint: str,
    key: str,
    *,
    servers: str | None = None,
    trigger: dict | None = None,
):
    """Publish rows keyed by ``key``; offsets are committed after the sink has the batch."""
    writer = keyed(df, key).writeStream.option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "10 seconds"})
    )
    if servers is not None:
        return (
            writer.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", target)
            .start()
        )
    return writer.format("json").option("path", target).start()
