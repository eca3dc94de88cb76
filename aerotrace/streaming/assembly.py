"""Several sinks from one fold of the track stream: sampled archive, anomalies, flights, events, counters."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from aerotrace.functions.clock import leg_id
from aerotrace.operators.spatial import nearest_airport, with_cell
from aerotrace.operators.tracks import KEY, anomaly_hits
from aerotrace.sources import versioned
from aerotrace.sources.archive import archive_rows
from aerotrace.streaming.tracks import anomaly_stream, event_feed

FLIGHT = (
    "flight_id STRING, icao24 STRING, origin_icao STRING, dest_icao STRING, actual_dep TIMESTAMP, "
    "actual_arr TIMESTAMP"
)
KINDS = ("squawk_emergency", "rapid_descent", "go_around")
EVENTS = ("takeoff", "landing", "rejected")


def flight_legs(tracks: DataFrame, airports: DataFrame) -> DataFrame:
    """What the takeoffs and landings of a batch say about their flights, one row per flight.

    A landing carries the departure of its leg, so it finds its flight in any later batch. Rejected
    legs say nothing: their flight stays airborne.
    """
    up, down = F.col("event") == "takeoff", F.col("event") == "landing"
    ends = nearest_airport(tracks.where(up | down), airports)
    return ends.groupBy(leg_id(KEY, "leg_dep").alias("flight_id"), KEY, F.col("leg_dep").alias("actual_dep")).agg(
        F.max(F.when(up, F.col("airport"))).alias("origin_icao"),
        F.max(F.when(down, F.col("airport"))).alias("dest_icao"),
        F.max(F.when(down, F.col("ts"))).alias("actual_arr"),
    ).select("flight_id", KEY, "origin_icao", "dest_icao", "actual_dep", "actual_arr")


def merged_flights(old: DataFrame, new: DataFrame) -> DataFrame:
    """Open and closed legs by flight id. A known value is never lost, so order and repeats do not matter."""
    rest = [F.max(c).alias(c) for c in (KEY, "origin_icao", "dest_icao", "actual_dep", "actual_arr", "dt", "hour")]
    return old.unionByName(new).groupBy("flight_id").agg(*rest)


def merge_flights(batch: DataFrame, airports: DataFrame, path: str, batch_id: int) -> bool:
    """Merge a batch of track rows into the flights table, stored by the hour of departure."""
    return versioned.merge(flight_legs(batch, airports), path, batch_id, merged_flights, "actual_dep")


def read_flights(spark, path: str) -> DataFrame:
    """The flights table: airborne until the landing is known."""
    rows = versioned.read_table(spark, path, FLIGHT, "actual_dep").drop("dt", "hour")
    return rows.withColumn("status", F.when(F.col("actual_arr").isNotNull(), "landed").otherwise("airborne"))


def assemble_batch(batch: DataFrame, batch_id: int, airports: DataFrame, base: str) -> None:
    """Write one batch of track rows to all sinks. A repeated batch adds nothing to any of them."""
    batch = batch.persist()
    try:
        sampled = archive_rows(with_cell(batch.where("sampled"))).drop("dt", "hour")
        clustered = sampled.repartitionByRange(F.date_trunc("hour", "ts"), "cell", KEY, "ts").sortWithinPartitions(
            F.date_trunc("hour", "ts"), "cell", KEY, "ts"
        )
        versioned.append(clustered, f"{base}/archive", batch_id)
        versioned.append(anomaly_stream(batch), f"{base}/anomalies", batch_id)
        versioned.append(event_feed(batch), f"{base}/events", batch_id)
        merge_flights(batch, airports, f"{base}/flights", batch_id)
    finally:
        batch.unpersist()


def assemble(tracks: DataFrame, airports: DataFrame, base: str, checkpoint: str, trigger: dict | None = None):
    """Fold the reports once and fill ``archive`` (sampled reports), ``anomalies``, ``events`` and ``flights``
    below ``base``. All are versioned tables, so a batch that is tried again changes nothing."""
    return (
        tracks.writeStream.foreachBatch(lambda batch, i: assemble_batch(batch, i, airports, base))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def count_rejects(parsed: DataFrame, reasons: tuple[str, ...], sources: tuple[str, ...]) -> DataFrame:
    """Parsed records, observed: records by source and rejects by reason, per batch, while they pass."""
    return parsed.observe(
        "ingest",
        *[F.count_if((F.col("source") == s) & F.col("reason").isNull()).alias(f"received:{s}") for s in sources],
        *[F.count_if(F.col("reason") == r).alias(f"rejected:{r}") for r in reasons],
    )


def count_tracks(tracks: DataFrame) -> DataFrame:
    """Track rows, observed: anomalies by kind, leg events by type, sampled rows, per batch."""

    def of_kind(kind: str) -> Column:
        return F.sum(F.size(F.filter(anomaly_hits(), lambda h: h["kind"] == kind))).alias(f"anomaly:{kind}")

    events = [F.count_if(F.col("event") == e).alias(f"event:{e}") for e in EVENTS]
    return tracks.observe("tracks", *map(of_kind, KINDS), *events, F.count_if("sampled").alias("sampled:rows"))


class Counters(StreamingQueryListener):
    """Counters of running streams: what ``count_rejects`` and ``count_tracks`` observe, rows read, and
    rows that came too late for the watermark. ``batches`` has them per batch, ``total`` their sums.

    Counts are of batches as they ran: one that is tried again after a failure counts again.
    """

    def __init__(self) -> None:
        self.total: Counter[str] = Counter()
        self.batches: list[tuple[str, int, dict[str, int]]] = []
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counts = Counter({
            name: int(row[name] or 0) for row in progress.observedMetrics.values() for name in row.asDict()
        })
        counts["rows:read"] = max(0, progress.numInputRows)
        counts["rows:late"] = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        self.batches.append((str(progress.runId), progress.batchId, dict(counts)))
        self.total.update(counts)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until a finished query has reported all of its batches."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of stream {query.runId} reported")
