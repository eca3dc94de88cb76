"""The track pipeline as a stream: keyed state, event-time order, bounded state life."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerotrace.functions.clock import leg_id
from aerotrace.functions.geo import cell_id
from aerotrace.operators.spatial import PAIR_CELL_DEG, nearest_airport, with_mass, with_type
from aerotrace.operators.tracks import (
    APPROACH_ALT_FT,
    CLIMB_FPM,
    COVERAGE_GAP_S,
    CRUISE_ALT_FT,
    CRUISE_SAMPLE_S,
    DESCENT_FPM,
    KEY,
    MAX_LEG_S,
    MIN_LEG_S,
    anomaly_hits,
)

_RULES = ("ts", "lat", "lon", "baro_alt_ft", "vert_rate_fpm", "on_ground", "squawk")
# Columns that no rule reads; they are passed through, null where the source has none.
_REST = {"geo_alt_ft": "DOUBLE", "velocity_kt": "DOUBLE", "heading_deg": "DOUBLE", "source": "STRING"}
_IN = (*_RULES, *_REST)
_PENDING = (
    "us LONG, lat DOUBLE, lon DOUBLE, alt DOUBLE, vrate DOUBLE, ground BOOLEAN, squawk STRING, "
    + ", ".join(f"{c} {kind}" for c, kind in _REST.items())
)
_TRACK = (
    "us LONG, ground BOOLEAN, phase STRING, edge STRING, edge_us LONG, edge_lat DOUBLE, "
    "edge_lon DOUBLE, sampled_us LONG"
)
_OUT = (
    "icao24 STRING, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, baro_alt_ft DOUBLE, "
    "vert_rate_fpm DOUBLE, on_ground BOOLEAN, squawk STRING, phase STRING, prev_phase STRING, "
    "gap BOOLEAN, sampled BOOLEAN, event STRING, leg_dep TIMESTAMP, open_dep TIMESTAMP, "
    "open_lat DOUBLE, open_lon DOUBLE, " + ", ".join(f"{c} {kind}" for c, kind in _REST.items())
)


def ordered_dedupe(reports: DataFrame, delay: str) -> DataFrame:
    """Drop redeliveries of a (aircraft, time) while they can still arrive."""
    return reports.withWatermark("ts", delay).dropDuplicatesWithinWatermark([KEY, "ts"])


def _phase(r: tuple, before: str) -> str:
    alt, vrate, ground = r[3:6]
    if ground:
        return "ground"
    if alt is None:
        return "unknown"
    if alt < APPROACH_ALT_FT and before in ("descent", "approach"):
        return "approach"
    if vrate is not None and vrate >= CLIMB_FPM:
        return "climb"
    if vrate is not None and vrate <= DESCENT_FPM:
        return "descent"
    return "cruise" if alt >= CRUISE_ALT_FT else before


class TrackProcessor(StatefulProcessor):
    """Buffers an aircraft's reports until the watermark has passed them, then folds in order.

    One timer per aircraft: at its earliest buffered report, or, with nothing buffered, at the
    end of the state's life.
    """

    def __init__(self, ttl_s: int) -> None:
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.track = handle.getValueState("track", _TRACK)
        self.timer = handle.getValueState("timer", "at LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        fresh = []
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            rest = pdf[list(_IN[1:])].astype(object)
            rest = rest.where(rest.notna(), None)
            fresh.extend(zip(us.tolist(), *[rest[c].tolist() for c in _IN[1:]], strict=True))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), [])

    def _advance(self, key, watermark_ms: int, fresh: list[tuple]):
        """Fold what the watermark has passed. Fresh reports are added to the state only where they
        have to wait, and are not read back from it."""
        held = sorted([*(tuple(r) for r in self.pending.get()), *fresh], key=lambda r: r[0])
        ready = [r for r in held if r[0] < watermark_ms * 1000]
        waiting = held[len(ready):]
        if fresh and not ready:
            self.pending.appendList(fresh)
        if ready:
            self.pending.put(waiting) if waiting else self.pending.clear()
            state = self.track.get() if self.track.exists() else None
            out = []
            for r in ready:
                state, row = self._fold(key[0], r, state)
                if row is not None:
                    out.append(row)
            self.track.update(state)
            names = [c.strip().split(" ")[0] for c in _OUT.split(",")]
            frame = pd.DataFrame(out, columns=names)
            for c in ("ts", "leg_dep", "open_dep"):
                frame[c] = pd.to_datetime(frame[c].astype("Int64"), unit="us")
            yield frame
        if waiting:
            self._wake(waiting[0][0] // 1000 + 1)
        elif self.track.exists():
            expiry = self.track.get()[0] // 1000 + self.ttl_ms
            if expiry <= watermark_ms:
                self.track.clear()
            else:
                self._wake(expiry)

    def _wake(self, at: int) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            self.timer.update((at,))
        self.handle.registerTimer(at)

    def _fold(self, icao24: str, r: tuple, state: tuple | None):
        us, lat, lon, alt, vrate, ground, squawk, *rest = r
        if state is not None and us - state[0] > self.ttl_ms * 1000:
            state = None
        if state is not None and us == state[0]:
            return state, None  # a redelivery that slipped through
        last_us, was_ground, before, edge, edge_us, edge_lat, edge_lon, sampled_us = (
            state if state is not None else (None,) * 8
        )
        gap = last_us is not None and us - last_us > COVERAGE_GAP_S * 1_000_000
        phase = _phase(r, "unknown" if gap or before is None else before)
        keep = (
            phase != "cruise"
            or sampled_us is None
            or us - sampled_us >= CRUISE_SAMPLE_S * 1_000_000
        )
        is_open = edge == "takeoff"
        event, leg_dep = None, None
        if was_ground is not None and was_ground != ground:
            if ground:
                fits = is_open and MIN_LEG_S * 1e6 <= us - edge_us <= MAX_LEG_S * 1e6
                event, leg_dep = ("landing", edge_us) if fits else ("rejected", None)
            else:
                event, leg_dep = "takeoff", us
        row = (
            icao24, us, lat, lon, alt, vrate, ground, squawk, phase, before, gap, keep, event,
            leg_dep, edge_us if is_open else None, edge_lat if is_open else None,
            edge_lon if is_open else None, *rest,
        )
        if event is not None:
            edge, edge_us = ("takeoff" if event == "takeoff" else "landing"), us
            edge_lat, edge_lon = lat, lon
        state = (
            us, ground, phase, edge, edge_us, edge_lat, edge_lon, us if keep else sampled_us
        )
        return state, row


def track_stream(reports: DataFrame, delay: str = "30 seconds", ttl_s: int = MAX_LEG_S) -> DataFrame:
    """Stream of reports with phase, sampling flag, leg event and the leg open before them.

    Reports later than the watermark are dropped (Spark counts them); an aircraft not seen for
    ``ttl_s`` is forgotten. Needs the RocksDB state store.
    """
    rest = [
        F.col(c) if c in reports.columns else F.lit(None).cast(kind).alias(c)
        for c, kind in _REST.items()
    ]
    keyed = ordered_dedupe(reports, delay).select(KEY, *_RULES, *rest)
    return keyed.groupBy(KEY).transformWithStateInPandas(
        TrackProcessor(ttl_s), _OUT, "Append", "EventTime"
    )


def live_tracks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``icao24, last_ts`` of the aircraft a track stream remembers, read from the state of its last batch."""
    operators = spark.read.format("state-metadata").load(checkpoint)
    (own,) = operators.where("operatorName LIKE 'transformWithState%'").select("operatorId").distinct().collect()
    state = (
        spark.read.format("statestore")
        .option("operatorId", own["operatorId"]).option("stateVarName", "track").load(checkpoint)
    )
    return state.select(f"key.{KEY}", F.timestamp_micros("value.us").alias("last_ts"))


def enriched_feed(
    tracks: DataFrame, registry: DataFrame, perf: DataFrame, airports: DataFrame
) -> DataFrame:
    """Every report with type, mass and the airport of the leg's takeoff, by stream-static joins."""
    typed = with_mass(with_type(tracks, registry), perf)
    placed = typed.select(
        F.struct("*").alias("_report"), F.col("open_lat").alias("lat"), F.col("open_lon").alias("lon")
    )
    return nearest_airport(placed, airports).select(
        "_report.*", F.col("airport").alias("origin_icao")
    )


def event_feed(tracks: DataFrame) -> DataFrame:
    """Takeoffs and closed legs, keyed by leg."""
    return tracks.where(F.col("event").isin("takeoff", "landing")).select(
        leg_id(KEY, "leg_dep").alias("flight_id"), KEY, "ts", F.col("event").alias("type")
    )


def anomaly_stream(tracks: DataFrame) -> DataFrame:
    """Rule hits, each its own row, with the leg open before the report."""
    return tracks.withColumn("_hit", F.explode(anomaly_hits())).select(
        KEY,
        "ts",
        F.col("_hit.kind").alias("kind"),
        F.col("_hit.score").alias("score"),
        F.col("_hit.evidence").alias("evidence"),
        F.when(F.col("open_dep").isNotNull(), leg_id(KEY, "open_dep")).alias("flight_id"),
    )


def cell_feed(tracks: DataFrame, size_deg: float = PAIR_CELL_DEG) -> DataFrame:
    """Sampled reports as messages keyed by grid cell."""
    body = F.struct(
        KEY, "ts", "lat", "lon", "baro_alt_ft", "velocity_kt", "heading_deg", "vert_rate_fpm", "on_ground"
    )
    return tracks.where("sampled").select(
        cell_id("lat", "lon", size_deg).alias("cell"), F.to_json(body).alias("value"), KEY, "ts"
    )
