"""A8, A9, K: the streaming jobs over all reports, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.operators import ingest
from aerotrace.operators.spatial import with_cell
from aerotrace.plans import fixtures as fx
from aerotrace.plans import ingest_queries  # noqa: F401 - registers the SQL used below
from aerotrace.plans.oracle_views import rnd, sql
from aerotrace.plans.registry import ORACLE, query
from aerotrace.plans.track_queries import SAMPLED_SQL
from aerotrace.session import scratch_dir
from aerotrace.sources import archive, log, versioned
from aerotrace.schemas import REPORT
from aerotrace.streaming import assembly, tables, tracks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# State of a join on disk: the default provider keeps all of it on the heap. The stores of an executor share one
# bound on native memory, a task of a join has one store for both sides, and a store claims no disk ahead.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}
ONCE = {"availableNow": True}
# After the last report, one far later report of no aircraft moves the watermark past it.
CLOSING = "2024-01-02 14:00:00"
_ASSEMBLED: dict[tuple[str, str], str] = {}


def report_files(spark: SparkSession, df: DataFrame) -> tuple[str, str]:
    """Reports written as JSON log files by one job, as many files as there are tasks, with a
    closing row."""
    path = scratch_dir(spark, "log")
    rows = df.drop("source")
    last = rows.limit(1).withColumn("icao24", F.lit("closing")).withColumn(
        "ts", F.lit(CLOSING).cast("timestamp")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows.unionByName(last).write.json(path)
    return path, schema


def stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    path, schema = report_files(spark, df)
    return log.read_log(spark, path, schema)


def finish(spark: SparkSession, df: DataFrame, label: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over the input there is, into a table, and read that. ``conf`` holds for this stream only."""
    out = scratch_dir(spark, label)
    writer = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}-state")
        .trigger(**ONCE)
    )
    before = {key: spark.conf.get(key, None) for key in conf or {}}
    try:
        for key, value in (conf or {}).items():
            spark.conf.set(key, value)
        q = writer.start()  # copies the session's settings
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).where("icao24 <> 'closing'")


def run_tracks(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reports = stream(spark, fx.kept(spark, sf, "reports"))
    return finish(spark, tracks.track_stream(reports), "tracks")


@query(
    "a8_keyed_log",
    sql(
        f"SELECT icao24 AS key, icao24, ts, {rnd('lat', 'lat')}, seq FROM fx_reports", "fx_reports"
    ),
)
def a8(spark, sf):
    path, schema = report_files(spark, fx.kept(spark, sf, "reports"))
    rows = log.read_log(spark, path, schema).where("icao24 <> 'closing'")
    out = scratch_dir(spark, "keyed")
    log.write_log(rows, out, f"{out}-state", "icao24", trigger=ONCE).awaitTermination()
    back = spark.read.schema("key STRING, value STRING").json(out)
    return back.select("key", F.from_json("value", schema).alias("m")).select(
        "key", "m.icao24", "m.ts", "m.lat", "m.seq"
    )


@query("a9_archive_stream", ORACLE["a9_archive"].replace(", source\n", "\n"))
def a9s(spark, sf):
    out = scratch_dir(spark, "archive")
    rows = stream(spark, fx.kept(spark, sf, "reports")).where("icao24 <> 'closing'")
    archive.stream_archive(with_cell(rows), out, f"{out}-state", ONCE).awaitTermination()
    return archive.read_archive(spark, out).drop("source")


@query(
    "k1_track_stream",
    sql(
        f"""
        {SAMPLED_SQL.rsplit("SELECT icao24, ts, phase FROM walk", 1)[0]}
        SELECT s.icao24, s.ts, s.phase, s.prev_phase, s.gap, w.kept AS sampled,
               CASE WHEN took_off THEN 'takeoff'
                    WHEN landed THEN CASE l.outcome WHEN 'closed' THEN 'landing' ELSE 'rejected' END
               END AS event,
               CASE WHEN e_kind = 'takeoff' THEN e_ts END AS open_dep
        FROM states s JOIN walk w ON w.icao24 = s.icao24 AND w.i = s.i
        LEFT JOIN pairs_legs l ON l.icao24 = s.icao24 AND l.arr_ts = s.ts
        """,
        "states",
        "pairs_legs",
    ),
)
def k1(spark, sf):
    return run_tracks(spark, sf).select(
        "icao24", "ts", "phase", "prev_phase", "gap", "sampled", "event", "open_dep"
    )


@query(
    "k1_anomaly_stream",
    sql(
        """
        SELECT icao24, ts, kind, 1e0 AS score,
               CASE WHEN e_kind = 'takeoff'
                    THEN md5(icao24 || '|' || epoch_ms(e_ts)::VARCHAR) END AS flight_id
        FROM hits
        """,
        "hits",
    ),
)
def k1a(spark, sf):
    return tracks.anomaly_stream(run_tracks(spark, sf)).drop("evidence")


@query("k1_enriched_stream", ORACLE["e9_enrich"])
def k1x(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reports = stream(spark, fx.kept(spark, sf, "reports"))
    feed = tracks.enriched_feed(
        tracks.track_stream(reports), fx.registry(spark, sf), fx.perf(spark), fx.airports(spark, sf)
    )
    return finish(spark, feed, "enriched").select(
        "icao24", "ts", "phase", "origin_icao", "type_code", "mass_kg"
    )


@query(
    "k1_event_stream",
    sql(
        """
        SELECT flight_id, icao24, actual_dep AS ts, 'takeoff' AS type FROM fx_legs
        UNION ALL SELECT flight_id, icao24, actual_arr, 'landing' FROM fx_legs WHERE status = 'landed'
        """,
        "fx_legs",
    ),
)
def k1e(spark, sf):
    return tracks.event_feed(run_tracks(spark, sf))


@query(
    "k2_ordered_dedupe",
    sql("SELECT icao24, ts, squawk FROM fx_reports", "fx_reports"),
)
def k2(spark, sf):
    rows = stream(spark, fx.reports_dup(spark, sf))
    return finish(spark, tracks.ordered_dedupe(rows, "30 seconds"), "dedupe").select(
        "icao24", "ts", "squawk"
    )


@query("k3_rollup_stream", ORACLE["d1_rollup_60s"])
def k3(spark, sf):
    rows = stream(spark, fx.kept(spark, sf, "reports"))
    return finish(spark, tables.rollup_stream(rows, 60), "rollup")


@query("k4_upsert_stream", ORACLE["a10_upsert"])
def k4(spark, sf):
    out = scratch_dir(spark, "latest")
    rows = stream(spark, fx.reports_dup(spark, sf)).where("icao24 <> 'closing'")
    tables.upsert_stream(rows, out, f"{out}-state", trigger=ONCE).awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return versioned.read_table(spark, out, schema).drop("dt", "hour")


@query(
    "k5_cell_feed",
    sql(
        SAMPLED_SQL.replace(
            "SELECT icao24, ts, phase FROM walk WHERE kept",
            "SELECT floor(lat / 0.3e0)::INT || ':' || floor(lon / 0.3e0)::INT AS cell, icao24, ts"
            " FROM walk JOIN states USING (icao24, i, ts) WHERE kept",
        ),
        "states",
    ),
)
def k5(spark, sf):
    return tracks.cell_feed(run_tracks(spark, sf)).drop("value")


def assembled(spark: SparkSession, sf: str) -> str:
    """All sinks of one fold over the reports, in one folder, made once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ASSEMBLED:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        base = scratch_dir(spark, "assembled")
        feed = tracks.track_stream(stream(spark, fx.kept(spark, sf, "reports"))).where("icao24 <> 'closing'")
        assembly.assemble(feed, fx.airports(spark, sf), base, f"{base}/state", ONCE).awaitTermination()
        _ASSEMBLED[key] = base
    return _ASSEMBLED[key]



_KEPT_SQL = SAMPLED_SQL.split("SELECT icao24, ts, phase FROM walk WHERE kept")[0]


@query(
    "a9_sampled_archive",
    sql(
        f"""
        {_KEPT_SQL}
        SELECT strftime(s.ts, '%Y-%m-%d') AS dt, strftime(s.ts, '%H') AS hour, s.icao24, s.ts,
               {rnd('s.lat', 'lat')}, {rnd('s.lon', 'lon')}, s.baro_alt_ft, NULL::DOUBLE AS geo_alt_ft,
               s.velocity_kt, s.heading_deg, s.vert_rate_fpm, s.on_ground, s.squawk,
               floor(s.lat / 0.3e0)::INT || ':' || floor(s.lon / 0.3e0)::INT AS cell
        FROM fx_reports s JOIN walk w ON w.icao24 = s.icao24 AND w.ts = s.ts WHERE w.kept
        """,
        "states",
        "fx_reports",
    ),
)
def a9k(spark, sf):
    """The archive as the assembler writes it: sampled reports only."""
    return versioned.read_table(spark, f"{assembled(spark, sf)}/archive", REPORT).drop("source")


@query("e7_flight_stream", ORACLE["e7_flight_rows"])
def e7k(spark, sf):
    """The flights table as the stream keeps it."""
    return assembly.read_flights(spark, f"{assembled(spark, sf)}/flights")


@query("k1_assembled_anomalies", ORACLE["k1_anomaly_stream"])
def k1k(spark, sf):
    schema = "icao24 STRING, ts TIMESTAMP, kind STRING, score DOUBLE, flight_id STRING"
    return versioned.read_table(spark, f"{assembled(spark, sf)}/anomalies", schema).drop("dt", "hour")


REASONS = ("no_hex", "no_position", "not_icao", "bad_hex", "bad_position", "lat_range", "lon_range")


@query(
    "d13_stream_counters",
    sql(
        f"""
        {_KEPT_SQL},
        legs AS (SELECT outcome, arr_ts FROM pairs_legs),
        counted AS (
          SELECT 'anomaly:' || kind AS counter, count(*) AS n FROM hits GROUP BY 1
          UNION ALL SELECT 'event:takeoff', count(*) FROM states WHERE took_off
          UNION ALL SELECT 'event:landing', count(*) FROM legs WHERE outcome = 'closed'
          UNION ALL SELECT 'event:rejected', count(*) FROM states s WHERE landed AND NOT EXISTS (
            SELECT 1 FROM pairs_legs l WHERE l.icao24 = s.icao24 AND l.arr_ts = s.ts AND l.outcome = 'closed')
          UNION ALL SELECT 'sampled:rows', count(*) FROM walk WHERE kept
          UNION ALL SELECT 'received:adsb_lol', count(*) FROM fx_reports WHERE seq % 50 <> 0 AND seq % 61 <> 0
          UNION ALL SELECT 'rejected:no_position', count(*) FROM fx_reports WHERE seq % 61 = 0
          UNION ALL SELECT 'rejected:not_icao', count(*) FROM fx_reports WHERE seq % 50 = 0 AND seq % 61 <> 0)
        SELECT counter, n FROM counted WHERE n > 0
        """,
        "states",
        "hits",
        "pairs_legs",
        "fx_reports",
    ),
)
def d13s(spark, sf):
    """Sums of the counters that two streams report per batch: of the ingest and of the tracks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    counters = assembly.Counters()
    spark.streams.addListener(counters)
    try:
        raw = scratch_dir(spark, "raw")
        fx.raw_json(spark, sf).write.json(raw)
        records = log.read_log(spark, raw, "seq LONG, received_at TIMESTAMP, value STRING")
        parsed = assembly.count_rejects(ingest.parse_reports(records), REASONS, ("adsb_lol",))
        reports = stream(spark, fx.kept(spark, sf, "reports"))
        feed = assembly.count_tracks(tracks.track_stream(reports).where("icao24 <> 'closing'"))
        for name, df in (("good", ingest.split_valid(parsed)[0]), ("tracks", feed)):
            out = scratch_dir(spark, name)
            writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
            q = writer.trigger(**ONCE).start()
            q.awaitTermination()
            counters.wait(q)
    finally:
        spark.streams.removeListener(counters)
    rows = [(k, n) for k, n in counters.total.items() if n and not k.startswith("rows:")]
    return spark.createDataFrame(rows, "counter STRING, n LONG")


# So long a life that the closing report, a day later, finds some aircraft forgotten and some not.
LIFE_S = 84_813


@query(
    "k6_state_expiry",
    sql(
        f"""
        SELECT icao24, max(ts) AS last_ts FROM fx_reports GROUP BY 1
        HAVING max(ts) + INTERVAL {LIFE_S} SECONDS > TIMESTAMP '{CLOSING}' - INTERVAL 30 SECONDS
        """,
        "fx_reports",
    ),
)
def k6(spark, sf):
    """Aircraft still remembered after a quiet time: none whose last report is older than the state's life."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path, schema = report_files(spark, fx.kept(spark, sf, "reports"))
    feed = tracks.track_stream(log.read_log(spark, path, schema), ttl_s=LIFE_S)
    out = scratch_dir(spark, "expiry")
    writer = feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
    writer.trigger(**ONCE).start().awaitTermination()
    return tracks.live_tracks(spark, f"{out}-state").where("icao24 <> 'closing'")
