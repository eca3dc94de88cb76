"""Streams: order inside the watermark does not matter, late rows are dropped, restarts go on."""

from __future__ import annotations

import datetime as dt

from aerotrace.operators.tracks import flight_rows, track_states
from aerotrace.plans import fixtures as fx
from aerotrace.plans import learning_queries, streaming_queries
from aerotrace.plans.streaming_queries import CLOSING, ONCE, ROCKSDB
from aerotrace.sources import log, versioned
from aerotrace.streaming import assembly, tables, tracks
from pyspark.sql import functions as F

from paths import SF_DIR

SCHEMA = (
    "icao24 string, ts timestamp, lat double, lon double, baro_alt_ft double, "
    "vert_rate_fpm double, on_ground boolean, squawk string"
)


def put(df, path, name):
    df.coalesce(1).write.json(f"{path}/{name}")


def closing(rows):
    return rows.limit(1).withColumn("icao24", F.lit("closing")).withColumn("ts", F.lit(CLOSING).cast("timestamp"))


def run(spark, path, out):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    feed = tracks.track_stream(log.read_log(spark, f"{path}/*", SCHEMA, files_per_trigger=1), "30 seconds")
    q = feed.writeStream.option("path", out).option("checkpointLocation", f"{out}-state").trigger(**ONCE).start()
    q.awaitTermination()


def read(spark, out):
    return sorted(
        (r.icao24, r.ts, r.phase, r.gap)
        for r in spark.read.parquet(out).where("icao24 <> 'closing'").collect()
    )


def test_shuffled_duplicated_and_restarted_stream_equals_batch(spark, tmp_path):
    rows = fx.kept(spark, SF_DIR, "reports").select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])
    want = sorted((r.icao24, r.ts, r.phase, r.gap) for r in track_states(rows).collect())
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    second = F.unix_timestamp("ts") - 1_704_117_600
    # Rows swap sides of the cut by up to 20 s, inside the 30 s watermark.
    swapped = second + F.when(F.col("icao24").endswith("1"), 20).otherwise(0)
    put(rows.where(swapped < 60).orderBy(F.col("ts").desc()), path, "0")
    run(spark, path, out)  # stops with reports still buffered in the state
    put(rows.where((swapped >= 60) & (swapped < 450)), path, "1")
    put(rows.where((second >= 400) & (second < 450)), path, "2")  # redelivered
    put(rows.where(swapped >= 450), path, "3")
    put(closing(rows), path, "4")
    run(spark, path, out)
    assert read(spark, out) == want


def test_late_reports_are_dropped(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 14)
    make = lambda key, s: (key, t + dt.timedelta(seconds=s), 1.0, 1.0, 5000.0, 0.0, False, None)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, batch in enumerate([[("a", 0), ("a", 300)], [("b", 310)], [("a", 10), ("b", 320)]]):
        put(spark.createDataFrame([make(*x) for x in batch], SCHEMA), path, str(i))
    put(closing(spark.createDataFrame([make("a", 0)], SCHEMA)), path, "9")
    run(spark, path, out)
    assert [(k, (ts - t).total_seconds()) for k, ts, _, _ in read(spark, out)] == [
        ("a", 0), ("a", 300), ("b", 310), ("b", 320)
    ]


def test_state_expires(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 0)
    rows = [("a", t + dt.timedelta(hours=h), 1.0, 1.0, None, 0.0, h != 9, None) for h in (0, 9)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, r in enumerate(rows):
        put(spark.createDataFrame([r], SCHEMA), path, str(i))
    put(closing(spark.createDataFrame([rows[0]], SCHEMA)), path, "9")
    run(spark, path, out)
    got = spark.read.parquet(out).where("icao24 = 'a'").orderBy("ts").collect()
    assert [(r.prev_phase, r.event) for r in got] == [(None, None), (None, None)]


def test_flights_table_equals_batch_after_disorder_repeats_and_restart(spark, tmp_path):
    airports = fx.airports(spark, SF_DIR)
    rows = fx.kept(spark, SF_DIR, "reports").select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])
    want = sorted(map(tuple, flight_rows(track_states(rows), airports).collect()), key=str)
    path, base = str(tmp_path / "in"), str(tmp_path / "out")
    second = F.unix_timestamp("ts") - 1_704_117_600

    def go():
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        feed = tracks.track_stream(log.read_log(spark, f"{path}/*", SCHEMA, files_per_trigger=1), "30 seconds")
        live = feed.where("icao24 <> 'closing'")
        assembly.assemble(live, airports, base, f"{base}/state", ONCE).awaitTermination()

    put(rows.where(second < 130).orderBy(F.col("ts").desc()), path, "0")
    go()  # stops with legs open
    opened = assembly.read_flights(spark, f"{base}/flights")
    assert {r["status"] for r in opened.collect()} <= {"airborne", "landed"}
    put(rows.where((second >= 130) & (second < 400)), path, "1")
    put(rows.where((second >= 360) & (second < 400)), path, "2")  # redelivered
    put(rows.where(second >= 400), path, "3")
    put(closing(rows), path, "4")
    go()
    columns = ["flight_id", "icao24", "origin_icao", "dest_icao", "actual_dep", "actual_arr", "status"]
    got = assembly.read_flights(spark, f"{base}/flights").select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == want

    # a batch that comes again changes nothing, whatever it holds
    before = versioned.manifest(spark, f"{base}/flights")
    batch = spark.createDataFrame([], tracks._OUT)
    assert not assembly.merge_flights(batch, airports, f"{base}/flights", before["batch"])
    assert versioned.manifest(spark, f"{base}/flights") == before


def test_readers_see_whole_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "icao24 STRING, ts TIMESTAMP, seq LONG"
    t = dt.datetime(2024, 1, 1, 14)
    make = lambda *rows: spark.createDataFrame([(k, t + dt.timedelta(hours=h), s) for k, h, s in rows], schema)
    read = lambda **kw: sorted((r["icao24"], r["seq"]) for r in versioned.read_table(spark, path, schema, **kw).collect())
    assert read() == []
    tables.merge_batch(make(("a", 0, 1), ("b", 1, 2)), path, batch_id=0)
    old = versioned.read_table(spark, path, schema)  # a reader that has begun
    tables.merge_batch(make(("a", 0, 3), ("c", 0, 4)), path, batch_id=1)
    assert sorted(r["seq"] for r in old.collect()) == [1, 2]
    assert read() == [("a", 3), ("b", 2), ("c", 4)]
    tables.merge_batch(make(("a", 0, 9)), path, batch_id=1)  # the batch again
    assert read() == [("a", 3), ("b", 2), ("c", 4)]
    # a writer that fails before the manifest leaves the table as it was
    spark.createDataFrame([("z", 7)], "icao24 string, seq long").write.parquet(f"{path}/data/v000000000003")
    assert read() == [("a", 3), ("b", 2), ("c", 4)]
    tables.merge_batch(make(("d", 1, 5)), path, batch_id=2)
    assert read() == [("a", 3), ("b", 2), ("c", 4), ("d", 5)]
    assert read(since="2024-01-01 15") == [("b", 2), ("d", 5)] and read(until="2024-01-01 14") == [("a", 3), ("c", 4)]
    assert read(version=1) == [("a", 1), ("b", 2)]
    assert versioned.expire(spark, path, keep=1) == 2  # the first files of both hours
    assert read() == [("a", 3), ("b", 2), ("c", 4), ("d", 5)]
    assert versioned.append(make(("e", 0, 6)), path, 3) and not versioned.append(make(("e", 0, 6)), path, 3)
    assert read() == [("a", 3), ("b", 2), ("c", 4), ("d", 5), ("e", 6)]


def test_counters_tell_late_rows_per_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    t = dt.datetime(2024, 1, 1, 14)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda key, s, squawk: (key, t + dt.timedelta(seconds=s), 1.0, 1.0, 5000.0, 0.0, False, squawk)
    for i, batch in enumerate([[("a", 0, "7700"), ("a", 300, None)], [("b", 310, None)], [("a", 10, "7700"), ("b", 320, "7600")]]):
        put(spark.createDataFrame([make(*x) for x in batch], SCHEMA), path, str(i))
    put(closing(spark.createDataFrame([make("a", 0, None)], SCHEMA)), path, "9")
    counters = assembly.Counters()
    spark.streams.addListener(counters)
    try:
        feed = assembly.count_tracks(
            tracks.track_stream(log.read_log(spark, f"{path}/*", SCHEMA, files_per_trigger=1)).where("icao24 <> 'closing'")
        )
        q = feed.writeStream.option("path", out).option("checkpointLocation", f"{out}-state").trigger(**ONCE).start()
        q.awaitTermination()
        counters.wait(q)
    finally:
        spark.streams.removeListener(counters)
    total = counters.total
    assert (total["rows:read"], total["rows:late"]) == (6, 1)
    assert (total["anomaly:squawk_emergency"], total["anomaly:rapid_descent"]) == (2, 0)
    assert len({b for _, b, _ in counters.batches}) >= 4


def test_scoring_joins_have_time_in_their_key(spark, tmp_path):
    """A forecast is compared with the reports around its due time, not with the whole track; a report
    across the edge of a bucket is found, and a forecast without one comes out once."""
    q = ", ".join(f"0D as {k}_{a}" for k in ("q10", "q50", "q90") for a in ("east_m", "north_m"))
    first = "timestamp'2024-01-01 14:00:00'"
    issued = spark.sql(f"""
        select 'a' as icao24, {first} + make_interval(0, 0, 0, 0, 0, 0, s) as issued_at, 60 as horizon_s,
               'cruise' as phase, 1D as lat0, 1D as lon0, {q}, 0D as pred_east_m, 0D as pred_north_m
        from values (0), (2), (58), (400) as v(s)
        union all select 'closing', timestamp'{CLOSING}', 60, 'cruise', 1D, 1D, {q}, 0D, 0D
    """)
    reports = spark.sql(f"""
        select 'a' as icao24, {first} + make_interval(0, 0, 0, 0, 0, 0, s) as ts, 1D as lat, 1D as lon
        from values (58), (59), (121) as v(s) union all select 'closing', timestamp'{CLOSING}', 1D, 1D
    """)
    issued.write.parquet(str(tmp_path / "p"))
    reports.write.parquet(str(tmp_path / "t"))

    def score(operator, name):
        p, t = (spark.readStream.schema(df.schema).parquet(str(tmp_path / x)) for df, x in ((issued, "p"), (reports, "t")))
        df, out = operator(p, t), str(tmp_path / name)
        writer = df.writeStream.option("path", out).option("checkpointLocation", f"{out}-state")
        q = writer.trigger(**ONCE).start()
        q.awaitTermination()
        text = q._jsq.explainInternal(True)
        keys = text[text.rindex("StreamingSymmetricHashJoin"):].split("]")[0]
        assert "icao24" in keys and "_b" in keys
        rows = spark.read.schema(df.schema).parquet(out).where("icao24 <> 'closing'").collect()
        return sorted(((r.issued_at.minute * 60 + r.issued_at.second, r.truth_ts and r.truth_ts.minute * 60 + r.truth_ts.second) for r in rows))

    assert score(tables.score_stream, "inner") == [(0, 59), (2, 59), (58, 121)]
    assert score(tables.score_forecasts_stream, "outer") == [(0, 59), (2, 59), (58, 121), (400, None)]


def test_scores_keep_their_join_state_on_disk(spark, tmp_path, monkeypatch):
    """The join of the scores holds a whole input at once, so its state is no map on the heap of an executor,
    whatever the session has set; the setting holds for that stream only, and all scores are there."""
    key, heap = "spark.sql.streaming.stateStore.providerClass", ROCKSDB.replace("RocksDB", "HDFSBacked")
    spark.sql("""
        select id as event_id, id % 4 as user_id, timestamp_seconds(1704067200 + id * 60) as ts from range(120)
    """).write.parquet(str(tmp_path / "sf/events.parquet"))
    monkeypatch.setattr(streaming_queries, "scratch_dir", lambda _, label: str(tmp_path / label))
    before = spark.conf.get(key)
    spark.conf.set(key, heap)
    try:
        scores = learning_queries.c9s(spark, str(tmp_path / "sf")).collect()
        assert spark.conf.get(key) == heap
    finally:
        spark.conf.set(key, before)
    state = [p.name for p in (tmp_path / "scores-state/state").rglob("*") if p.is_file() and p.name[0] != "."]
    assert any(x.endswith(".zip") for x in state) and not any(x.endswith((".delta", ".snapshot")) for x in state)

    at = lambda t: int(t.timestamp())
    times = {at(r.ts) for r in fx.kept(spark, str(tmp_path / "sf"), "reports").collect()}
    issued = {(at(r.anchor_ts), r.horizon_s) for r in learning_queries.forecast(spark, str(tmp_path / "sf")).collect()}
    met = {(t, h, t + h) for t, h in issued if t + h in times}
    assert 0 < len(met) < len(issued)
    assert sorted((at(r.issued_at), r.horizon_s, at(r.truth_ts)) for r in scores) == sorted(met)
