"""Operators on hand-made rows, and against plain Python where the rule is sequential."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from aerotrace.functions import clock, geo
from aerotrace.functions.draws import hash_uniforms, triangular
from aerotrace.functions.quantiles import exact_quantiles
from aerotrace.operators import (
    capacity,
    evaluation,
    ingest,
    learning,
    sampling,
    schedule,
    serving,
    spatial,
    tracks,
    windows,
)
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1, 14, 0, 0)


def at(s: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=s)


# --- scalar functions ---------------------------------------------------------------------------


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-80, 80), st.floats(-179, 179)), min_size=5, max_size=20))
def test_geodesy_properties(spark, points):
    df = spark.createDataFrame([(a, b, a * 0.9, b * 0.9) for a, b in points], "a double, b double, c double, d double")
    rows = df.select(
        geo.haversine_m("a", "b", "c", "d").alias("there"),
        geo.haversine_m("c", "d", "a", "b").alias("back"),
        geo.bearing_deg("a", "b", "c", "d").alias("bearing"),
        geo.haversine_m("a", "b", geo.destination_lat("a", "b", F.lit(45.0), F.lit(1e4)),
                        geo.destination_lon("a", "b", F.lit(45.0), F.lit(1e4))).alias("moved"),
        (geo.from_enu_lat(F.lit(500.0), F.lit(800.0), "a", "b")).alias("lat"),
        geo.enu_north(geo.from_enu_lat(F.lit(500.0), F.lit(800.0), "a", "b"), "b", "a", "b").alias("n"),
    ).collect()
    for r in rows:
        assert r.there == pytest.approx(r.back, abs=1e-5)
        assert 0 <= r.bearing < 360
        assert r.moved == pytest.approx(1e4, abs=0.01)
        assert r.n == pytest.approx(800.0, abs=1e-3)


def test_bbox_rejects_inverted():
    with pytest.raises(ValueError):
        geo.check_bbox((2, 1, 0, 1))


def test_time_of_day(spark):
    rows = spark.createDataFrame([("5",), ("905",), ("2400",), (None,)], "t string").select(
        clock.hhmm_hour("t").alias("h"),
        clock.hhmm_minutes("t").alias("m"),
        clock.hhmm_minutes("t", nulls="zero").alias("z"),
    ).collect()
    assert [tuple(r) for r in rows] == [(0, 5, 5), (9, 545, 545), (0, 1440, 1440), (None, None, 0)]


def test_triangular_stays_in_bounds(spark):
    (u,) = hash_uniforms(7, "id")
    r = spark.range(2000).select(
        triangular(u, F.lit(-3.0), F.lit(1.0), F.lit(2.0)).alias("x"),
        triangular(u, F.lit(4.0), F.lit(4.0), F.lit(4.0)).alias("point"),
    ).agg(F.min("x"), F.max("x"), F.avg("x"), F.min("point"), F.max("point")).first()
    assert -3 <= r[0] and r[1] <= 2
    assert r[2] == pytest.approx(0.0, abs=0.1)  # mean of the triangle
    assert r[3] == r[4] == 4.0


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=5000), "b": np.round(rng.normal(size=900), 1), "c": np.array([2.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    probs = {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "hi": 1.0}
    for r in exact_quantiles(df, ["k"], "v", probs, accuracy).collect():
        assert r.n == len(groups[r.k])
        for name, q in probs.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.k], q), abs=1e-12)
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median(np.concatenate(list(groups.values()))))


# --- ingest -------------------------------------------------------------------------------------


def test_normalise_and_reject(spark):
    raw = [
        '{"hex":" A1B2C3 ","lat":40.0,"lon":-90.0,"alt_baro":35000,"gs":450.5,"seen_pos":2.5,"squawk":"1200"}',
        '{"hex":"abc123","lat":"41","lon":-91,"alt_baro":"ground","gs":"n/a"}',
        '{"hex":"abc124","lon":-91}',
        '{"hex":"~abc12","lat":41,"lon":-91}',
        '{"hex":"abcdef12","lat":41,"lon":-91}',
        '{"hex":"abc125","lat":99,"lon":-91}',
        '{"lat":41,"lon":-91}',
    ]
    df = spark.createDataFrame([(i, r, T0) for i, r in enumerate(raw)], "seq int, value string, received_at timestamp")
    good, bad = ingest.split_valid(ingest.parse_reports(df))
    rows = {r.seq: r for r in good.collect()}
    assert sorted(rows) == [0, 1]
    assert rows[0].icao24 == "a1b2c3" and rows[0].ts == at(-2.5) and rows[0].baro_alt_ft == 35000.0
    assert rows[1].on_ground and rows[1].baro_alt_ft is None and rows[1].velocity_kt is None
    assert {r.seq: r.reason for r in bad.collect()} == {
        2: "no_position", 3: "not_icao", 4: "bad_hex", 5: "lat_range", 6: "no_hex"
    }


def test_upsert_and_latest(spark):
    s = "icao24 string, ts timestamp, baro_alt_ft double, seq long"
    old = spark.createDataFrame([("a", at(0), 1.0, 1), ("b", at(0), 2.0, 2)], s)
    new = spark.createDataFrame([("a", at(0), 9.0, 3), ("a", at(5), 3.0, 4)], s)
    rows = {(r.icao24, r.ts): r.baro_alt_ft for r in ingest.upsert(old, new).collect()}
    assert rows == {("a", at(0)): 9.0, ("b", at(0)): 2.0, ("a", at(5)): 3.0}
    tie = spark.createDataFrame([("a", at(0), 1.0, 2), ("a", at(0), 7.0, 1)], s)
    assert ingest.dedupe_latest(tie).first().baro_alt_ft == 7.0


# --- tracks -------------------------------------------------------------------------------------

REPORT = "icao24 string, ts timestamp, lat double, lon double, baro_alt_ft double, vert_rate_fpm double, on_ground boolean, squawk string"


def leg(spark, *points):
    rows = [("a", at(s), 40.0, -90.0, None if g else 5000.0, 0.0, g, None) for s, g in points]
    return tracks.track_states(spark.createDataFrame(rows, REPORT), slice_s=60)


def test_leg_pairing(spark):
    ok = tracks.pair_legs(leg(spark, (0, True), (10, False), (400, False), (700, True))).collect()
    assert [(r.outcome, r.dep_ts, r.arr_ts) for r in ok] == [("closed", at(10), at(700))]
    first = tracks.pair_legs(leg(spark, (0, False), (10, True))).collect()
    assert [(r.outcome, r.dep_ts) for r in first] == [("rejected", None)]
    short = tracks.pair_legs(leg(spark, (0, True), (10, False), (60, True))).collect()
    assert [r.outcome for r in short] == ["rejected"]
    edge = tracks.pair_legs(leg(spark, (0, True), (10, False), (130, True))).collect()
    assert [r.outcome for r in edge] == ["closed"]


def test_rejected_leg_stays_airborne(spark):
    airports = spark.createDataFrame([("KAAA", 40.01, -90.0), ("KBBB", 41.0, -90.0)], "icao string, lat double, lon double")
    rows = tracks.flight_rows(leg(spark, (0, True), (10, False), (60, True)), airports).collect()
    assert [(r.status, r.origin_icao, r.dest_icao) for r in rows] == [("airborne", "KAAA", None)]


def test_rules(spark):
    rows = [
        ("a", at(0), 40.0, -90.0, 9000.0, -4000.0, False, "7700"),
        ("b", at(0), 40.0, -90.0, 10001.0, -9000.0, False, "1200"),
        ("c", at(0), 40.0, -90.0, None, -9000.0, True, None),
    ]
    hits = tracks.all_anomalies(tracks.track_states(spark.createDataFrame(rows, REPORT))).collect()
    assert sorted((h.icao24, h.kind) for h in hits) == [("a", "rapid_descent"), ("a", "squawk_emergency")]


def test_go_around_after_gap(spark):
    rows = [
        ("a", at(0), 40.0, -90.0, 4000.0, -800.0, False, None),
        ("a", at(5), 40.0, -90.0, 2000.0, -800.0, False, None),
        ("a", at(200), 40.0, -90.0, 2000.0, 800.0, False, None),
    ]
    states = tracks.track_states(spark.createDataFrame(rows, REPORT))
    assert [r.ts for r in tracks.go_around(states).collect()] == [at(200)]


@pytest.mark.parametrize("slice_s", [7, 40, 3600])
def test_sampling_equals_walk(spark, slice_s):
    rng = random.Random(slice_s)
    rows, want = [], set()
    for k in ("a", "b", "c"):
        t, last = 0.0, None
        for _ in range(300):
            t += rng.choice([1, 2, 5, 5, 5, 16, 90])
            phase = "cruise" if rng.random() < 0.93 else "climb"
            rows.append((k, at(t), phase))
            if phase != "cruise" or last is None or t - last >= 15:
                want.add((k, at(t)))
                last = t
    df = spark.createDataFrame(rows, "icao24 string, ts timestamp, phase string")
    got = {(r.icao24, r.ts) for r in sampling.adaptive_sample(df, 15, slice_s).collect()}
    assert got == want


def test_sampling_hands_many_slices_to_python_at_once(spark):
    rows = [("a", at(5 * i), "cruise") for i in range(40)]
    rows += [("a", at(5 * i), "cruise" if i % 2 else None) for i in (7, 8, 9)]  # one time, two phases
    rows += [(None, at(0), "cruise"), ("b", None, "cruise")]
    sampled = sampling.adaptive_sample(spark.createDataFrame(rows, "icao24 string, ts timestamp, phase string"), 15, 35)
    want, last = [], None
    for i in range(40):
        if last is None or i == 8 or 5 * (i - last) >= 15:
            want += [at(5 * i)] * (2 if i in (7, 8, 9) else 1)
            last = i
    assert sorted(r.ts for r in sampled.collect()) == want
    plan = sampled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1  # only the summaries of an aircraft are a group


def test_models_are_fitted_on_rows_dealt_evenly(spark, monkeypatch):
    given = {}

    class Recorded(learning.Pipeline):
        def fit(self, data):
            given["sizes"] = data.rdd.glom().map(len).collect()

    monkeypatch.setattr(learning, "Pipeline", Recorded)
    cols = [f"cast(id % {i + 2} AS {'string' if c in learning.CATEGORICAL else 'double'}) AS {c}"
            for i, c in enumerate((*schedule.ETA_FEATURES, schedule.ETA_TARGET))]
    table = spark.range(0, 1_000, 1, 1).selectExpr(*cols)  # one file
    learning.fit_eta(table, table.limit(10))
    assert sum(given["sizes"]) == 1_010 and max(given["sizes"]) < 1_010 / 2


def test_holding(spark):
    rows = [("a", at(5 * i), float(i * 30 % 360)) for i in range(30)] + [
        ("b", at(5 * i), float(90 + 10 * (i % 2))) for i in range(30)
    ]
    df = spark.createDataFrame(rows, "icao24 string, ts timestamp, heading_deg double")
    got = tracks.holding(df, slice_s=35).collect()
    assert [(r.icao24, r.turn_deg) for r in got] == [("a", 870.0)]


# --- spatial and serving ------------------------------------------------------------------------


def test_nearest_airport_radius_and_box(spark):
    airports = spark.createDataFrame([("KA", 40.0, -90.0), ("KB", 40.1, -90.0)], "icao string, lat double, lon double")
    points = spark.createDataFrame([(1, 40.04, -90.0), (2, 40.05, -90.0), (3, 45.0, -90.0)], "id int, lat double, lon double")
    got = {r.id: r.airport for r in spatial.nearest_airport(points, airports).collect()}
    assert got[1] == "KA" and got[3] is None and got[2] in ("KA", "KB")


def test_candidate_pairs(spark):
    rows = [("a", 40.0, -90.0, 30000.0), ("b", 40.1, -90.1, 32000.0), ("c", 40.1, -90.1, 32001.0), ("d", 45.0, -90.0, 30000.0)]
    df = spark.createDataFrame(rows, "icao24 string, lat double, lon double, alt_ft double")
    got = {(r.icao24_a, r.icao24_b) for r in spatial.candidate_pairs(df).collect()}
    assert got == {("a", "b"), ("b", "c")}


def test_stale_in_box_row_is_kept(spark):
    cols = "icao24 string, ts timestamp, lat double, lon double, baro_alt_ft double, velocity_kt double, heading_deg double, vert_rate_fpm double, on_ground boolean"
    rows = [("a", at(0), 40.0, -90.0, *[1.0] * 4, False), ("a", at(60), 50.0, -90.0, *[1.0] * 4, False), ("b", at(-200), 40.0, -90.0, *[1.0] * 4, False)]
    got = serving.latest_in_bbox(spark.createDataFrame(rows, cols), (39, 41, -91, -89), at(90)).collect()
    assert [(r.icao24, r.ts) for r in got] == [("a", at(0))]


def test_subscription_cap():
    assert spatial.subscription(["a", "b", "a", "c"], 2) == ["a", "b"]


# --- schedule -----------------------------------------------------------------------------------


def test_congestion_blocks_at_their_borders(spark):
    """Half-hour blocks of the planned arrival: borders, midnight as 0 and 2400, a missing time."""
    d = dt.date(2024, 3, 9)
    times = ["0", "29", "30", "0059", "2359", "2330", "2400", None, "1"]
    rows = [(d, "PDX", t) for t in times] + [(d, "SEA", "15")]
    df = spark.createDataFrame(rows, "flight_date date, dest string, crs_arr_hhmm string")
    got = {(r.dest, r.crs_arr_hhmm): r.dest_sched_arrivals_30min for r in schedule.dest_congestion(df).collect()}
    early, next_, late = {"0", "29", "1"}, {"30", "0059"}, {"2359", "2330"}
    for group in (early, next_, late):
        for t in group:
            assert got["PDX", t] >= len(group) - 1, t
    assert got["PDX", "30"] == got["PDX", "0059"] == 1
    assert got["SEA", "15"] == 0


def test_medians_skip_missing_and_unseen(spark):
    """A carrier without a value, an even group, ties, an airport that was never seen."""
    rows = [("PDX", "AS", 7.0), ("PDX", "AS", None), ("PDX", "AS", 9.0), ("PDX", "AS", 9.0), ("PDX", "QX", None),
            ("GEG", "QX", 3.0), ("GEG", "QX", 4.0)]
    train = spark.createDataFrame(rows, "dest string, carrier string, taxi_in_min double")
    asked = [("PDX", "AS"), ("PDX", "QX"), ("GEG", "QX"), ("GEG", "AS"), ("BOI", "AS"), ("PDX", None)]
    got = schedule.lookup_fallback(
        spark.createDataFrame(asked, "dest string, carrier string"), schedule.taxi_in_medians(train), "m"
    )
    found = {(r.dest, r.carrier): r.m for r in got.collect()}
    assert found["PDX", "AS"] == 9.0 and found["GEG", "QX"] == 3.5
    assert found["PDX", "QX"] == 9.0 and found["GEG", "AS"] == 3.5 and found["PDX", None] == 9.0
    assert found["BOI", "AS"] == 7.0


def test_rotation_edges_equal_a_sequential_pass(spark):
    rng = random.Random(6)
    ports, rows = ["AAA", "BBB", "CCC"], []
    for k in range(300):
        rows.append((f"N{k % 7}" if k % 11 else None, dt.date(2024, 1, 1 + rng.randrange(9)), f"{rng.randrange(24) * 100}",
                     "0", "X", str(k), rng.choice(ports), rng.choice(ports)))
    names = "tail_number string, flight_date date, crs_dep_hhmm string, crs_arr_hhmm string, carrier string, flight_number string, origin string, dest string"
    counts, last = {}, {}
    for tail, day, dep, _, _, number, origin, dest in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1], int(r[2]) // 100, r[4], r[5], r[6], r[7])):
        if last.get(tail) == origin:
            counts[origin, dest] = counts.get((origin, dest), 0) + 1
        last[tail] = dest
    got = {(r.src, r.dst): r.n for r in schedule.rotation_edges(spark.createDataFrame(rows, names)).collect()}
    assert got == counts


def serve(times, closure, s=1.5):
    """One runway, flights in order; ``closure`` = (from, to) or None."""
    free, waits = 0.0, []
    for a in times:
        start = max(a, free)
        if closure and start < closure[1] and start + s > closure[0]:
            start = closure[1]
        waits.append(start - a)
        free = start + s
    return waits


@pytest.mark.parametrize("seed", [1, 2])
def test_queue_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows, closures, want = [], [], {}
    for i in range(30):
        port = f"K{i:03d}"
        times = sorted(rng.randrange(0, 240) for _ in range(rng.choice([1, 5, 60, 150])))
        cs, ln = float(rng.randrange(0, 240)), float(rng.choice([1, 2, 30, 90]))
        closures.append((port, cs, ln))
        base, shut = serve(times, None), serve(times, (cs, cs + ln))
        for k, t in enumerate(times):
            rows.append((port, dt.date(2024, 1, 1), t, f"AA{k:04d}_x", "departure"))
            want[port, k + 1] = (base[k], shut[k])
    demand = spark.createDataFrame(rows, "airport string, day date, scheduled_minute int, flight_id string, operation string")
    shut = spark.createDataFrame(closures, "airport string, closed_from double, closed_for double")
    got = {(r.airport, r.queue_pos): (r.baseline_wait_min, r.scenario_wait_min)
           for r in capacity.queue_waits(demand, shut).collect()}
    assert got == want


# --- windows and evaluation ---------------------------------------------------------------------


def test_window_kinematics_and_slices(spark):
    rows = [("a", at(5 * i), 40.0 + 0.001 * i, -90.0, 1000.0 * i if i != 3 else None, None, (350.0 + 5 * i) % 360, False) for i in range(40)]
    df = spark.createDataFrame(rows, "icao24 string, ts timestamp, lat double, lon double, baro_alt_ft double, vert_rate_fpm double, heading_deg double, on_ground boolean")
    got = {}
    for s in (60, 165, 3600):
        w = windows.window_features(windows.windows(df, horizons=(60,), slice_s=s))
        got[s] = sorted(map(str, w.collect()))
    assert got[60] == got[165] == got[3600] and len(got[60]) == 8
    first = w.orderBy("anchor_ts").first()
    step = first.steps[0]
    assert step.north_m == pytest.approx(math.radians(0.001) * geo.EARTH_RADIUS_M, rel=1e-9)
    assert step.vrate_fpm == pytest.approx(12000.0) and step.turn_deg_s == pytest.approx(1.0)
    assert first.steps[2].alt_delta_ft == 0.0 and first.steps[3].alt_delta_ft == 0.0
    assert first.targets[0].ms == int((at(115) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


def test_targets_at_ties_borders_and_gaps(spark):
    """Of two reports equally far the earlier, of one millisecond the first; none across a gap."""
    seconds = [0, 8, 12, 20, 20.0002, 40, 70]
    rows = [("a", T0 + dt.timedelta(seconds=x), float(i), 0.0, 1.0 * i, 0.0, 0.0, False) for i, x in enumerate(seconds)]
    df = spark.createDataFrame(rows, "icao24 string, ts timestamp, lat double, lon double, baro_alt_ft double, vert_rate_fpm double, heading_deg double, on_ground boolean")
    for s in (10, 3600):
        near = windows.nearest_in_time(df, (10, 20), 2, gap_s=25, slice_s=s)
        got = {(r.anchor_ts, r.horizon_s): r.lat for r in near.collect()}
        place = lambda i, h: got[rows[i][1], h]
        assert place(0, 10) == 1.0 and place(0, 20) == 3.0 and place(1, 10) == 3.0
        assert place(3, 20) == 5.0 and place(2, 20) is None
        assert place(5, 20) is None and place(6, 10) is None


def test_resample_equals_interp(spark):
    rng = random.Random(5)
    t, rows = 0.0, []
    for _ in range(60):
        t += rng.choice([1, 5, 7, 14])
        rows.append(("a", at(t), 40 + rng.random() / 10, -90 + rng.random() / 10, rng.choice([None, 1e4 * rng.random()]), 400 * rng.random(), 0.0, False))
    df = spark.createDataFrame(rows, "icao24 string, ts timestamp, lat double, lon double, baro_alt_ft double, velocity_kt double, vert_rate_fpm double, on_ground boolean")
    ts = np.array([(r[1] - T0).total_seconds() for r in rows])
    grid = np.linspace(ts[0], ts[-1], 33)
    for s in (20, 3600):
        got = windows.resample(df, 33, slice_s=s).orderBy("k").collect()
        assert [r.k for r in got] == list(range(33))
        assert np.allclose([r.alt_ft for r in got], np.interp(grid, ts, [r[4] or 0.0 for r in rows]))
        assert np.allclose([r.gs_kt for r in got], np.interp(grid, ts, [r[5] for r in rows]))


def test_split_rejects_bad_fractions(spark):
    with pytest.raises(ValueError):
        evaluation.chronological_split(spark.range(1), "id", 0.9, 0.2)


def test_promotion(spark):
    rows = [("eta", at(0), 1, 5.0), ("eta", at(1), 2, 4.0), ("eta", at(2), 3, 4.5), ("eta", at(3), 4, 4.0), ("net", at(4), 5, 9.0)]
    df = spark.createDataFrame(rows, "kind string, trained_at timestamp, version long, metric double")
    for s in (1, 86_400):
        got = {r.version: r.promoted for r in evaluation.promotion_gate(df, s).collect()}
        assert got == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert [(r.kind, r.version) for r in evaluation.scorecard(df).collect()] == [("eta", 2), ("net", 5)]


def test_ranking_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False)], "score double, label boolean")
    r = evaluation.ranking_metrics(df).first()
    assert r.pr_auc is None and r.precision_at_k is None


# --- cases at the borders -----------------------------------------------------------------------


def test_equal_points_stay_rows_and_the_date_line_is_no_border(spark):
    points = spark.createDataFrame([(0.1, 179.99), (0.1, 179.99), (0.1, 0.0)], "lat double, lon double")
    ports = spark.createDataFrame([("AAAA", 0.1, -179.98), ("BBBB", 0.15, 179.5)], "icao string, lat double, lon double")
    got = sorted(spatial.nearest_airport(points, ports).collect())
    assert [(r.lon, r.airport) for r in got] == [(0.0, None), (179.99, "AAAA"), (179.99, "AAAA")]
    craft = spark.createDataFrame(
        [("a", 10.0, 179.99, 30000.0), ("b", 10.0, -179.99, 30500.0), ("c", 10.0, 0.0, 30000.0)],
        "icao24 string, lat double, lon double, alt_ft double",
    )
    pairs = spatial.candidate_pairs(craft).collect()
    assert [(r.icao24_a, r.icao24_b) for r in pairs] == [("a", "b")]
    with pytest.raises(ValueError):
        geo.cell_column("lon", 0.7)


def test_rows_without_a_time_have_no_fold(spark):
    rows = spark.createDataFrame([(at(s),) for s in range(0, 100, 10)] + [(None,)], "ts timestamp")
    folds = {r.ts: r.fold for r in evaluation.chronological_split(rows, "ts").collect()}
    assert folds[None] is None and folds[at(90)] == "test" and folds[at(0)] == "train"
    grid = spark.createDataFrame([(b,) for b in range(20)] + [(None,)], "bucket long")
    assert evaluation.bucket_split(grid).where("bucket is null").first().fold is None


def test_unseen_phase_takes_the_pooled_quantiles(spark):
    cols = "horizon_s int, phase string, " + ", ".join(f"pred_{a} double, y_{a} double" for a in evaluation.AXES)
    train = [(60, p, *[v for _ in evaluation.AXES for v in (0.0, float(k))]) for p in ("climb", "cruise") for k in range(11)]
    model = evaluation.quantile_model(spark.createDataFrame(train, cols))
    asked = [(60, "climb"), (60, "descent"), (300, "climb")]
    points = spark.createDataFrame([(h, p, *[0.0] * 6) for h, p in asked], cols)
    got = {(r.horizon_s, r.phase): (r.q10_east_m, r.q90_east_m) for r in evaluation.apply_quantiles(points, model).collect()}
    assert got[60, "climb"] == got[60, "descent"] == (1.0, 9.0)
    assert got[300, "climb"] == (None, None)


def test_months_with_other_headers_are_refused(spark, tmp_path):
    from aerotrace.schemas import ONTIME_COLUMNS
    from aerotrace.sources import readers

    names = [c for c, _, _ in ONTIME_COLUMNS]
    other = [*names[:4], names[5], names[4], *names[6:]]
    for i, header in enumerate((names, other)):
        (tmp_path / f"{i}.csv").write_text(",".join(header) + "\n" + ",".join(["2024-01-01"] * len(header)) + "\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        readers.read_ontime(spark, [str(tmp_path / "0.csv"), str(tmp_path / "1.csv")]).collect()


def test_cells_of_any_number_and_no_default_limits(spark):
    rows = spark.createDataFrame([(f"a{i}", f"{i}:0") for i in range(900)], "icao24 string, cell string")
    cells = [f"{i}:0" for i in range(700)]
    assert spatial.in_cells(rows, cells).count() == 700
    assert spatial.in_cells(rows, spark.createDataFrame([(c,) for c in cells], "cell string")).count() == 700
