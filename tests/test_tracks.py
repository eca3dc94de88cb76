"""Phase machine, edges and segments: sliced windows against a row-by-row fold."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from aerotrace.operators.tracks import track_states

T0 = dt.datetime(2024, 1, 1, 14, 0, 0)
SCHEMA = (
    "icao24 STRING, ts TIMESTAMP, lat DOUBLE, lon DOUBLE, baro_alt_ft DOUBLE, "
    "vert_rate_fpm DOUBLE, on_ground BOOLEAN"
)


def fold(rows, gap_s):
    """Plain sequential statement of the rules."""
    out, prev = [], None
    edge = None
    for r in rows:
        _, ts, lat, lon, alt, vr, ground = r
        gap = prev is not None and (ts - prev["ts"]).total_seconds() > gap_s
        before = None if prev is None else prev["phase"]
        p = "unknown" if gap or before is None else before
        if ground:
            phase = "ground"
        elif alt is None:
            phase = "unknown"
        elif alt < 3000 and p in ("descent", "approach"):
            phase = "approach"
        elif vr is not None and vr >= 300:
            phase = "climb"
        elif vr is not None and vr <= -300:
            phase = "descent"
        elif alt >= 18000:
            phase = "cruise"
        else:
            phase = p
        up = prev is not None and prev["g"] and not ground
        down = prev is not None and not prev["g"] and ground
        if prev is None or gap:
            seg, pos = ts, 1
        else:
            seg, pos = prev["seg"], prev["pos"] + 1
        out.append((ts, gap, phase, before, up, down, edge, seg, pos))
        if up:
            edge = ("takeoff", ts)
        if down:
            edge = ("landing", ts)
        prev = {"ts": ts, "phase": phase, "g": ground, "seg": seg, "pos": pos}
    return out


def random_tracks(seed, n_keys=12, n=120):
    rng = random.Random(seed)
    rows = {}
    for k in range(n_keys):
        t, track = T0, []
        for _ in range(n):
            t += dt.timedelta(seconds=rng.choice([1, 5, 5, 5, 16, 40, 130, 700]))
            alt = rng.choice([None, 500.0, 1500.0, 2999.0, 3000.0, 5000.0, 17000.0, 18000.0])
            vr = rng.choice([None, 0.0, 0.0, 300.0, -300.0, 299.0, -299.0])
            if rng.random() < 0.5 and alt:
                alt, vr = rng.choice([1500.0, 5000.0]), rng.choice([0.0, -300.0, 300.0])
            g = rng.random() < 0.08
            track.append((f"k{k}", t, 1.0, 2.0, None if g else alt, vr, g))
        rows[f"k{k}"] = track
    return rows


@pytest.mark.parametrize("gap_s,slice_s", [(120, 3600), (120, 60), (15, 20), (15, 3600), (60, 7)])
def test_states_equal_fold(spark, gap_s, slice_s):
    tracks = random_tracks(gap_s + slice_s)
    flat = [r for t in tracks.values() for r in t]
    random.Random(1).shuffle(flat)
    got = {}
    for r in track_states(spark.createDataFrame(flat, SCHEMA), gap_s, slice_s).collect():
        e = None if r.open_edge is None else (r.open_edge.kind, r.open_edge.ts)
        got.setdefault(r.icao24, []).append(
            (r.ts, r.gap, r.phase, r.prev_phase, r.took_off, r.landed, e, r.segment_start,
             r.segment_pos)
        )
    for key, track in tracks.items():
        assert sorted(got[key], key=lambda x: x[0]) == fold(track, gap_s)
