from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerotrace.llm.hard_negatives import MultiIndex, hard_negatives
from aerotrace.operators import tracks, windows
from aerotrace.plans import fixtures as fx
from aerotrace.session import configure

SF_DIR = "/root/testdata/sf0.001"


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def mined(rows, anchors, positives=5, negatives=10, scale=256.0):
    """Every pair scored; ``rows`` are ``(id, vector, label)``."""
    fit: dict = {}
    for key, v, label in rows:
        if key is not None and label is not None and good(v):
            fit[key] = min(fit.get(key, (v, label)), (v, label))
    whole = {k: [math.floor(scale * float(np.float64(x))) for x in v] for k, (v, _) in fit.items()}
    out = []
    for a in sorted(set(anchors) & fit.keys()):
        scores = sorted(
            (-sum(x * y for x, y in zip(whole[a], whole[b], strict=True)), b)
            for b in fit if b != a and len(whole[a]) == len(whole[b])
        )
        near = [(k, -s) for s, k in scores if fit[k][1] == fit[a][1]][:positives]
        for p, ps in near:
            hard = [(k, -s) for s, k in scores if fit[k][1] != fit[a][1] and 30 * ps <= -100 * s <= 90 * ps]
            out += [(a, p, i + 1, k, ps, s) for i, (k, s) in enumerate(hard[:negatives])]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 10))
    rows = [
        (i, [float(x) for x in np.float32(centres[i % 5] + rng.normal(scale=0.8, size=10))], f"K{i % 7}") for i in range(240)
    ]
    rows += [(300 + i, rows[10][1], f"K{i % 2}") for i in range(60)]  # equal vectors: ties
    rows += [(400, None, "K1"), (405, [1.0, None] + [0.0] * 8, "K1"), (410, [float("nan")] * 10, "K2")]
    rows += [(415, [0.0] * 10, "K3"), (420, [], "K1"), (425, [1.0, 2.0], "K1"), (426, [1.0, 1.5], "K1"), (427, [1.0, 1.0], "K2")]
    rows += [(430, rows[3][1], None), (None, rows[3][1], "K1"), (5, rows[5][1], "K0"), (10, rows[11][1], "K4")]
    rows += [(435, [2.5], "K1"), (436, [2.0], "K1"), (437, [1.0], "K9")]
    frame = spark.createDataFrame(rows, "flight_id long, embedding array<float>, dest_icao string").selectExpr(
        "*", "'x' AS label", "'y' AS shard", "1 AS dim", "2 AS floor", "3 AS pairs", "4 AS index", "5 AS rank"
    )
    anchors = frame.where("flight_id % 5 = 0")
    got = hard_negatives(configure(spark), frame, anchors.unionByName(anchors), shard_rows=40, block_rows=16, codewords=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, [k for k, *_ in rows if k is not None and k % 5 == 0])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_negatives_of_flights(spark):
    """Profiles of resampled segments, and the destination of the flight they belong to."""
    reports = fx.reports(spark, SF_DIR)
    flights = tracks.flight_rows(tracks.track_states(reports), fx.airports(spark, SF_DIR))
    points = windows.resample(reports, n=16)
    profile = F.transform(
        F.array_sort(F.collect_list(F.struct("k", "alt_ft", "gs_kt"))),
        lambda p: p["alt_ft"] / F.lit(40_000.0) - p["gs_kt"] / F.lit(600.0),
    )
    segments = points.groupBy("icao24", "segment_start").agg(profile.alias("embedding"))
    flown = segments.join(flights, "icao24").select("flight_id", "embedding", F.coalesce("dest_icao", "origin_icao").alias("dest_icao"))
    rows = [tuple(r) for r in flown.collect()]
    got = hard_negatives(configure(spark), flown, flown.select("flight_id"), positives=2, negatives=3)
    want = mined(rows, {r[0] for r in rows}, 2, 3)
    assert sorted(map(tuple, got.collect())) == want and want


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(3 + i) * 2.0**28, -1.0], "A" if i % 2 else "B") for i in range(8)]
    frame = spark.createDataFrame(rows, "flight_id long, embedding array<double>, dest_icao string")
    got = hard_negatives(configure(spark), frame, frame.where("flight_id < 3"), scale=1.0)
    assert sorted(map(tuple, got.collect())) == mined(rows, [0, 1, 2], scale=1.0)


def test_no_flights(spark):
    empty = spark.createDataFrame([], "flight_id string, embedding array<float>, dest_icao string")
    assert hard_negatives(configure(spark), empty, empty).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_cells_come_by_falling_bounds_that_hold(clustered):
    rng = np.random.default_rng(9)
    points = np.floor(256 * rng.normal(size=(3_000, 16)))
    if clustered:
        points = np.floor(points * 0.05 + 500 * rng.normal(size=(20, 16))[rng.integers(0, 20, 3_000)])
    index = MultiIndex(list(range(3_000)), ["K"] * 3_000, points)
    q = points[7]
    seen, before = 0, math.inf
    for bound, cell, upper, lower in index.visits(q):
        scores = index.points[index.start[cell] : index.end[cell]] @ q
        assert bound <= before and scores.max() <= upper <= bound + 1e-3 and lower <= scores.min()
        before, seen = bound, seen + len(scores)
    assert seen == 3_000
    asked = {"rows": 0}
    visits = index.visits
    index.visits = lambda q: (asked.update(rows=asked["rows"] + index.end[c[1]] - index.start[c[1]]) or c for c in visits(q))
    best = index.best(q, "K", True, 7, [(-math.inf, math.inf)], 5)[0]
    scores = sorted((-int(s), i) for i, s in enumerate(points @ q) if i != 7)[:5]
    assert best == [(-s, i) for s, i in scores]
    assert not clustered or asked["rows"] < 1_000  # certified long before the end
