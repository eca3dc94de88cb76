from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from aerotrace.llm.feed_mix import mix_feeds
from aerotrace.llm.placement import Tree, place_flights
from brute import fill_targets

TRACKS = "flight_id long, source string, n_reports long, key string, range string, budget string, weight string"


def tracks():
    sizes = {"b": [5, 1, 0, 7], "a": [3] * 40, None: [2, 9, 4], "ä": [100], "empty": [0, None], "z": [1] * 7}
    rows, k = [], 0
    for source, values in sizes.items():
        for v in values:
            rows.append((k, source, v, "c", "c", "c", "c"))
            k += 1
    return rows + [rows[0], (None, "a", 3, "c", "c", "c", "c")]


@pytest.mark.parametrize("range_rows", [50_000, 5])
def test_mix_meets_its_targets(spark, range_rows):
    rows = tracks()
    got = mix_feeds(spark, spark.createDataFrame(rows, TRACKS), range_rows=range_rows).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, source, n, *_ in rows:
        sizes[source] += n or 0
    target, taken = fill_targets(dict(sizes), (3, 1, 2), 1.5, 2), defaultdict(int)
    cut = defaultdict(int)
    for r in got:
        assert r["source_reports"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["n_reports"]
        taken[r["source"]] += r["taken"]
        cut[r["source"]] += r["n_reports"] > 0 and r["taken"] % r["n_reports"] != 0
    assert all(taken[s] == int(target[s] + 1e-9) for s in sizes)
    assert max(cut.values()) <= 1
    again = mix_feeds(spark, spark.createDataFrame(rows, TRACKS).repartition(7), range_rows=11).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(spark):
    assert mix_feeds(spark, spark.createDataFrame([], TRACKS)).count() == 0
    nothing = spark.createDataFrame([(1, "a", None), (2, None, 0)], "flight_id long, source string, n_reports long")
    assert {(r["target"], r["taken"]) for r in mix_feeds(spark, nothing).collect()} == {(0.0, 0)}


FLIGHTS = "flight_id long, payload string, size string, shard string, slot string"


def placed(spark, rows, **more):
    return place_flights(spark.createDataFrame(rows, FLIGHTS), **more).collect()


def test_placement_slots_sizes_and_growth(spark):
    rows = [(i, f"text {i % 9} é" * (i % 5), "c", "c", "c") for i in range(4000)]
    rows += [(1, "text", "c", "c", "c"), (1, "text", "c", "c", "c"), (None, None, "c", "c", "c"), (5, None, "c", "c", "c")]
    got = placed(spark, rows, slice_rows=100)
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.5 * len(rows) / 24
    moved = sum(r["grown_shard"] == 24 for r in got)
    assert 0.5 / 25 < moved / len(rows) < 2 / 25
    want = sorted((k if k is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    assert sorted((r["flight_id"] if r["flight_id"] is not None else -1, r["size"], r["payload_crc32"]) for r in got) == want
    by_id = {r["flight_id"]: r["shard"] for r in got}
    assert len({(r["flight_id"], r["shard"]) for r in got}) == len(by_id)
    one_more = {r["flight_id"]: r["shard"] for r in placed(spark, rows, shards=25)}
    assert one_more == {r["flight_id"]: r["grown_shard"] for r in got}


def test_changed_weights_move_rows_only_towards_them(spark):
    rows = [(i, "t", "c", "c", "c") for i in range(3000)]
    before = {r["flight_id"]: r["shard"] for r in placed(spark, rows)}
    heavy = Tree(24, weights=((7, 3.0),))
    after = {r["flight_id"]: r["shard"] for r in placed(spark, rows, tree=heavy)}
    region, rack = heavy.path(7)
    for k, shard in after.items():
        if shard != before[k]:  # into the subtree of the heavier shard, or within it
            assert heavy.path(shard)[0] == region
            assert heavy.path(before[k])[0] != region or heavy.path(shard)[1] == rack
    assert sum(s == 7 for s in after.values()) > 1.8 * sum(s == 7 for s in before.values())


def test_placement_of_nothing(spark):
    assert placed(spark, []) == []
