"""Shape of the plans: no cross joins, no Python on the batch path, rank limits before shuffles."""

from __future__ import annotations

import pytest
from aerotrace.functions.quantiles import exact_quantiles
from aerotrace.operators import conflict, evaluation, serving, spatial, tracks, windows
from aerotrace.plans import catalog
from aerotrace.plans import fixtures as fx
from aerotrace.sources import archive

from paths import SF_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def reports(spark):
    return fx.kept(spark, SF_DIR, "reports")


def test_no_nested_loops(spark, reports):
    states = tracks.track_states(reports)
    for df in (
        tracks.flight_rows(states, fx.airports(spark, SF_DIR)),
        spatial.candidate_pairs(conflict.snapshot(reports, (39, 40, -98, -97), "2024-01-01 14:03:20")),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_batch_path_stays_in_the_jvm(reports):
    for df in (tracks.all_anomalies(tracks.track_states(reports)),
               windows.window_features(windows.windows(reports, horizons=(60,)))):
        assert "Python" not in plan(df) and "InPandas" not in plan(df)


def test_rank_is_limited_before_the_shuffle(reports):
    assert "WindowGroupLimit" in plan(windows.latest_window(reports))
    assert "WindowGroupLimit" in plan(serving.tracks(reports, "2024-01-01", "2024-01-02", 10))


def test_point_filters_reach_the_scan(spark, reports):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(serving.track(reports, "00000e", "2024-01-01 14:00:00", "2024-01-01 14:10:00"))
    assert "EqualTo(icao24,00000e)" in text and "GreaterThanOrEqual(ts," in text
    assert "squawk" not in text.split("ReadSchema:")[1]


@pytest.mark.parametrize("read", [
    lambda df: serving.latest_in_bbox(df, (39, 40, -98, -97), "2024-01-01 14:03:20"),
    lambda df: serving.latest_in_cells(df, ["130:-327"], "2024-01-01 14:03:20"),
    lambda df: serving.state_as_of(df, "2024-01-01 14:03:20"),
    lambda df: serving.anomaly_feed(df.withColumn("kind", df.squawk), "2024-01-01 15:00:00"),
    lambda df: conflict.snapshot(df, (39, 40, -98, -97), "2024-01-01 14:03:20"),
])
def test_archive_folders_are_skipped(spark, reports, tmp_path, read):
    archive.write_archive(spatial.with_cell(reports), str(tmp_path / "a"))
    text = plan(read(archive.read_archive(spark, str(tmp_path / "a"))))
    bounds = text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "dt#" in bounds and "hour#" in bounds


def test_no_horizon_phase_or_rule_is_empty(spark):
    """The derived data must reach every branch, or equal results prove little."""
    sf = "/root/testdata/sf0.01"
    reports = fx.kept(spark, sf, "reports")
    states = tracks.track_states(reports)
    phases = {r.phase for r in states.select("phase").distinct().collect()}
    assert {"climb", "cruise", "descent", "approach"} <= phases
    targets = windows.nearest_in_time(reports, windows.HORIZONS_S).where("target_ts is not null")
    assert {r.horizon_s for r in targets.select("horizon_s").distinct().collect()} == set(windows.HORIZONS_S)
    assert windows.resample(reports, 128).count() > 0 and tracks.holding(reports).count() > 0
    kinds = {r.kind for r in tracks.all_anomalies(states).select("kind").distinct().collect()}
    assert kinds == {"go_around", "rapid_descent", "squawk_emergency"}


def test_every_query_is_registered_once():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 90


def _forecasts(spark, tmp_path):
    """Forecasts stored in files so small that Spark would send them to every executor."""
    q = ", ".join(f"1D as {k}_{a}" for k in evaluation.QUANTILE_PROBS for a in ("east_m", "north_m"))
    spark.sql(f"""
        select 'a' as icao24, timestamp'2024-01-01 14:00:00' as issued_at, 60 as horizon_s, 'cruise' as phase,
               1D as lat0, 1D as lon0, cast(id as double) as v, {q} from range(1000)
    """).write.parquet(str(tmp_path / "f"))
    return spark.read.parquet(str(tmp_path / "f"))


def test_quantiles_send_groups_around_not_values(spark, tmp_path):
    df = _forecasts(spark, tmp_path)
    text = plan(exact_quantiles(df, ["horizon_s", "phase"], "v", {"m": 0.5}))
    assert "BuildRight" in text and "BuildLeft" not in text


def test_forecasts_and_reports_are_not_broadcast(spark, reports, tmp_path):
    text = plan(evaluation.score_predictions(_forecasts(spark, tmp_path), reports))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
