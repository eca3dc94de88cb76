"""Registered queries against their SQL at the smallest scale.

All of them with ``ORACLE_ALL=1``; by default one per area, to keep the suite short.
"""

from __future__ import annotations

import os

import pytest
from aerotrace.plans import catalog

from paths import SF_DIR
from oracle_check import compare, connect

SOME = (
    "a1_normalize_reports a10_upsert b1_b2_distance_bearing c1_nearest_airport d1_rollup_15s "
    "d6_dense_grid d9_rotation_edges e7_flight_rows e13_window_features e21_promotion_gate "
    "f4_all_anomalies g1_latest_in_bbox g10_similar h3_queue_wait_closed i3_conflict_probability "
    "j1_eta_features j6_calibration j11_ranking_metrics k3_rollup_stream"
).split()
NAMES = sorted(catalog.ORACLE) if os.environ.get("ORACLE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    result = compare(catalog.QUERIES[name](spark, SF_DIR), con, catalog.ORACLE[name])
    assert result.startswith("ok"), result
