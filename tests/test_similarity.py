"""Similar trajectories of many queries against a plain computation."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
from aerotrace.operators import similarity
from aerotrace.session import configure

SCHEMA = "flight_id long, embedding array<float>"


def data(n=400, dim=12):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, dim))
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + 0.3 * rng.normal(size=dim))]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # equal vectors: ties
    rows += [(900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, []), (904, [1.0, None]), (None, rows[0][1])]
    return rows + [(905, [1.0, 2.0]), (906, [2.0, 1.0])]


def nearest(rows, queries, k):
    fit = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and None not in v}
    fit = {i: v / np.linalg.norm(v) for i, v in fit.items() if np.isfinite(v).all() and v.any()}
    out = []
    for q in queries & fit.keys():
        found = sorted(
            (-round(float(fit[q] @ v), 9), i) for i, v in fit.items() if i != q and len(v) == len(fit[q])
        )[:k]
        out += [(q, r + 1, i, -c) for r, (c, i) in enumerate(found)]
    return sorted(out)


def close(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(a[3], b[3], abs_tol=2e-9) for a, b in zip(got, want, strict=True))


def test_blocks_give_the_exact_neighbours(spark):
    rows = data()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = similarity.similar(configure(spark), frame, frame.where("flight_id % 5 = 0"), 6, block_rows=50, query_rows=16)
    close(sorted(map(tuple, got.collect())), nearest(rows, {i for i, _ in rows if i is not None and i % 5 == 0}, 6))


def test_lists_find_neighbours_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_ROWS", 8)
    rows = data()
    frame = spark.createDataFrame(rows, SCHEMA)
    index = similarity.build_lists(configure(spark), frame, lists=16, dim=12, k=5, block_rows=20)
    assert index.rows.count() == 430 and index.probes < 16
    queries = frame.where("flight_id % 5 = 0")
    got = {tuple(r)[::2] for r in similarity.similar_by_lists(spark, index, queries, 5).collect()}
    want = {r[::2] for r in nearest(rows, {i for i, _ in rows if i is not None and i % 5 == 0 and i < 900}, 5)}
    assert len(got & want) >= 0.9 * len(want)
    every = similarity.similar_by_lists(spark, index, queries, 5, probes=16).collect()
    close(sorted(map(tuple, every)), nearest(rows, {i for i, _ in rows if i is not None and i % 5 == 0 and i < 900}, 5))


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similarity.similar(configure(spark), empty, empty).count() == 0
    index = similarity.build_lists(spark, empty)
    assert similarity.similar_by_lists(spark, index, empty).count() == 0


def test_a_block_is_multiplied_in_strips():
    rng = np.random.default_rng(5)
    schema = pa.schema([("flight_id", pa.int64()), ("unit", pa.list_(pa.float64()))])

    def table(n):
        return pa.table([pa.array(range(n)), pa.array(list(rng.normal(size=(n, 4))))], schema=schema)

    queries, candidates = table(600), table(4_000)
    tracemalloc.start()
    found = similarity._nearest(3)(queries, candidates)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 3 * len(queries)
    assert peak < 600 * 4_000 * 8  # all products at once
    products = np.array(queries["unit"].to_pylist()) @ np.array(candidates["unit"].to_pylist()).T
    np.fill_diagonal(products, -np.inf)
    assert found["flight_id"].to_pylist()[::3] == products.argmax(axis=1).tolist()
