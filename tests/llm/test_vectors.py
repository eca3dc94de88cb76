from __future__ import annotations

import math

import numpy as np
import pytest

from aerotrace.llm.components import connected_components
from aerotrace.llm.near_trajectories import near_trajectories
from aerotrace.llm.trajectory_search import top_trajectories
from aerotrace.session import configure, scratch_dir

SCHEMA = "flight_id long, embedding array<float>, shard string, dim string, rep string, score string, n string"


def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    out = [(i, (centres[i % 6] + rng.normal(scale=0.25, size=12)).tolist()) for i in range(120)]
    out += [(200 + i, out[3][1]) for i in range(9)]  # equal vectors
    out += [(300, [2 * x for x in out[5][1]])]  # equal direction
    out += [(400, None), (401, [0.0] * 12), (402, [1.0, None] + [0.0] * 10), (403, [float("nan")] * 12)]
    out += [(404, [float("inf")] + [1.0] * 11), (405, []), (406, [1.0, 2.0]), (407, [1.0, 2.1])]
    out += [(3, out[3][1]), (None, [1.0] * 12)]  # a repeated row, a row without an id
    return [(k, v, "x", "y", "z", "s", "n") for k, v in out]


def clean(data):
    """One vector per id: the smallest."""
    out = {}
    for key, v, *_ in data:
        if key is not None and v is not None:
            out[key] = min(v, out.get(key, v), key=lambda u: [(x is not None, x if x is None or x == x else math.inf) for x in u])
        elif key is not None:
            out.setdefault(key, None)
    return out


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_links_and_components_equal_brute_force(spark):
    data = rows()
    got = {r["flight_id"]: r for r in near_trajectories(spark, spark.createDataFrame(data, SCHEMA)).collect()}
    vectors = {k: np.float32(v).astype(float) if good(v) else None for k, v in clean(data).items()}
    assert set(got) == set(vectors)
    fit = {k: v for k, v in vectors.items() if v is not None and v.any()}
    links = {k: [] for k in vectors}
    for a, x in fit.items():
        for b, y in fit.items():
            if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].append(b)
                links[b].append(a)
    for k in vectors:
        seen, todo = {k}, [k]
        while todo:
            todo += [x for x in links[todo.pop()] if x not in seen and not seen.add(x)]
        assert (got[k]["n_links"], got[k]["component_id"]) == (len(links[k]), min(seen)), k
        assert got[k]["kept"] == (k == min(seen))


def test_top_k_equals_brute_force_with_ties(spark):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA)
    asked = frame.where("flight_id % 5 = 0")
    got = {}
    for r in top_trajectories(spark, frame, asked, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["flight_id"], r["score"]))
    whole = {k: np.floor(256 * np.float32(v).astype(float)).astype(int) for k, v in clean(data).items() if good(v)}
    for q in (k for k in whole if k % 5 == 0):
        scores = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))
        want = [(i + 1, k, -s) for i, (s, k) in enumerate(scores[:4])]
        assert sorted(got.get(q, [])) == want, q


def test_scores_beyond_doubles_are_exact(spark):
    data = [(i, [float(3 + i) * 2.0**28, -1.0]) for i in range(5)]
    frame = spark.createDataFrame(data, "flight_id long, embedding array<double>")
    got = top_trajectories(spark, frame, frame.where("flight_id = 0"), k=2, scale=1.0).collect()
    assert [(r["flight_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (4, 21 * 2**56 + 1), (3, 18 * 2**56 + 1),
    ]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "flight_id long, embedding array<float>")
    assert near_trajectories(spark, empty).count() == 0
    assert top_trajectories(spark, empty, empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(7, 7), (1, 2), (2, 1)]
    up = {x: x for p in links for x in p}
    for _ in range(300):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = connected_components(spark, spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component_id"] for r in got.collect()} == {x: c for x, c in up.items() if x != c}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_audit_sees_missed_sparse_pairs():
    from aerotrace.llm.near_trajectories import SmallWorld, audited

    rng = np.random.default_rng(11)
    shard, q = rng.normal(size=(1_500, 64)), rng.normal(size=(1_500, 64))
    paired = rng.permutation(1_500)[:20]
    q[paired] = shard[paired[::-1]] + 0.25 * rng.normal(size=(20, 64))
    shard, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (shard, q))
    want = set(zip(*(x.tolist() for x in np.nonzero(q @ shard.T >= 0.9)), strict=True))
    graph = SmallWorld(shard)
    graph.layers[-1][graph.layers[-1] >= 750] = -1  # half of the nodes cannot be reached
    a, b, beam, recall = audited(graph, shard, q, 0.9)
    assert len(want) == 20 and want <= set(zip(a.tolist(), b.tolist(), strict=True))
    assert beam >= len(shard) and recall == 1.0  # the beam that sees every node


@pytest.mark.parametrize("dense", [False, True])
def test_graph_search_of_thousands_finds_the_links(dense):
    """Narrow beams do: the graph is searched, nothing is compared in full."""
    from aerotrace.llm.near_trajectories import SmallWorld, audited

    rng = np.random.default_rng(12)
    shard, q = rng.normal(size=(5_000, 64)), rng.normal(size=(5_000, 64))
    paired = rng.permutation(5_000)[:200]
    q[paired] = shard[paired[::-1]] + 0.3 * rng.normal(size=(200, 64))
    if dense:  # a large group of near copies
        shard[:600] = shard[0] + 0.2 * rng.normal(size=(600, 64))
        q[:600] = shard[0] + 0.2 * rng.normal(size=(600, 64))
    shard, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (shard, q))
    want = q @ shard.T >= 0.9
    a, b, beam, recall = audited(SmallWorld(shard), shard, q, 0.9)
    met = np.zeros_like(want)
    met[a, b] = True
    some = want.any(axis=1)
    assert some.sum() > 150 and beam <= 512 and recall >= 0.995
    assert ((met & want)[some].sum(axis=1) / want[some].sum(axis=1)).mean() >= 0.99


def test_meetings_are_recorded(spark):
    audits = scratch_dir(spark, "audits")
    frame = spark.createDataFrame(rows(), SCHEMA)
    near_trajectories(configure(spark), frame, shard_rows=20, audits=audits).count()
    met = spark.read.parquet(audits).collect()
    assert len(met) >= 21 and min(r["recall"] for r in met) >= 0.9
