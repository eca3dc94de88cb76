"""Near-duplicate trajectories by cosine: navigable small-world graphs per shard, links, components."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from aerotrace.llm.components import connected_components
from aerotrace.llm.files import read_bytes, written
from aerotrace.llm.vectors import matrix, one_per_id, shard_count, usable
from aerotrace.session import scratch_dir, stored

THRESHOLD = 0.9
SHARD_ROWS = 16_384
MIN_SHARDS = 8
DEGREE = 12
BUILD_BEAM = 48
BEAM = 32
AUDIT_ROWS = 64  # queries with links that are compared with all of the shard
PROBES = 256  # planted queries of a meeting
RECALL = 0.995
MOST_TASKS = 20_000
SALTS = 8
ABOUT = ("s", "t", "beam", "recall", "queries")
SLACK = 1e-4  # single against double precision
STEP = 256  # queries searched together
OPEN = 4  # beam entries opened at once, more where the beam is wide


class SmallWorld:
    """A hierarchical graph over unit vectors; searches run for many queries in lockstep.

    Layers are prefixes of one fixed random order, each a sixteenth of the one below.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, build_beam: int = BUILD_BEAM) -> None:
        self.order = np.random.default_rng(7).permutation(len(x))
        self.x = np.ascontiguousarray(x[self.order], dtype=np.float32)
        sizes = [len(x)]
        while sizes[-1] > 64:
            sizes.append(max(32, sizes[-1] // 16))
        self.layers: list[np.ndarray] = []  # from the top down
        for size in reversed(sizes):
            width = 2 * degree if size == len(x) else degree
            self.layers.append(np.full((size, width), -1, dtype=np.int32))
            self._fill(self.layers[-1], degree, build_beam)

    def _fill(self, links: np.ndarray, degree: int, build_beam: int) -> None:
        done, size = 0, len(links)
        while done < size:
            new = np.arange(done, min(size, done + min(512, max(64, done))))
            q = self.x[new]
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            keep = min(len(new), degree)
            inside = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            ids, sims = new[inside], np.take_along_axis(near, inside, axis=1)
            ids = np.where(np.isfinite(sims), ids, -1)
            if done:
                start = self._descend(q, done)
                far, far_sims = self._beam(links, q, start, build_beam)
                ids, sims = np.hstack([ids, far]), np.hstack([sims, far_sims])
            chosen = self._choose(ids, sims, degree)
            links[new, :degree] = chosen
            done = int(new[-1]) + 1
            self._answer(links, new, chosen)

    def _answer(self, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """Links back from the chosen nodes; a node with too many keeps the most useful ones."""
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ij,ij->i", self.x[source], self.x[target])
        by = np.lexsort((-sims, target))
        source, target = source[by], target[by]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        kept = place < 16
        nodes = target[first]
        row = np.searchsorted(nodes, target[kept])
        more = np.full((len(nodes), 16), -1, dtype=np.int64)
        more[row, place[kept]] = source[kept]
        width = links.shape[1]
        for at in range(0, len(nodes), 1024):
            some = nodes[at : at + 1024]
            ids = np.hstack([links[some], more[at : at + 1024]])
            ids = _once(ids)
            sims = np.einsum("bkd,bd->bk", self.x[ids], self.x[some])
            links[some] = self._choose(ids, np.where(ids >= 0, sims, -np.inf), width)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Neighbours nearer to the node than to any chosen one; free places go to the nearest rest."""
        by = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, axis=1), np.take_along_axis(sims, by, axis=1)
        out = np.full((len(ids), degree), -1, dtype=np.int32)
        for at in range(0, len(ids), 512):
            i, s = ids[at : at + 512], sims[at : at + 512]
            v = self.x[i]
            between = v @ v.transpose(0, 2, 1)
            valid, chosen = (i >= 0) & np.isfinite(s), np.zeros(i.shape, dtype=bool)
            for c in range(i.shape[1]):
                covered = (chosen & (between[:, c, :] > s[:, c : c + 1])).any(axis=1)
                chosen[:, c] = valid[:, c] & ~covered & (chosen.sum(axis=1) < degree)
            rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :degree]
            picked = np.take_along_axis(np.where(valid, i, -1), rank, axis=1)
            out[at : at + 512, : picked.shape[1]] = picked
        return out

    def _descend(self, q: np.ndarray, limit: int) -> np.ndarray:
        """Entry points below the given node, from the upper layers."""
        start = np.zeros((len(q), 1), dtype=np.int64)
        for links in self.layers[:-1]:
            if len(links) > limit:
                break
            start = self._beam(links, q, start, 4)[0]
        return start

    def _beam(self, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes that a best-first walk meets, best first; -1 where there are fewer."""
        b, n = len(q), len(links)
        rows = np.arange(b)[:, None]
        visited = np.zeros((b, n + 1), dtype=bool)  # the last column stands for -1
        ids = np.full((b, beam), -1, dtype=np.int64)
        sims = np.full((b, beam), -np.inf, dtype=np.float32)
        opened = np.ones((b, beam), dtype=bool)
        start = _once(start[:, :beam].astype(np.int64))
        k = start.shape[1]
        ids[:, :k] = start
        sims[:, :k] = np.where(start >= 0, np.einsum("bkd,bd->bk", self.x[start], q), -np.inf)
        opened[:, :k] = (start < 0) | (k >= n)  # where all nodes are in the beam there is nothing to open
        visited[rows, start] = True
        live = np.arange(b)
        few = min(beam, max(OPEN, beam // 16))
        while len(live):
            waiting = np.where(opened[live], -np.inf, sims[live])
            pick = np.argpartition(-waiting, few - 1, axis=1)[:, :few]
            going = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            some = going.any(axis=1)
            live, pick, going = live[some], pick[some], going[some]
            if not len(live):
                break
            at = live[:, None]
            opened[at, pick] = True
            near = np.where(going[:, :, None], links[ids[at, pick]], -1).reshape(len(live), -1).astype(np.int64)
            near = _once(near)
            near[visited[at, near]] = -1
            visited[at, near] = True
            r, c = np.nonzero(near >= 0)
            fresh = np.full(near.shape, -np.inf, dtype=np.float32)
            fresh[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], q[live[r]])
            all_sims = np.hstack([sims[live], fresh])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, best, axis=1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], near]), best, axis=1)
            opened[live] = np.take_along_axis(np.hstack([opened[live], near < 0]), best, axis=1)
        by = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, by, axis=1), np.take_along_axis(sims, by, axis=1)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` of all met nodes of at least that similarity, nodes in input order.

        A query whose beam is full of such nodes is searched again with twice the beam.
        """
        out_q, out_n = [], []
        for at in range(0, len(q), STEP):
            rest, width = np.arange(at, min(at + STEP, len(q))), min(beam, len(self.x))
            while len(rest):
                again = []
                part = max(16, STEP * 64 // max(64, width))
                for lo in range(0, len(rest), part):
                    some = rest[lo : lo + part]
                    ids, sims = self._beam(self.layers[-1], q[some], self._start(q[some], width), width)
                    full = (sims[:, -1] >= least) & (width < len(self.x))
                    again.append(some[full])
                    r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                    out_q.append(some[r])
                    out_n.append(self.order[ids[r, c]])
                rest, width = np.concatenate(again), min(2 * width, len(self.x))
        return np.concatenate(out_q), np.concatenate(out_n)

    def _start(self, q: np.ndarray, width: int) -> np.ndarray:
        """Entry points of the lowest layer; a beam as wide as the shard starts from all of its nodes."""
        if width >= len(self.x):
            return np.broadcast_to(np.arange(len(self.x)), (len(q), len(self.x)))
        return self._descend(q, len(self.x))


def _once(ids: np.ndarray) -> np.ndarray:
    """Each row without repeats; freed places are -1."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _probes(shard: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Evenly spaced vectors of the shard and each of them turned by the limiting angle in a random direction."""
    source = np.unique(np.linspace(0, len(shard) - 1, min(PROBES, len(shard))).astype(int))
    v = shard[source]
    turn = np.random.default_rng(23).normal(size=v.shape)
    turn -= (turn * v).sum(axis=1, keepdims=True) * v
    size = np.sqrt((turn * turn).sum(axis=1, keepdims=True))
    turn = np.where(size > 1e-9, turn / np.maximum(size, 1e-9), 0.0)  # one component has no other direction
    cosine = min(1.0, least + SLACK)
    probe = cosine * v + np.sqrt(1 - cosine**2) * turn
    return source, probe / np.sqrt((probe * probe).sum(axis=1, keepdims=True))


def audited(
    graph: SmallWorld, shard: np.ndarray, q: np.ndarray, least: float, same: bool = False
) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Links from ``q`` into the shard as ``(query, node)``, the beam that found them and its recall.

    Two audits double the beam until both reach ``RECALL``. Planted probes: vectors of the shard turned by
    just the limiting angle must meet their source, so that a link of two otherwise unrelated vectors
    would be found. Found links: a sample of the queries that have links is compared with all of the
    shard, so that dense groups are found in full. The beam ends at the size of the shard, where the
    search sees every node. The recall is the smaller of the two.

    ``same`` says that the queries are the shard: none counts as its own link.
    """
    beam, single = BEAM, q.astype(np.float32)
    source, probe = _probes(shard, least)
    while True:
        whole = beam >= len(shard)
        recall = 1.0
        if not whole:
            met = graph.within(probe.astype(np.float32), least - SLACK, beam)
            recall = float(np.isin(np.arange(len(source)), met[0][source[met[0]] == met[1]]).mean())
        if recall >= RECALL:
            found = graph.within(single, least - SLACK, beam)
            if whole:
                return *found, beam, recall
            linked = np.unique(found[0][found[0] != found[1]] if same else found[0])
            sample = linked[np.unique(np.linspace(0, len(linked) - 1, min(AUDIT_ROWS, len(linked))).astype(int))]
            true = q[sample] @ shard.T >= least
            if same:
                true[np.arange(len(sample)), sample] = False
            met = np.zeros_like(true)
            if len(sample):
                at = np.searchsorted(sample, found[0]).clip(max=len(sample) - 1)
                hit = sample[at] == found[0]
                met[at[hit], found[1][hit]] = True
            some = true.any(axis=1)
            if some.any():
                recall = min(recall, float(((met & true)[some].sum(axis=1) / true[some].sum(axis=1)).mean()))
            if recall >= RECALL:
                return *found, beam, recall
        beam *= 2


def _forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    root = np.arange(nodes)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def _graph(folder: str):
    """Points and graph of a shard go to files of the shared folder, once; the table holds their names."""

    def graph(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        unit = _unit(matrix(rows["embedding"]))
        name = f"{folder}/{rows['dim'].iloc[0]}-{rows['shard'].iloc[0]}"
        for kind, value in (("points", (rows["rep"].tolist(), rows["n"].to_numpy(), unit)), ("graph", SmallWorld(unit))):
            with written(f"{name}-{kind}") as out:
                out.write(pickle.dumps(value, protocol=5))
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "name": [name]})

    return graph


def _meet(least: float, kind: pa.DataType):
    """Links of the vectors of one shard or between two, and a last row about the meeting itself."""

    def meet(meeting: pa.Table) -> pa.Table:
        s, t, name, other_name = (meeting[c][0].as_py() for c in ("s", "t", "name", "other_name"))
        ids, n, unit = pickle.loads(read_bytes(f"{name}-points"))
        graph = pickle.loads(read_bytes(f"{name}-graph"))
        same = s == t
        other_ids, other_n, other = (ids, n, unit) if same else pickle.loads(read_bytes(f"{other_name}-points"))
        a, b, beam, recall = audited(graph, unit, other, least, same)
        exact = np.concatenate(
            [np.einsum("ij,ij->i", other[a[i : i + 65536]], unit[b[i : i + 65536]]) for i in range(0, len(a), 65536)]
            or [np.zeros(0)]
        )
        keep = (exact >= least) & ((a != b) if same else True)
        a, b = a[keep], b[keep]
        if same:  # a pair may be met from both sides
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
            size, shift, names, weight = len(ids), 0, ids, n
        else:
            size, shift, names, weight = len(ids) + len(other_ids), len(ids), ids + other_ids, np.r_[n, other_n]
        a = a + shift
        links = np.bincount(a, weight[b], size) + np.bincount(b, weight[a], size)
        root = _forest(size, a, b)
        linked = np.flatnonzero(links)
        found = len(linked)
        columns = [
            pa.array([names[i] for i in linked] + [None], kind),
            pa.array([names[root[i]] for i in linked] + [None], kind),
            pa.array(links[linked].astype(np.int64).tolist() + [None], pa.int64()),
        ]
        about = zip(ABOUT, (s, t, beam, recall, len(other)), strict=True)
        columns += [pa.array([None] * found + [x], pa.float64() if c == "recall" else pa.int32()) for c, x in about]
        return pa.table(columns, names=["rep", "root", "n", *ABOUT])

    return meet


def near_trajectories(
    spark: SparkSession,
    trajectories: DataFrame,
    threshold: float = THRESHOLD,
    shard_rows: int = SHARD_ROWS,
    audits: str | None = None,
) -> DataFrame:
    """Links and components of trajectories whose embeddings have a cosine of ``threshold`` or more.

    ``trajectories`` has ``flight_id`` and ``embedding``; other columns are ignored. Returns one
    row per flight: ``flight_id, n_links`` (others linked directly), ``component_id`` (smallest
    flight id reachable by links, itself included), ``kept`` (flight id = component id).

    Embeddings that are null, empty, all zero, or hold null or non-finite components link with
    nothing, and neither do embeddings of different lengths; of rows with one id the smallest
    embedding counts; rows without an id are dropped; an empty table gives an empty result.

    Equal embeddings are first put together. The rest is dealt by a hash into shards of bounded
    size, each with a hierarchical small-world graph, kept in a file of the shared folder. Every shard is
    asked for the vectors of every other (each two shards meet in one task, which gets their names),
    beams widen as ``within`` and ``audited`` say, and cosines are verified in double precision. A
    task returns the number of links of its vectors and a spanning forest of them, not the pairs, so a
    large group of near copies costs rows in proportion to its size. ``audits`` names a folder for a table
    of all meetings: ``s, t`` (shards), ``beam, recall, queries``.
    """
    rows = one_per_id(trajectories, "flight_id", "embedding")
    fit = usable("embedding") & F.exists("embedding", lambda x: x != 0)
    rows = stored(spark, rows.withColumn("fit", fit), "flights")
    groups = stored(
        spark,
        rows.where("fit").groupBy("embedding").agg(F.min("flight_id").alias("rep"), F.count(F.lit(1)).alias("n")),
        "groups",
    )
    shards = shard_count(groups.count(), shard_rows, MIN_SHARDS)
    dealt = groups.select(
        "rep", "n", "embedding", F.size("embedding").alias("dim"),
        F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"),
    )
    folder = scratch_dir(spark, "graphs")
    graphs = stored(
        spark,
        dealt.repartition(min(MOST_TASKS, shards), "dim", "shard").groupBy("dim", "shard").applyInPandas(
            _graph(folder), "dim int, shard int, name string"
        ),
        "graphs",
    )
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    meeting = F.explode(F.filter(every, lambda t: t >= F.col("shard")))
    left = graphs.select("dim", F.col("shard").alias("s"), meeting.alias("t"), "name")
    right = graphs.select("dim", F.col("shard").alias("t"), F.col("name").alias("other_name"))
    kind = rows.schema["flight_id"].dataType
    out = T.StructType([
        T.StructField("rep", kind), T.StructField("root", kind), T.StructField("n", T.LongType()),
        *[T.StructField(c, T.DoubleType() if c == "recall" else T.IntegerType()) for c in ABOUT],
    ])
    keys = ["dim", "s", "t"]
    tasks = min(MOST_TASKS, shards * (shards + 1) // 2)
    met = stored(
        spark,
        left.join(right, ["dim", "t"]).repartition(tasks, *keys).groupBy(*keys).applyInArrow(
            _meet(threshold, to_arrow_type(kind)), out
        ),
        "met",
    )
    if audits:
        met.where("beam IS NOT NULL").select(*ABOUT).write.mode("overwrite").parquet(audits)
    found = met.where("beam IS NULL")
    links = found.groupBy("rep").agg(F.sum("n").alias("links"))
    ends = connected_components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # rows find their group by a 128-bit name of the embedding; the salt splits a vector that many rows have
    name = [F.xxhash64("embedding").alias("_a"), F.xxhash64(F.lit(1), "embedding").alias("_b")]
    of_group = (
        groups.join(links, "rep", "left")
        .join(ends.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            *name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_n"), F.coalesce("component_id", "rep").alias("_c"),
        )
    )
    salt = F.pmod(F.xxhash64("flight_id", F.lit("salt")), F.lit(SALTS)).cast("int").alias("_salt")
    fit_rows = rows.where("fit").select("flight_id", *name, salt).join(of_group, ["_a", "_b", "_salt"])
    rest = rows.where("not fit").select("flight_id", F.lit(0).cast("long").alias("_n"), F.col("flight_id").alias("_c"))
    return fit_rows.select("flight_id", "_n", "_c").unionByName(rest).select(
        "flight_id", F.col("_n").cast("long").alias("n_links"), F.col("_c").alias("component_id"),
        (F.col("flight_id") == F.col("_c")).alias("kept"),
    )
