"""Hard negatives for training trajectory embeddings, over an inverted multi-index per shard."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.llm.files import read_bytes, written
from aerotrace.llm.vectors import matrix, shard_count, usable
from aerotrace.session import scratch_dir, stored

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
SHARD_ROWS = 16_384
MIN_SHARDS = 6
BLOCK_ROWS = 4_096  # anchors that meet a shard in one group
CODEWORDS = 16  # per half space
FIT_ROWS = 2_048  # rows of a shard its codebooks are fitted on, at most
BATCH = 512
MOST_TASKS = 20_000
EXACT = float(1 << 53)
NO_FLOOR = -(1 << 63)


def _codebook(points: np.ndarray, codewords: int, fit_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres by k-means on evenly spaced rows, the centre of every row and its distance."""
    if not points.shape[1]:
        return np.zeros((1, 0)), np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    some = points[np.unique(np.linspace(0, len(points) - 1, min(fit_rows, len(points))).astype(int))]
    distinct = np.unique(some, axis=0)
    start = np.random.default_rng(11).permutation(len(distinct))[:codewords]
    centres = distinct[start].copy()
    for _ in range(8):
        which = _nearest(some, centres)
        n = np.bincount(which, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, which, some)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    which = _nearest(points, centres)
    return centres, which, np.sqrt(((points - centres[which]) ** 2).sum(axis=1))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


class MultiIndex:
    """Cells of two codebooks, one over each half of the components; rows lie cell by cell.

    With a centre ``c`` of a half and a radius ``r`` that covers its rows, no row of it has a larger
    half score than ``c.q + r|q|``; the bound of a cell is the sum of both halves.
    """

    def __init__(
        self, ids: list, labels: list, points: np.ndarray, codewords: int = CODEWORDS, fit_rows: int = FIT_ROWS
    ) -> None:
        self.place = {x: i for i, x in enumerate(ids)}
        self.ids = ids
        self.names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        self.half = points.shape[1] // 2
        books = [_codebook(p, codewords, fit_rows) for p in (points[:, : self.half], points[:, self.half :])]
        self.centres = [b[0] for b in books]
        cell = books[0][1] * len(self.centres[1]) + books[1][1]
        self.order = np.argsort(cell, kind="stable")
        self.points = points[self.order]
        self.labels = np.array([self.names[x] for x in labels])[self.order]
        self.cells, self.start = np.unique(cell[self.order], return_index=True)
        self.end = np.append(self.start[1:], len(points))
        self.at = {int(c): i for i, c in enumerate(self.cells)}
        far = [b[2][self.order] for b in books]
        self.cell_radius = [np.maximum.reduceat(d, self.start) for d in far]
        self.radius = []
        for (centres, which, away), _ in zip(books, far, strict=True):
            r = np.zeros(len(centres))
            np.maximum.at(r, which, away)
            self.radius.append(r)
        self.largest = float(np.abs(points).max())
        self.longest = float(np.sqrt((points**2).sum(axis=1)).max())

    def visits(self, q: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """``(bound, cell, upper, lower)`` of the cells that have rows, by falling bound.

        Multi-sequence order: a heap over pairs of ranks in the two lists of half-score bounds. The
        closer bounds ``upper`` and ``lower`` use the radii of the cell itself.
        """
        halves = (q[: self.half], q[self.half :])
        size = [float(np.sqrt(h @ h)) for h in halves]
        scores = [c @ h for c, h in zip(self.centres, halves, strict=True)]
        slack = 1e-9 * (1.0 + self.longest) * (1.0 + size[0] + size[1])  # rounding of the bounds
        width = len(self.centres[1])
        middle = scores[0][self.cells // width] + scores[1][self.cells % width]
        reach = size[0] * self.cell_radius[0] + size[1] * self.cell_radius[1] + slack
        bounds = [s + n * r for s, n, r in zip(scores, size, self.radius, strict=True)]
        by = [np.argsort(-b, kind="stable") for b in bounds]
        sums = (bounds[0][by[0]][:, None] + bounds[1][by[1]][None, :] + slack).tolist()
        cells = (by[0][:, None] * width + by[1][None, :]).tolist()
        popped = [[False] * len(by[1]) for _ in by[0]]
        heap = [(-sums[0][0], 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            popped[i][j] = True
            if i + 1 < len(sums) and (j == 0 or popped[i + 1][j - 1]):
                heapq.heappush(heap, (-sums[i + 1][j], i + 1, j))
            if j + 1 < len(sums[0]) and (i == 0 or popped[i - 1][j + 1]):
                heapq.heappush(heap, (-sums[i][j + 1], i, j + 1))
            cell = self.at.get(cells[i][j])
            if cell is not None:
                yield -bound, cell, middle[cell] + reach[cell], middle[cell] - reach[cell]

    def best(
        self, q: np.ndarray, label: str, same: bool, skip: int, windows: list[tuple[float, float]], k: int
    ) -> list[list[tuple[int, int]]]:
        """Per window of scores its ``k`` best ``(score, place)``, ties to the smaller place.

        Rows count if their label equals ``label`` or not, as ``same`` says, and ``skip`` never does.
        A window is certified when no cell to come can hold a score that is both in it and as good as its kth.
        """
        exact = self.largest * max(1.0, float(np.abs(q).max())) * len(q) < EXACT
        whole = q if exact else _whole(q)
        code = self.names.get(label, -1)
        least, most = [a if a <= b else np.inf for a, b in windows], max(w[1] for w in windows)
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        waiting, rows = [], 0

        def score() -> None:
            at = np.concatenate([np.arange(self.start[c], self.end[c]) for c in waiting])
            ok = (self.labels[at] == code) == same
            at = at[ok & (self.order[at] != skip)]
            points = self.points[at] if exact else _whole(self.points[at])
            scores = points @ whole
            for w, (_, high) in enumerate(windows):
                hit = np.flatnonzero((scores >= least[w]) & (scores <= high))
                if len(hit) > k and exact:  # all that are as good as the kth of them
                    kth = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
                    hit = hit[scores[hit] >= kth]
                new = [(-int(scores[i]), int(self.order[at[i]])) for i in hit]
                found[w] = sorted(found[w] + new)[:k]
                if len(found[w]) == k:
                    least[w] = max(least[w], -found[w][-1][0])

        for bound, cell, upper, lower in self.visits(q):
            needed = min(least)
            if bound < needed:
                break
            if upper < needed or lower > most:
                continue
            waiting.append(cell)
            rows += self.end[cell] - self.start[cell]
            if rows >= BATCH:
                score()
                waiting, rows = [], 0
        if waiting:
            score()
        return [[(-s, p) for s, p in f] for f in found]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x)


def _long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def _build(folder: str, scale: float, codewords: int, fit_rows: int):
    """The index of a shard goes to a file of the shared folder, once; the table holds its name."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("flight_id")
        points = np.floor(scale * matrix(rows["embedding"]))
        index = MultiIndex(rows["flight_id"].tolist(), rows["label"].tolist(), points, codewords, fit_rows)
        name = f"{folder}/index-{rows['dim'].iloc[0]}-{rows['shard'].iloc[0]}"
        with written(name) as out:
            out.write(pickle.dumps(index, protocol=5))
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "index": [name]})

    return build


def _positives(k: int, scale: float):
    def positives(rows: pd.DataFrame) -> pd.DataFrame:
        index: MultiIndex = pickle.loads(read_bytes(rows["index"].iloc[0]))
        out = []
        vectors = np.floor(scale * matrix(rows["embedding"]))
        for anchor, label, q, floor in zip(rows["flight_id"], rows["label"], vectors, rows["floor"], strict=True):
            best = index.best(q, label, True, index.place.get(anchor, -1), [(int(floor), np.inf)], k)[0]
            out += [(anchor, index.ids[p], _long(s)) for s, p in best]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    return positives


def _negatives(k: int, scale: float, low: int, high: int):
    def negatives(rows: pd.DataFrame) -> pd.DataFrame:
        index: MultiIndex = pickle.loads(read_bytes(rows["index"].iloc[0]))
        out = []
        vectors = np.floor(scale * matrix(rows["embedding"]))
        for anchor, label, q, pairs in zip(rows["flight_id"], rows["label"], vectors, rows["pairs"], strict=True):
            pairs = [(p["positive_id"], int(p["positive_score"]), int(p["floor"])) for p in pairs]
            windows = [(max(-(-low * s // 100), floor), high * s // 100) for _, s, floor in pairs]
            best = index.best(q, label, False, -1, windows, k)
            for (positive, score, _), rest in zip(pairs, best, strict=True):
                out += [(anchor, positive, index.ids[p], score, _long(s)) for s, p in rest]
        return pd.DataFrame(
            out, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        )

    return negatives


def hard_negatives(
    spark: SparkSession,
    trajectories: DataFrame,
    anchors: DataFrame,
    label: str = "dest_icao",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    codewords: int = CODEWORDS,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Triples for training trajectory embeddings: flights that fly alike but differ in ``label``.

    ``trajectories`` has ``flight_id``, ``embedding`` and ``label`` (by default the destination of the
    flight), ``anchors`` has ``flight_id``; other columns are ignored. A component x counts as
    ``floor(scale * x)`` in double precision, a score is the integer inner product with the anchor's
    vector; higher scores come first, ties by smaller flight id. The positives of an anchor are
    the first ``positives`` other flights with its label. Its negatives for one positive are the
    first ``negatives`` flights of other labels whose score lies between ``low`` and ``high``
    percent of the positive's.

    Returns ``anchor_id, positive_id, rank`` (from 1), ``negative_id, positive_score,
    negative_score``; fewer rows where there are fewer candidates, none for a positive of negative score.
    Vectors that are null, empty, or hold null or non-finite components, and null labels take no part;
    flights of other vector lengths are no candidates; of rows with one id the smallest vector, then
    label counts; rows without an id are dropped; anchors that take no part and repeated ones add
    nothing; empty tables give an empty result. A score beyond a long is cut to its end.

    Flights are dealt by a hash of the id into shards of bounded size, whatever their label. Each
    shard has an inverted multi-index (``MultiIndex``): its codebooks are fitted on at most ``fit_rows``
    of its rows, every row is indexed, and the search is exact. It lies in one file of the shared folder. Each
    anchor first searches its home shard; the last of enough scores found there bounds the search
    of all other shards, for positives and then for all windows of negatives at once.
    """
    kept = trajectories.where(usable("embedding") & F.col(label).isNotNull() & F.col("flight_id").isNotNull())
    one = F.min(F.struct(F.col("embedding").cast("array<double>").alias("embedding"), F.col(label).alias("label")))
    rows = stored(spark, kept.groupBy("flight_id").agg(one.alias("_row")).select("flight_id", "_row.*"), "flights")
    kind = rows.schema["flight_id"].dataType
    shards = shard_count(rows.count(), shard_rows, MIN_SHARDS)
    home = F.pmod(F.xxhash64("flight_id"), F.lit(shards)).cast("int")
    parts = rows.select(
        "flight_id", "embedding", F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"),
        home.alias("shard"),
    )
    index = stored(
        spark,
        parts.groupBy("dim", "shard").applyInPandas(
            _build(scratch_dir(spark, "index"), scale, codewords, fit_rows), "dim int, shard int, index string"
        ),
        "index",
    )
    asked = stored(spark, parts.join(anchors.select("flight_id").distinct(), "flight_id", "left_semi"), "anchors")
    blocks = max(1, -(-asked.count() // block_rows))
    block = F.pmod(F.xxhash64("flight_id", F.lit("block")), F.lit(blocks)).cast("int")
    asked = asked.withColumnRenamed("shard", "home").withColumn("block", block)
    pair = [T.StructField("anchor_id", kind), T.StructField("positive_id", kind)]
    score = T.StructField("positive_score", T.LongType())

    tasks = min(MOST_TASKS, 2 * shards * blocks)

    def visit(rows: DataFrame, search, schema: T.StructType) -> DataFrame:
        # little data, much work: a stated number of partitions is not put together again
        keys = ["dim", "shard", "block"]
        return rows.join(index, ["dim", "shard"]).repartition(tasks, *keys).groupBy(*keys).applyInPandas(search, schema)

    def away(rows: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        return rows.withColumn("shard", every).where(F.col("shard") != F.col("home"))

    def first(rows: DataFrame, keys: list[str], by: str, name: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(by), name)
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    none = F.lit(NO_FLOOR)
    search, schema = _positives(positives, scale), T.StructType([*pair, score])
    near = stored(spark, visit(asked.withColumn("shard", F.col("home")).withColumn("floor", none), search, schema), "near")
    floors = near.groupBy(F.col("anchor_id").alias("flight_id")).agg(
        F.when(F.count("*") >= positives, F.min("positive_score")).alias("floor")
    )
    bounded = asked.join(floors, "flight_id", "left").withColumn("floor", F.coalesce("floor", none))
    far = visit(away(bounded), search, schema)
    chosen = stored(
        spark, first(near.unionByName(far), ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives"
    )

    def with_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        listed = F.collect_list(F.struct("positive_id", "positive_score", "floor")).alias("pairs")
        return rows.join(pairs.groupBy(F.col("anchor_id").alias("flight_id")).agg(listed), "flight_id")

    search = _negatives(negatives, scale, low, high)
    schema = T.StructType([
        *pair, T.StructField("negative_id", kind), score, T.StructField("negative_score", T.LongType()),
    ])
    at_home = with_pairs(asked, chosen.withColumn("floor", none)).withColumn("shard", F.col("home"))
    near = stored(spark, visit(at_home, search, schema), "near")
    floors = near.groupBy("anchor_id", "positive_id").agg(
        F.when(F.count("*") >= negatives, F.min("negative_score")).alias("floor")
    )
    pairs = chosen.join(floors, ["anchor_id", "positive_id"], "left").withColumn("floor", F.coalesce("floor", none))
    far = visit(away(with_pairs(asked, pairs)), search, schema)
    found = first(near.unionByName(far), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
