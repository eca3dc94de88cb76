"""Exact top-k trajectories by integer inner product, over a KD-tree per shard."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.llm.vectors import matrix, one_per_id, shard_count, usable
from aerotrace.session import stored

SHARD_ROWS = 16_384
MIN_SHARDS = 6
BLOCK_ROWS = 2_048
LEAF_ROWS = 48
EXACT = float(1 << 53)


class KdTree:
    """Median splits along the widest side of tight bounding boxes; points in id order per leaf."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.below: list[tuple[int, int] | None] = []
        pending = [(0, len(points), -1)]
        while pending:
            start, end, parent = pending.pop()
            here = self.order[start:end]
            low, high = points[here].min(axis=0), points[here].max(axis=0)
            node = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((start, end))
            self.below.append(None)
            if parent >= 0:
                self.below[parent] = (*(self.below[parent] or ()), node)
            if end - start <= leaf_rows:
                here.sort()
                continue
            axis, half = int(np.argmax(high - low)), (end - start) // 2
            self.order[start:end] = here[np.argpartition(points[here, axis], half)]
            pending += [(start, start + half, node), (start + half, end, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.sorted = points[self.order]
        self.largest = float(np.abs(points).max())

    def search(self, q: np.ndarray, k: int, skip: int, floor: float) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, position)`` with scores of at least ``floor``, ties to the
        smaller position, without the position ``skip``.

        Best first: the node whose box allows the largest inner product is opened next, and the
        search ends when that bound is below the kth score so far.
        """
        points, low, high = self.sorted, self.low, self.high
        if self.largest * max(1.0, float(np.abs(q).max())) * len(q) >= EXACT:
            points, low, high, q = (x.astype(object) for x in map(_whole, (points, low, high, q)))
        bounds = np.maximum(low * q, high * q).sum(axis=1)
        best: list[tuple[int, int]] = []  # (score, -position), the worst first
        kth, heap = floor, [(-bounds[0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if self.below[node]:
                for child in self.below[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.span[node]
            scores = points[start:end] @ q
            for i in np.flatnonzero(scores >= kth):
                position = int(self.order[start + i])
                if position == skip:
                    continue
                found = (int(scores[i]), -position)
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -p) for s, p in sorted(best, reverse=True)]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x)


def _build(scale: float):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("flight_id")
        tree = KdTree(np.floor(scale * matrix(rows["embedding"])))
        blob = pickle.dumps((rows["flight_id"].tolist(), tree), protocol=5)
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "tree": [blob]})

    return build


def _search(k: int, scale: float):
    def search(key: tuple, trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(trees) and len(queries):
            ids, tree = pickle.loads(trees["tree"].iloc[0])
            place = {x: i for i, x in enumerate(ids)}
            vectors = np.floor(scale * matrix(queries["embedding"]))
            for query, q, floor in zip(queries["flight_id"], vectors, queries["floor"], strict=True):
                start = -np.inf if floor is None or pd.isna(floor) else int(floor)
                for score, position in tree.search(q, k, place.get(query, -1), start):
                    score = max(-(1 << 63), min((1 << 63) - 1, score))
                    out.append((query, ids[position], score))
        return pd.DataFrame(out, columns=["query_id", "flight_id", "score"])

    return search


def top_trajectories(
    spark: SparkSession,
    trajectories: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` trajectories with the largest integer inner product for each query, exactly.

    Both tables have ``flight_id`` and ``embedding``; other columns are ignored. A component x
    counts as ``floor(scale * x)`` in double precision, a score is the integer inner product.
    Returns ``query_id, rank, flight_id, score``: rank from 1, ties to the smaller id, fewer than
    ``k`` rows where there are fewer candidates; a query is not its own candidate.

    Vectors that are null, empty, or hold null or non-finite components take no part; queries
    see candidates of their own length only; of rows with one id the smallest vector counts;
    rows without an id are dropped; empty tables give an empty result. A score beyond a long is
    cut to its end.

    Candidates are dealt by a hash of the id into shards of bounded size, each with a KD-tree.
    Every query first searches its home shard; the kth score found there goes with it to all
    other shards as a lower bound, where boxes that cannot reach it are never opened. Queries
    travel in blocks of bounded size, so a task holds one tree and one block.
    """
    rows = stored(spark, one_per_id(trajectories.where(usable("embedding")), "flight_id", "embedding"), "points")
    shards = shard_count(rows.count(), shard_rows, MIN_SHARDS)
    kind = rows.schema["flight_id"].dataType
    home = F.pmod(F.xxhash64("flight_id"), F.lit(shards)).cast("int")
    dealt = rows.select("flight_id", "embedding", F.size("embedding").alias("dim"), home.alias("shard"))
    trees = stored(
        spark,
        dealt.groupBy("dim", "shard").applyInPandas(_build(scale), "dim int, shard int, tree binary"),
        "trees",
    )
    asked = stored(
        spark, one_per_id(queries.where(usable("embedding")), "flight_id", "embedding"), "queries"
    )
    blocks = max(1, -(-asked.count() // block_rows))
    block = F.pmod(F.xxhash64("flight_id", F.lit("block")), F.lit(blocks)).cast("int")
    asked = asked.select(
        "flight_id", "embedding", F.size("embedding").alias("dim"), home.alias("home"), block.alias("block")
    )
    found = T.StructType([
        T.StructField("query_id", kind), T.StructField("flight_id", kind), T.StructField("score", T.LongType()),
    ])
    spread = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(rows: DataFrame) -> DataFrame:
        keys = ["dim", "shard", "block"]
        return (
            spread.groupBy(*keys)
            .cogroup(rows.groupBy(*keys))
            .applyInPandas(_search(k, scale), found)
        )

    at_home = stored(
        spark, visit(asked.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("long"))), "home"
    )
    worst = at_home.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    bound = worst.select(
        F.col("query_id").alias("_id"), F.when(F.col("n") >= k, F.col("floor")).alias("floor")
    )
    away = (
        asked.join(bound, F.col("flight_id") == F.col("_id"), "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .where(F.col("shard") != F.col("home"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "flight_id")
    both = at_home.unionByName(visit(away))
    return (
        both.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "flight_id", "score")
    )
