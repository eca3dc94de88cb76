"""Similar trajectories for many queries at once: exact by blocks, approximate over inverted lists."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerotrace.session import stored

ID = "flight_id"
BLOCK_ROWS = 16_384  # candidates that meet a block of queries in one task
QUERY_ROWS = 1_024
STRIP_ROWS = 32  # queries whose cosines with a block of candidates are held at once
FIT_ROWS = 20_000  # vectors the centres are fitted on, at most
AUDIT_QUERIES = 256
PLACES = 9  # cosines are compared and returned to so many decimal places


def units(emb: DataFrame) -> DataFrame:
    """``flight_id, unit, dim`` of the vectors that have a direction: finite, not empty, not all zero."""
    wide = emb.select(ID, F.col("embedding").cast("array<double>").alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return (
        wide.withColumn("_n", norm)
        .where((F.col("_n") > 0) & (F.col("_n") < float("inf")) & F.col(ID).isNotNull())
        .select(ID, F.transform("_v", lambda x: x / F.col("_n")).alias("unit"), F.size("_v").alias("dim"))
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _nearest(k: int):
    """The ``k`` best candidates of a block for each query of a block; ties to the smaller id."""

    def nearest(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(queries) and len(candidates):
            candidates = candidates.sort_by(ID)
            ids, names = np.array(candidates[ID].to_pylist(), dtype=object), queries[ID].to_pylist()
            asked, held = _matrix(queries["unit"]), _matrix(candidates["unit"]).T
            place = {x: i for i, x in enumerate(ids)}
            for at, name in enumerate(names):
                if at % STRIP_ROWS == 0:  # a strip of the products at a time
                    cosines = asked[at : at + STRIP_ROWS] @ held
                    np.round(cosines, PLACES, out=cosines)
                    cosines += 0.0
                row = cosines[at % STRIP_ROWS]
                if name in place:
                    row[place[name]] = -np.inf
                if len(row) > k:
                    best = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                else:
                    best = np.arange(len(row))
                best = best[np.argsort(-row[best], kind="stable")][:k]
                best = best[np.isfinite(row[best])]
                out[0] += [name] * len(best)
                out[1] += ids[best].tolist()
                out[2] += row[best].tolist()
        kind = queries.schema.field(ID).type
        return pa.table(
            [pa.array(out[0], kind), pa.array(out[1], kind), pa.array(out[2], pa.float64())],
            names=["query_id", ID, "cosine"],
        )

    return nearest


def _met(queries: DataFrame, candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Queries and candidates that share ``keys``, and of all that were met the ``k`` best per query."""
    kind = queries.schema[ID].dataType
    schema = T.StructType([
        T.StructField("query_id", kind), T.StructField(ID, kind), T.StructField("cosine", T.DoubleType()),
    ])
    met = (
        queries.select(ID, "unit", *keys).groupBy(*keys)
        .cogroup(candidates.select(ID, "unit", *keys).groupBy(*keys))
        .applyInArrow(_nearest(k), schema)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), ID)
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", ID, "cosine")


def _dealt(rows: DataFrame, parts: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64(F.col(ID), F.lit(name)), F.lit(parts)).cast("int"))


def similar(
    spark: SparkSession,
    emb: DataFrame,
    queries: DataFrame,
    k: int = 10,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` flights of greatest cosine similarity to each of many query flights, exactly.

    Both tables have ``flight_id`` and ``embedding``. Returns ``query_id, rank, flight_id, cosine``; a
    flight is not similar to itself, ties in nine decimal places go to the smaller id. Vectors that
    are null, empty, zero or not finite neither ask nor answer, lengths must agree, and flight ids are
    taken to be unique. Every block of queries meets every block of candidates in one task (a matrix
    product); a task returns ``k`` rows per query.
    """
    wanted, known = stored(spark, units(queries), "queries"), stored(spark, units(emb), "units")
    n_known, n_wanted = (max(1, -(-t.count() // n)) for t, n in ((known, block_rows), (wanted, query_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _dealt(wanted, n_wanted, "q").withColumn("c", every(n_known))
    held = _dealt(known, n_known, "c").withColumn("q", every(n_wanted))
    return _met(asked, held, ["dim", "q", "c"], k)


class Lists(NamedTuple):
    """An index of inverted lists: ``rows`` (flight_id, unit, list, part), ``parts`` per list, centres."""

    rows: DataFrame
    parts: DataFrame
    centres: np.ndarray
    probes: int


def _by_list(spark: SparkSession, rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``rows`` with ``lists``, the nearest ``probes`` of the centres, nearest first."""
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    at = rows.columns.index("unit")

    def assign(batches):
        for batch in batches:
            units = batch.column(at)
            near = -(units.flatten().to_numpy(zero_copy_only=False).reshape(len(units), -1) @ shared.value.T)
            order = np.argsort(near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            flat = pa.array(order.ravel(), pa.int32())
            lists = pa.ListArray.from_arrays(np.arange(0, flat.__len__() + 1, order.shape[1], dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    return rows.mapInArrow(assign, schema)


def build_lists(
    spark: SparkSession,
    emb: DataFrame,
    lists: int = 100,
    dim: int = 64,
    k: int = 10,
    recall: float = 0.95,
    fit_rows: int = FIT_ROWS,
    audit_queries: int = AUDIT_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> Lists:
    """Inverted lists by cosine k-means, and the number of lists to probe for a recall of ``recall``.

    Centres are fitted on at most ``fit_rows`` vectors, those whose ids hash lowest; every vector of
    length ``dim`` is put into the list of its nearest centre, a long list into several parts. Then
    ``audit_queries`` of the vectors are answered exactly, and ``probes`` is the smallest number of
    lists, nearest first, that holds this share of their ``k`` neighbours. Fewer vectors than lists
    give fewer lists; without vectors there is one empty list.
    """
    rows = stored(spark, units(emb).where(F.col("dim") == dim).drop("dim"), "units")
    sample = rows.orderBy(F.xxhash64(ID), ID).limit(fit_rows).select(array_to_vector("unit").alias("features"))
    centres = np.zeros((1, dim))
    if not rows.isEmpty():
        model = KMeans(k=max(2, lists), seed=7, distanceMeasure="cosine", maxIter=10).fit(sample)
        centres = np.array(model.clusterCenters())
    listed = _by_list(spark, rows, centres, 1).withColumn("list", F.col("lists")[0]).drop("lists")
    listed = stored(spark, listed, "listed")
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("parts"))
    placed = listed.join(parts, "list").withColumn(
        "part", F.pmod(F.xxhash64(ID, F.lit("part")), F.col("parts")).cast("int")
    )
    index = Lists(stored(spark, placed.drop("parts"), "index"), stored(spark, parts, "parts"), centres, len(centres))

    asked = listed.orderBy(F.xxhash64(F.col(ID), F.lit("audit")), ID).limit(audit_queries).select(ID, "unit")
    exact = similar(spark, emb, asked.withColumnRenamed("unit", "embedding"), k)
    order = _by_list(spark, asked, centres, len(centres)).select(F.col(ID).alias("query_id"), "lists")
    place = F.array_position("lists", F.col("list"))
    needed = exact.join(listed.select(ID, "list"), ID).join(order, "query_id").groupBy(place.alias("probes")).count()
    counts = sorted((r["probes"], r["count"]) for r in needed.collect())  # at most one row per list
    total, held, probes = sum(n for _, n in counts), 0, 1
    for at, n in counts:
        if held >= recall * total:
            break
        held, probes = held + n, int(at)
    return index._replace(probes=probes)


def similar_by_lists(
    spark: SparkSession, index: Lists, queries: DataFrame, k: int = 10, probes: int | None = None
) -> DataFrame:
    """``similar``, asking only the ``probes`` lists nearest to each query; cosines are exact.

    By default as many lists as the audit of the index found to be needed. A query meets each part of
    its lists in its own task, so neither a long list nor a popular one is gathered.
    """
    dim = index.centres.shape[1]
    asked = units(queries).where(F.col("dim") == dim).drop("dim")
    probed = _by_list(spark, asked, index.centres, probes or index.probes).withColumn("list", F.explode("lists"))
    spread = probed.join(index.parts, "list").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    spread = stored(spark, _turns(spread), "probes")
    turns = spread.groupBy("list", "part").agg(F.max("turns").alias("turns"))
    held = index.rows.join(turns, ["list", "part"]).withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)")))
    return _met(spread, held, ["list", "part", "turn"], k)


def _turns(spread: DataFrame) -> DataFrame:
    """Queries of a popular list are dealt to several turns of bounded size."""
    turns = spread.groupBy("list", "part").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("turns"))
    return spread.join(turns, ["list", "part"]).withColumn(
        "turn", F.pmod(F.xxhash64(ID, F.lit("turn")), F.col("turns")).cast("int")
    )
