"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.session import stored


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(id, component_id)`` of every node that is not the smallest of its component.

    ``links`` has columns ``a`` and ``b`` of one orderable type. Every round hooks each node to
    its smallest neighbour below it, follows the hooks to their ends by pointer jumping, and
    rewrites the links between the ends; only local minima are left for the next round, at most
    half of the nodes that still have links. Each round is joins and aggregates over links,
    combined before the shuffle; tables are written to the shared folder, so a lost executor
    costs a task. Nothing is collected.

    Nulls, self links and repeated links are ignored; no links give an empty table. A node that
    is missing from the result is its own component.
    """
    work = stored(
        spark,
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "links",
    )
    labels = None
    while not work.isEmpty():
        hooks = _resolve(spark, work.groupBy("hi").agg(F.min("lo").alias("root")))
        ends = hooks.select(F.col("hi").alias("_hi"), F.col("root").alias("_end"))
        if labels is None:
            labels = hooks
        else:
            moved = (
                labels.join(ends, F.col("root") == F.col("_hi"), "left")
                .select("hi", F.coalesce("_end", "root").alias("root"))
            )
            labels = stored(spark, moved.unionByName(hooks), "labels")
        work = stored(spark, _contract(work, ends), "links")
    if labels is None:
        labels = work.select("hi", F.col("lo").alias("root"))
    return labels.select(F.col("hi").alias("id"), F.col("root").alias("component_id"))


def _resolve(spark: SparkSession, hooks: DataFrame) -> DataFrame:
    """Follow hooks until every node points at one that is not hooked."""
    while True:
        step = hooks.select(F.col("hi").alias("_hi"), F.col("root").alias("_end"))
        jumped = stored(
            spark,
            hooks.join(step, F.col("root") == F.col("_hi"), "left").select(
                "hi", F.coalesce("_end", "root").alias("root"), F.col("_end").isNotNull().alias("_moved")
            ),
            "hooks",
        )
        hooks = jumped.select("hi", "root")
        if jumped.where("_moved").isEmpty():
            return hooks


def _contract(work: DataFrame, ends: DataFrame) -> DataFrame:
    """Links between the ends of the hooks. Every ``hi`` is hooked, a ``lo`` may be an end."""
    low = ends.select(F.col("_hi").alias("_lo_hi"), F.col("_end").alias("_lo_end"))
    both = (
        work.join(ends, F.col("hi") == F.col("_hi"))
        .join(low, F.col("lo") == F.col("_lo_hi"), "left")
        .select(F.col("_end").alias("a"), F.coalesce("_lo_end", "lo").alias("b"))
        .where("a <> b")
    )
    return both.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
