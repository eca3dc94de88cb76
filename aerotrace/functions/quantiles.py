"""Exact quantiles of large groups without collecting a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact at any group size.

    A sketch per group (bounded memory, merged map-side) brackets each wanted rank; only the
    values inside a bracket are kept, counted by distinct value, and ranked. So a group that
    holds most of the data still costs one sketch plus about ``4/accuracy`` of its values.
    Null values are ignored. ``probs`` maps output names to probabilities; ``n`` is the count.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(1))
        return exact_quantiles(whole, ["_all"], value, probs, accuracy).drop("_all")
    margin = 2.0 / accuracy
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    cuts = [
        p
        for q in probs.values()
        for p in (max(0.0, q - margin), min(1.0, q + margin))
    ]
    sketch = data.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(c) for c in cuts]), accuracy).alias("_cuts"),
        F.count(F.lit(1)).alias("n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )

    # Brackets per probability; the outermost ones are opened to the extremes, because the
    # interpolation needs the neighbours on both sides of the rank.
    def bracket(i: int, q: float) -> Column:
        lo = F.col("_min") if q <= 2 * margin else F.col("_cuts")[2 * i]
        hi = F.col("_max") if q >= 1 - 2 * margin else F.col("_cuts")[2 * i + 1]
        return F.struct(
            F.lit(i).alias("i"),
            # Small groups keep every value: the sketch margin is then below one rank.
            F.when(F.col("n") <= accuracy, F.col("_min")).otherwise(lo).alias("lo"),
            F.when(F.col("n") <= accuracy, F.col("_max")).otherwise(hi).alias("hi"),
            (F.lit(q) * (F.col("n") - 1)).alias("rank"),
        )

    plan = sketch.select(
        *keys, "n", F.array(*[bracket(i, q) for i, q in enumerate(probs.values())]).alias("_b")
    )
    # The plan has one row a group and is what is sent around, whatever the files' sizes make of
    # the values: those pack so well that Spark takes millions of them for a small table.
    joined = data.join(F.broadcast(plan), keys)
    # One pass over the values: each lands below, inside or above every bracket. Values below
    # only add to a count; values inside are grouped by distinct value.
    spread = joined.select(
        *keys, "n", F.explode("_b").alias("b"), "_v"
    ).where("_v <= b.hi")
    counted = spread.groupBy(
        *keys,
        "n",
        F.col("b.i").alias("_i"),
        F.col("b.rank").alias("_rank"),
        F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_inside"),
    ).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys, "_i").orderBy(F.col("_inside").asc_nulls_first())
    ranked = counted.withColumn(
        "_end", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    at = lambda r: F.max(  # noqa: E731 - value whose rank interval holds r (0-based)
        F.when((r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")), F.col("_inside"))
    )
    floor = F.floor("_rank")
    picked = ranked.groupBy(*keys, "n", "_i", "_rank").agg(
        at(floor).alias("_a"), at(F.ceil("_rank")).alias("_z")
    )
    blended = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))
    return picked.groupBy(*keys, "n").agg(
        *[
            F.max(F.when(F.col("_i") == i, blended)).alias(name)
            for i, name in enumerate(probs)
        ]
    )
