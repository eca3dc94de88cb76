"""Mix of archived tracks from several feeds, cut at each feed's exact budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerotrace.session import stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
# Rows of one (feed, key range); the number of ranges follows from it and the row count.
RANGE_ROWS = 50_000


def feed_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """``source, source_reports, target`` of every feed.

    ``sizes`` has one row per feed with ``source`` and ``source_reports``. Feeds in code point
    order, null last, take ``weights`` in turn; together they get ``share`` of all reports. A
    target stops at ``epochs`` times its feed, and what that leaves over is shared by weight
    among the rest until none is above. That end state is found directly: feeds are ordered by
    limit / weight, and the capped ones are the first of them.
    """
    n = len(weights)
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(place) - 1, F.lit(n)))
    whole = Window.partitionBy()
    rows = sizes.select("source", "source_reports", turn.alias("weight")).withColumn(
        "limit", F.col("source_reports") * F.lit(epochs)
    )
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.sum("source_reports").over(whole) * F.lit(float(share))).alias("budget"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("full"),
        (
            F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        ).alias("left"),
    )
    # the level if this feed and all after it stay below their limits
    level = (F.col("budget") - F.col("full")) / F.col("left")
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    level = F.max("level").over(whole)  # of the first feed in order that fits: later ones are lower
    target = F.when(level * F.col("weight") <= F.col("limit"), level * F.col("weight")).otherwise(F.col("limit"))
    return rows.select("source", "source_reports", F.coalesce(target, F.col("limit")).cast("double").alias("target"))


def mix_feeds(
    spark: SparkSession,
    tracks: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """How many reports of every track the mix takes.

    ``tracks`` has ``flight_id``, ``source`` (the feed) and ``n_reports``; other columns are
    ignored. Returns ``flight_id, source, n_reports, source_reports, target, taken``, one row per
    row. A feed's tracks stand in the order of a hash of their id; the mix takes them from the
    front, over and over, until exactly ``floor(target)`` reports are taken. So ``taken`` is a
    whole number of times ``n_reports``, and less only for the one track where the cut falls.

    Null sizes count 0; a null feed is a feed of its own, the last in order; rows that agree in
    everything are told apart only by their order, which does not show. Empty feeds have target
    0. An empty table gives an empty result. ``weights`` must be positive.

    Prefix sums are taken in two steps, over hash ranges of a feed and then over the tracks of
    the one range where the cut falls, so a feed with most of the rows is summed in parallel and
    only rows of cut ranges are sorted. Expressions only.
    """
    rows = stored(
        spark,
        tracks.select(
            "flight_id",
            "source",
            F.coalesce(F.col("n_reports").cast("long"), F.lit(0)).alias("n_reports"),
            F.md5(F.coalesce(F.col("flight_id").cast("string"), F.lit(""))).alias("key"),
        ),
        "tracks",
    )
    ranges = max(1, -(-rows.count() // range_rows))
    # the leading 32 bits of the key, cut into equal ranges
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.shiftright(head * F.lit(ranges), 32))
    sums = rows.groupBy("source", "range").agg(F.sum("n_reports").alias("held"))
    feeds = sums.groupBy("source").agg(F.sum("held").alias("source_reports"))
    targets = feed_targets(feeds, weights, share, epochs)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    plan = _same_feed(plan, targets).withColumn("epochs", _full_epochs()).withColumn(
        "budget", F.floor("target") - F.col("epochs") * F.col("source_reports")
    )
    cut = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("held") > F.col("budget"))
    plan = stored(spark, plan.withColumn("cut", cut), "plan")
    rows = _same_feed(rows, plan, "range")
    whole = rows.where(~F.col("cut")).withColumn(
        "extra", F.when(F.col("before") < F.col("budget"), F.col("n_reports")).otherwise(F.lit(0))
    )
    within = Window.partitionBy("source", "range").orderBy("key", "flight_id", "n_reports")
    upto = F.sum("n_reports").over(within.rowsBetween(Window.unboundedPreceding, 0))
    open_ = F.col("budget") - F.col("before") - (upto - F.col("n_reports"))
    edge = rows.where("cut").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n_reports"), open_)))
    return whole.unionByName(edge).select(
        "flight_id", "source", "n_reports", "source_reports", "target",
        (F.col("epochs") * F.col("n_reports") + F.col("extra")).cast("long").alias("taken"),
    )


def _full_epochs() -> Column:
    return F.when(F.col("source_reports") > 0, F.floor(F.floor("target") / F.col("source_reports"))).otherwise(F.lit(0))


def _same_feed(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Join on the feed, null equal to null, and further columns."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in left.columns else F.col(c) for c in right.columns])
    on = F.col("source").eqNullSafe(F.col("_r_source"))
    for c in more:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(right, on).drop(*[c for c in right.columns if c.startswith("_r_")])
