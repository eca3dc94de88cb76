"""Ordered computations over long keys, cut into time slices.

A window over one key runs in one task, so a key with a large share of all rows would decide
the run time. Here every key is cut into slices of fixed length: windows run per (key, slice),
one small summary row per slice is scanned in key order, and its result is handed to the rows
of the next slices. Work on rows is then spread evenly, and only summaries (span / slice length
of them) meet per key. Where a computation looks back or ahead by a bounded amount, copying the
rows near a slice border into the neighbour (a halo) is enough and needs no summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE = "_slice"
HOME = "_home"


def time_slice(ts: str, seconds: int) -> Column:
    """Index of the fixed-length slice a timestamp falls into."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def attach_carry(
    rows: DataFrame,
    keys: list[str],
    aggs: list[Column],
    carries: Callable[[WindowSpec], list[Column]],
    slice_col: str = SLICE,
) -> DataFrame:
    """Add columns computed from all *earlier* slices of the row's key.

    ``aggs`` summarise one (key, slice); ``carries`` receives the window over the earlier
    summaries of the key and returns the columns to attach.
    """
    summary = rows.groupBy(*keys, slice_col).agg(*aggs)
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return rows.join(summary.select(*keys, slice_col, *carries(earlier)), [*keys, slice_col])


def lag_sliced(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    fields: list[str],
    out: str = "prev",
    slice_col: str = SLICE,
) -> DataFrame:
    """``out`` = struct of ``fields`` of the previous row of the key, across slices."""
    here = Window.partitionBy(*keys, slice_col).orderBy(*order)
    carried = attach_carry(
        rows,
        keys,
        [F.max_by(F.struct(*fields), F.struct(*order)).alias("_tail")],
        lambda earlier: [F.last("_tail", ignorenulls=True).over(earlier).alias("_carry")],
        slice_col,
    )
    return carried.withColumn(
        out, F.coalesce(F.lag(F.struct(*fields)).over(here), F.col("_carry"))
    ).drop("_carry")


def row_number_sliced(
    rows: DataFrame,
    keys: list[str],
    order: list[Column | str],
    out: str,
    slice_col: str = SLICE,
) -> DataFrame:
    """1-based position of each row within its key; slices must be ordered like ``order``."""
    here = Window.partitionBy(*keys, slice_col).orderBy(*order)
    carried = attach_carry(
        rows,
        keys,
        [F.count(F.lit(1)).alias("_n")],
        lambda earlier: [F.sum("_n").over(earlier).alias("_before")],
        slice_col,
    )
    return carried.withColumn(
        out, F.row_number().over(here) + F.coalesce(F.col("_before"), F.lit(0))
    ).drop("_before")


def with_halo(
    rows: DataFrame, position: Column, length: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Copy each row into its own slice and into a neighbour that must see it.

    ``position`` is an integer on the ordering axis. A slice then also holds the ``before``
    units preceding it and the ``after`` units following it. ``HOME`` marks the row's own slice;
    results are kept for those rows only.
    """
    if before > length or after > length:
        raise ValueError("halo must not be longer than a slice")
    own = F.floor(position / F.lit(length)).cast("long")
    offset = position - own * F.lit(length)
    copies = F.array_compact(
        F.array(
            own,
            F.when(offset >= length - before, own + 1),
            F.when(offset < after, own - 1),
        )
    )
    return rows.withColumn("_own", own).withColumn(SLICE, F.explode(copies)).withColumn(
        HOME, F.col(SLICE) == F.col("_own")
    ).drop("_own")
