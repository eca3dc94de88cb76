"""Adaptive sampling: keep every report outside cruise, thin cruise to one per interval.

Whether a cruise report is kept depends on the last *kept* one, so the rule is a walk through
the reports in order. The walk is cut into slices: for each slice the outcome is worked out for
every report that could be the first kept one (those of the first interval only), the few
outcomes are chained per aircraft, and each slice is then thinned knowing its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerotrace.operators.slicing import SLICE, time_slice
from aerotrace.operators.tracks import CRUISE_SAMPLE_S, KEY, SLICE_S


def next_kept(t: np.ndarray, always: np.ndarray, step: int) -> np.ndarray:
    """Per report, the index of the report kept next after it (len(t) if none)."""
    n = len(t)
    due = np.searchsorted(t, t + step, side="left")
    due = np.maximum(due, np.arange(n) + 1)
    free = np.where(always, np.arange(n), n)
    following = np.append(np.minimum.accumulate(free[::-1])[::-1], n)[1:]
    return np.minimum(due, following)


def first_kept(t: np.ndarray, always: np.ndarray, step: int, last: int | None) -> int:
    """Index of the first report kept after an earlier one at ``last`` (None: nothing kept)."""
    if last is None:
        return 0
    due = int(np.searchsorted(t, last + step, side="left"))
    free = np.flatnonzero(always[:due])
    return int(free[0]) if len(free) else due


def adaptive_sample(
    states: DataFrame, interval_s: float = CRUISE_SAMPLE_S, slice_s: int = SLICE_S
) -> DataFrame:
    """Reports kept by the sampling rule; ``states`` needs ``icao24, ts, phase``."""
    step = int(interval_s * 1_000_000)
    rows = states.withColumn("_us", F.unix_micros("ts"))
    # One row a slice, so that a batch of the Python functions holds many. Reports of one time are
    # kept or not together: always, if any of them is outside cruise.
    free = ~(F.coalesce("phase", F.lit("")) == "cruise")
    times = rows.where(F.col(KEY).isNotNull() & F.col("_us").isNotNull()).select(
        KEY, time_slice("ts", slice_s).alias(SLICE), "_us", free.alias("_free")
    )
    report = F.collect_list(F.struct("_us", "_free"))
    slices = times.groupBy(KEY, SLICE).agg(F.sort_array(report).alias("_at")).select(
        KEY, SLICE, F.col("_at._us").alias("_us"), F.col("_at._free").alias("_free")
    )

    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [outcome(t, always) for t, always in zip(pdf["_us"], pdf["_free"], strict=True)]
            yield pd.DataFrame({
                KEY: pdf[KEY], SLICE: pdf[SLICE], "enter": [f[0] for f in found], "free": [f[1] for f in found],
                "leave": [f[2] for f in found],
            })

    def outcome(t: np.ndarray, always: np.ndarray) -> tuple[np.ndarray, bool, list[int]]:
        t, always = np.asarray(t), np.asarray(always, dtype=bool)
        entries = int(np.searchsorted(t, t[0] + step, side="left"))
        free = np.flatnonzero(always[:entries])
        entries = min(len(t), (int(free[0]) if len(free) else entries) + 1)
        hop = next_kept(t, always, step).tolist()
        last = list(range(len(t)))
        for i in range(len(t) - 1, -1, -1):
            if hop[i] < len(t):
                last[i] = last[hop[i]]
        return t[:entries], bool(always[entries - 1]), t[last[:entries]]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLICE)
        last, carried = None, []
        for enter, free, leave in zip(pdf["enter"], pdf["free"], pdf["leave"], strict=True):
            carried.append(last)
            enter = np.asarray(enter)
            always = np.zeros(len(enter), dtype=bool)
            always[-1] = free
            i = first_kept(enter, always, step, last)
            if i < len(enter):
                last = int(leave[i])
        return pd.DataFrame(
            {
                KEY: pdf[KEY].to_numpy(),
                SLICE: pdf[SLICE].to_numpy(),
                "_last": pd.array(carried, dtype="Int64"),
            }
        )

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lasts = [None if pd.isna(x) else int(x) for x in pdf["_last"]]
            kept = [walk(*x) for x in zip(pdf["_us"], pdf["_free"], lasts, strict=True)]
            yield pd.DataFrame({KEY: pdf[KEY], "_kept": kept})

    def walk(t: np.ndarray, always: np.ndarray, last: int | None) -> np.ndarray:
        t, always = np.asarray(t), np.asarray(always, dtype=bool)
        hop = next_kept(t, always, step).tolist()
        i, kept = first_kept(t, always, step, last), []
        while i < len(t):
            kept.append(i)
            i = hop[i]
        return t[kept]

    starts = (
        slices.mapInPandas(
            outcomes,
            f"{KEY} string, {SLICE} long, enter array<long>, free boolean, leave array<long>",
        )
        .groupBy(KEY)
        .applyInPandas(chain, f"{KEY} string, {SLICE} long, _last long")
    )
    kept = slices.join(starts, [KEY, SLICE]).mapInPandas(thin, f"{KEY} string, _kept array<long>")
    kept = kept.select(KEY, F.explode("_kept").alias("_us"))
    return rows.join(kept, [KEY, "_us"], "left_semi").drop("_us")
