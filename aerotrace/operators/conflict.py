"""Conflict probability: candidate pairs, seeded draws, share of draws that come too close."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.functions.draws import hash_uniforms, triangular
from aerotrace.functions.geo import enu_east, enu_north, in_bbox
from aerotrace.operators.evaluation import apply_quantiles
from aerotrace.operators.serving import fresh, latest_of
from aerotrace.operators.spatial import candidate_pairs
from aerotrace.operators.tracks import KEY
from aerotrace.operators.windows import HORIZONS_S, constant_velocity, latest_window

# Separation limits, draws, seed.
SEPARATION_M = 5.0 * 1852.0
SEPARATION_FT = 1000.0
SAMPLES = 200
SEED = 20240101
# Margin in metres or feet inside which the bounds leave a decision to the draws.
SLACK = 1e-3

AXES = ("east_m", "north_m", "alt_ft")
QUANTILES = ("q10", "q50", "q90")


def conflict_probability(
    pairs: DataFrame,
    forecasts: DataFrame,
    n: int = SAMPLES,
    seed: int = SEED,
    horizons: tuple[int, ...] = HORIZONS_S,
) -> DataFrame:
    """Probability of horizontal < 5 NM and vertical < 1000 ft at any shared horizon.

    ``forecasts`` has one row per aircraft and horizon with the three quantiles of the offset on
    each axis (``q10_east_m`` ...). Pairs without forecasts on both sides are left out. The
    horizons are columns, so a pair fans out to its ``n`` draws only, and those are averaged
    before anything is shuffled. Draws are bounded by their quantiles: pairs that must or cannot
    conflict are settled by the bounds and need no draws.
    """
    fields = [f"{q}_{a}" for a in AXES for q in QUANTILES]
    wide = forecasts.groupBy(KEY).agg(
        *[
            F.max(F.when(F.col("horizon_s") == h, F.struct(*fields))).alias(f"h{h}")
            for h in horizons
        ]
    )
    side = lambda s: wide.select(
        F.col(KEY).alias(f"{KEY}_{s}"), *[F.col(f"h{h}").alias(f"h{h}_{s}") for h in horizons]
    )
    placed = (
        pairs.join(side("a"), f"{KEY}_a")
        .join(side("b"), f"{KEY}_b")
        .withColumn("_e0", enu_east("lat_b", "lon_b", "lat_a", "lon_a"))
        .withColumn("_n0", enu_north("lat_b", "lon_b", "lat_a", "lon_a"))
    )

    # Each step reads columns of the step before it. As one expression the formulas would repeat
    # their inputs at every use, and planning would take longer than the draws.
    base = {
        "east_m": -F.col("_e0"),
        "north_m": -F.col("_n0"),
        "alt_ft": F.col("alt_ft_a") - F.col("alt_ft_b"),
    }

    def bounds(h: int, axis: str) -> list[Column]:
        """Least and greatest difference a - b the bounded draws allow on one axis."""
        a, b = ([F.col(f"h{h}_{s}")[f"{k}_{axis}"] for k in QUANTILES] for s in "ab")
        return [
            (F.least(*a) - F.greatest(*b) + base[axis]).alias(f"_lo{h}_{axis}"),
            (F.greatest(*a) - F.least(*b) + base[axis]).alias(f"_hi{h}_{axis}"),
        ]

    def reach(h: int, axis: str) -> list[Column]:
        """The smallest and the largest distance between these two."""
        lo, hi = F.col(f"_lo{h}_{axis}"), F.col(f"_hi{h}_{axis}")
        return [
            F.greatest(lo, -hi, F.lit(0.0)).alias(f"_away{h}_{axis}"),
            F.greatest(F.abs(lo), F.abs(hi)).alias(f"_far{h}_{axis}"),
        ]

    def decided(h: int) -> list[Column]:
        """Whether horizon ``h`` is a conflict for every draw, and whether it can be for any."""
        away, far = ([F.col(f"{name}{h}_{axis}") for axis in AXES] for name in ("_away", "_far"))
        sure = (F.hypot(*far[:2]) < SEPARATION_M - SLACK) & (far[2] < SEPARATION_FT - SLACK)
        never = (F.hypot(*away[:2]) >= SEPARATION_M + SLACK) | (away[2] >= SEPARATION_FT + SLACK)
        no = F.lit(False)
        return [
            F.coalesce(sure, no).alias(f"_sure{h}"),
            F.coalesce(~never, no).alias(f"_open{h}"),
        ]

    for step in (bounds, reach):
        placed = placed.select("*", *[c for h in horizons for axis in AXES for c in step(h, axis)])
    any_of = lambda name: reduce(
        lambda x, y: x | y, [F.col(f"{name}{h}") for h in horizons]
    )
    placed = placed.select("*", *[c for h in horizons for c in decided(h)]).select(
        f"{KEY}_a",
        f"{KEY}_b",
        "_e0",
        "_n0",
        "alt_ft_a",
        "alt_ft_b",
        *[f"h{h}_{s}" for h in horizons for s in "ab"],
        *[f"_open{h}" for h in horizons],
        any_of("_sure").alias("_sure"),
        any_of("_open").alias("_any_open"),
    )
    drawn = F.explode(
        F.sequence(F.lit(1), F.when(F.col("_any_open") & ~F.col("_sure"), n).otherwise(1))
    )
    sides = [(s, axis) for s in "ab" for axis in AXES]

    def uniforms(h: int) -> list[Column]:
        us = hash_uniforms(seed, f"{KEY}_a", f"{KEY}_b", "_draw", F.lit(h), count=len(sides))
        return [u.alias(f"_u{h}_{s}_{axis}") for u, (s, axis) in zip(us, sides)]

    def draw(h: int, s: str, axis: str) -> Column:
        quantiles = [F.col(f"h{h}_{s}")[f"{k}_{axis}"] for k in QUANTILES]
        return triangular(f"_u{h}_{s}_{axis}", *quantiles).alias(f"_x{h}_{s}_{axis}")

    def close(h: int) -> Column:
        x = lambda s, axis: F.col(f"_x{h}_{s}_{axis}")
        de = x("a", "east_m") - F.col("_e0") - x("b", "east_m")
        dn = x("a", "north_m") - F.col("_n0") - x("b", "north_m")
        dv = F.col("alt_ft_a") + x("a", "alt_ft") - F.col("alt_ft_b") - x("b", "alt_ft")
        near = (F.hypot(de, dn) < SEPARATION_M) & (F.abs(dv) < SEPARATION_FT)
        return F.col(f"_open{h}") & F.coalesce(near, F.lit(False))

    placed = (
        placed.withColumn("_draw", drawn)
        .select("*", *[u for h in horizons for u in uniforms(h)])
        .select("*", *[draw(h, s, axis) for h in horizons for s, axis in sides])
    )
    hit = reduce(lambda x, y: x | y, [close(h) for h in horizons], F.col("_sure"))
    return placed.groupBy(f"{KEY}_a", f"{KEY}_b").agg(
        F.avg(hit.cast("double")).alias("probability")
    )


def snapshot(df: DataFrame, bbox: tuple[float, float, float, float], as_of) -> DataFrame:
    """Latest fresh in-box position with an altitude, per aircraft."""
    rows = fresh(df, as_of).where(
        in_bbox("lat", "lon", bbox) & F.col("baro_alt_ft").isNotNull()
    ).select(KEY, "ts", "lat", "lon", F.col("baro_alt_ft").alias("alt_ft"))
    return latest_of(rows)


def forecasts_for(df: DataFrame, model: DataFrame, horizons: tuple[int, ...] = HORIZONS_S) -> DataFrame:
    """Quantile forecasts from each aircraft's latest window."""
    return apply_quantiles(constant_velocity(latest_window(df), horizons), model)


def conflicts(
    df: DataFrame,
    bbox: tuple[float, float, float, float],
    as_of,
    model: DataFrame,
    min_prob: float = 0.1,
    n: int = SAMPLES,
    seed: int = SEED,
    horizons: tuple[int, ...] = HORIZONS_S,
) -> DataFrame:
    """Pairs in the box with at least ``min_prob``; only involved aircraft are forecast."""
    pairs = candidate_pairs(snapshot(df, bbox, as_of))
    involved = (
        pairs.select(F.col(f"{KEY}_a").alias(KEY))
        .unionByName(pairs.select(F.col(f"{KEY}_b").alias(KEY)))
        .distinct()
    )
    known = df.where(F.col("ts") <= F.lit(as_of).cast("timestamp")).join(involved, KEY, "left_semi")
    scored = conflict_probability(pairs, forecasts_for(known, model, horizons), n, seed, horizons)
    return scored.where(F.col("probability") >= min_prob)
