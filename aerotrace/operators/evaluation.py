"""Splits, baselines, error metrics, calibration, quantile forecasts and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions.geo import enu_east, enu_north
from aerotrace.functions.quantiles import exact_quantiles
from aerotrace.operators.slicing import SLICE, attach_carry, time_slice
from aerotrace.operators.tracks import KEY

# Split fractions and duration buckets in minutes.
TRAIN_FRAC, VAL_FRAC = 0.70, 0.15
DURATION_BUCKETS = (("<15min", 0, 15), ("15-45min", 15, 45), ("45-120min", 45, 120),
                    (">120min", 120, None))
QUANTILE_PROBS = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
AXES = ("east_m", "north_m", "alt_ft")


def _check_fractions(train: float, val: float) -> None:
    if not (0 < train < 1) or not (0 < val < 1) or train + val >= 1:
        raise ValueError("train and val must be in (0, 1) and sum to < 1")


def chronological_split(
    df: DataFrame, ts: str, train: float = TRAIN_FRAC, val: float = VAL_FRAC
) -> DataFrame:
    """Add ``fold`` by elapsed time between the first and last timestamp; cuts are half-open.
    A row without a time has no fold.

    The two bounds are read first (one row), so a later filter on the fold is a plain comparison
    with literals that reaches the scan.
    """
    _check_fractions(train, val)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    cut = lambda f: F.lit(None if lo is None else lo + float(hi - lo) * f)
    return df.withColumn(
        "fold",
        F.when(us < cut(train), "train").when(us < cut(train + val), "val").when(us.isNotNull(), "test"),
    )


def bucket_split(
    grid: DataFrame, bucket: str = "bucket", train: float = TRAIN_FRAC, val: float = VAL_FRAC
) -> DataFrame:
    """Add ``fold`` by position of the bucket on the even time axis; none without a bucket."""
    _check_fractions(train, val)
    lo, hi = grid.agg(F.min(bucket), F.max(bucket)).first()
    if lo is None:
        return grid.withColumn("fold", F.lit(None).cast("string"))
    total = hi - lo + 1
    b = F.col(bucket)
    return grid.withColumn(
        "fold",
        F.when(b < lo + int(total * train), "train")
        .when(b < lo + int(total * (train + val)), "val")
        .when(b.isNotNull(), "test"),
    )


def eta_baselines(df: DataFrame) -> DataFrame:
    """Predict no delay, and the departure delay unchanged."""
    return df.withColumn("pred_zero", F.lit(0.0)).withColumn("pred_carry", F.col("dep_delay_min"))


def eta_metrics(df: DataFrame, y: str, pred: str, duration: str) -> DataFrame:
    """MAE, P90 of the absolute error and count, overall and by duration bucket (empty ones omitted)."""
    d = F.col(duration)
    label = None
    for name, lo, hi in DURATION_BUCKETS:
        test = (d >= lo) if hi is None else (d >= lo) & (d < hi)
        label = F.when(test, name) if label is None else label.when(test, name)
    errors = df.select(
        F.explode(F.array_compact(F.array(F.lit("overall"), label))).alias("bucket"),
        F.abs(F.col(y) - F.col(pred)).alias("err"),
    )
    means = errors.groupBy("bucket").agg(F.avg("err").alias("mae_min"))
    return means.join(exact_quantiles(errors, ["bucket"], "err", {"p90_min": 0.9}), "bucket")


def horizon_mae_rmse(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """MAE and RMSE per horizon over rows with a target."""
    diff = F.col(pred) - F.col(y)
    return df.where(F.col(y).isNotNull()).groupBy("horizon").agg(
        F.avg(F.abs(diff)).alias("mae_min"),
        F.sqrt(F.avg(diff * diff)).alias("rmse_min"),
        F.count(F.lit(1)).alias("n"),
    )


def trajectory_errors(df: DataFrame) -> DataFrame:
    """Median and P90 horizontal error in km per horizon; needs ``y_*`` and ``pred_*`` offsets."""
    de = F.col("pred_east_m") - F.col("y_east_m")
    dn = F.col("pred_north_m") - F.col("y_north_m")
    errors = df.select("horizon_s", (F.sqrt(de * de + dn * dn) / 1000.0).alias("km"))
    return exact_quantiles(
        errors, ["horizon_s"], "km", {"median_error_km": 0.5, "p90_error_km": 0.9}
    )


def pinball(y: Column, pred: Column, q: float) -> Column:
    return F.greatest(q * (y - pred), (q - 1) * (y - pred))


def calibration(df: DataFrame, pit_axis: str = "east_m") -> DataFrame:
    """Per horizon: 80% box coverage, the four PIT shares of one axis, three-point CRPS."""
    y = lambda a: F.col(f"y_{a}")
    q = lambda k, a: F.col(f"{k}_{a}")
    inside = F.lit(True)
    for a in ("east_m", "north_m"):
        inside = inside & y(a).between(q("q10", a), q("q90", a))
    a = pit_axis
    share = lambda c: F.avg(c.cast("double"))
    losses = [
        pinball(y(ax), q(k, ax), p)
        for ax in ("east_m", "north_m")
        for k, p in QUANTILE_PROBS.items()
    ]
    return df.where(y("east_m").isNotNull()).groupBy("horizon_s").agg(
        F.count(F.lit(1)).alias("n"),
        share(inside).alias("coverage_80"),
        share(y(a) < q("q10", a)).alias("below_q10"),
        share((y(a) >= q("q10", a)) & (y(a) < q("q50", a))).alias("q10_to_q50"),
        share((y(a) >= q("q50", a)) & (y(a) < q("q90", a))).alias("q50_to_q90"),
        share(y(a) >= q("q90", a)).alias("above_q90"),
        F.avg(sum(losses[1:], losses[0]) / len(losses)).alias("crps"),
    )


def residuals(forecast: DataFrame) -> DataFrame:
    """Long residuals: one row per forecast and axis that has a target."""
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("axis"), (F.col(f"y_{a}") - F.col(f"pred_{a}")).alias("r")
                )
                for a in AXES
            ]
        )
    )
    return (
        forecast.where(F.col("y_east_m").isNotNull())
        .select("horizon_s", "phase", each.alias("x"))
        .select("horizon_s", "phase", "x.axis", "x.r")
    )


def quantile_forecast(train: DataFrame) -> DataFrame:
    """Residual quantiles per (horizon, phase, axis), fitted on a training fold."""
    return exact_quantiles(residuals(train), ["horizon_s", "phase", "axis"], "r", QUANTILE_PROBS)


def pooled_quantiles(train: DataFrame) -> DataFrame:
    """Residual quantiles per (horizon, axis) over all phases, with a null phase: what
    ``apply_quantiles`` falls back to for a phase without residuals."""
    pooled = exact_quantiles(residuals(train), ["horizon_s", "axis"], "r", QUANTILE_PROBS)
    return pooled.withColumn("phase", F.lit(None).cast("string"))


def quantile_model(train: DataFrame) -> DataFrame:
    """The quantiles per phase and the pooled ones."""
    return quantile_forecast(train).unionByName(pooled_quantiles(train))


def apply_quantiles(points: DataFrame, model: DataFrame) -> DataFrame:
    """Point forecasts widened to quantiles. An unseen phase takes the pooled quantiles of the
    horizon; without those its quantiles are null.

    The model has one row per horizon, phase and axis (a few hundred at most).
    """

    def wide(rows: DataFrame, prefix: str, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            *[
                F.max(F.when(F.col("axis") == a, F.col(k))).alias(f"{prefix}_{k}_{a}")
                for a in AXES
                for k in QUANTILE_PROBS
            ]
        )

    own = wide(model.where("phase is not null"), "r", "horizon_s", "phase")
    pooled = wide(model.where("phase is null"), "p", "horizon_s")
    joined = points.join(F.broadcast(own), ["horizon_s", "phase"], "left").join(
        F.broadcast(pooled), "horizon_s", "left"
    )
    return joined.select(
        *points.columns,
        *[
            (F.col(f"pred_{a}") + F.coalesce(f"r_{k}_{a}", f"p_{k}_{a}")).alias(f"{k}_{a}")
            for a in AXES
            for k in QUANTILE_PROBS
        ],
    )


def with_targets(forecast: DataFrame) -> DataFrame:
    """Flatten a window's target of the forecast's horizon into ``y_*`` offsets from its anchor."""
    p = F.element_at("points", -1)
    t = F.filter("targets", lambda x: x["horizon_s"] == F.col("horizon_s"))[0]
    found = t["ms"].isNotNull()
    return (
        forecast.withColumn("y_east_m", enu_east(t["lat"], t["lon"], p["lat"], p["lon"]))
        .withColumn("y_north_m", enu_north(t["lat"], t["lon"], p["lat"], p["lon"]))
        .withColumn(
            "y_alt_ft", F.when(found, F.coalesce(t["alt_ft"] - p["baro_alt_ft"], F.lit(0.0)))
        )
    )


def score_predictions(pred: DataFrame, truth: DataFrame, tol_s: int = 3) -> DataFrame:
    """Predictions joined to the report nearest to issue time plus horizon, with their errors.

    An equi-join on (aircraft, tolerance-wide time bucket) over the three buckets that can hold
    a match; the nearest one is taken by an aggregate, the earlier one on a tie. ``pred`` needs
    ``icao24, issued_at, horizon_s, lat0, lon0, phase`` and the quantiles. Both sides grow with
    the input, so neither is broadcast, however small its files are.
    """
    width = tol_s * 1000
    due = F.unix_millis("issued_at") + F.col("horizon_s") * 1000
    wanted = pred.withColumn("_row", F.monotonically_increasing_id()).withColumn("_due", due).withColumn(
        "_b", F.explode(F.array(*[F.floor(F.col("_due") / width) + d for d in (-1, 0, 1)]))
    )
    seen = truth.select(
        KEY,
        F.unix_millis("ts").alias("_ms"),
        F.floor(F.unix_millis("ts") / width).alias("_b"),
        F.col("lat").alias("_lat"),
        F.col("lon").alias("_lon"),
    )
    off = F.abs(F.col("_ms") - F.col("_due"))
    matched = (
        wanted.join(seen.hint("merge"), [KEY, "_b"])
        .where(off <= width)
        .groupBy("_row", *pred.columns)
        .agg(F.min_by(F.struct("_ms", "_lat", "_lon"), F.struct(off, F.col("_ms"))).alias("t"))
    )
    return matched.select(
        KEY, "issued_at", "horizon_s", "phase", F.timestamp_millis("t._ms").alias("truth_ts"),
        *score_columns("t._lat", "t._lon"),
    )


def score_columns(lat: str, lon: str) -> list[Column]:
    """Error, pinball loss and coverage of a quantile forecast against a true position."""
    e, n = enu_east(lat, lon, "lat0", "lon0"), enu_north(lat, lon, "lat0", "lon0")
    losses = [
        pinball(y, F.col(f"{k}_{a}"), p)
        for a, y in (("east_m", e), ("north_m", n))
        for k, p in QUANTILE_PROBS.items()
    ]
    de, dn = F.col("q50_east_m") - e, F.col("q50_north_m") - n
    inside = e.between(F.col("q10_east_m"), F.col("q90_east_m")) & n.between(F.col("q10_north_m"), F.col("q90_north_m"))
    return [
        (F.sqrt(de * de + dn * dn) / 1000.0).alias("error_km"),
        (sum(losses[1:], losses[0]) / len(losses)).alias("crps"),
        inside.alias("in_80"),
    ]


def ranking_metrics(
    df: DataFrame, score: str = "score", label: str = "label", bins: int | None = None
) -> DataFrame:
    """Average precision and precision at k = number of positives; null if one class only.

    Scores are counted per distinct value, cut into quantile bins, and the bins' counts are
    carried, so no task sees the whole ranking; there are several bins to each shuffle partition.
    Equal scores count as one threshold; if the
    k-th place falls inside a tie the tied rows count with their share.
    """
    bins = bins or max(128, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = df.select(F.col(score).alias("s"), F.col(label).cast("int").alias("l")).withColumn(
        "_all", F.lit(1)
    )
    facts = base.agg(
        F.percentile_approx("s", F.array(*[F.lit(i / bins) for i in range(1, bins)]), 10_000),
        F.count(F.lit(1)),
        F.sum("l"),
    ).first()
    cuts, n_all, n_pos = facts[0] or [], facts[1], facts[2] or 0
    counts = base.groupBy("_all", "s").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l").alias("p")
    )
    limits = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    binned = counts.withColumn(
        SLICE, -F.size(F.filter(limits, lambda c: c < F.col("s"))).cast("long")
    )
    here = (
        Window.partitionBy("_all", SLICE)
        .orderBy(F.col("s").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = attach_carry(
        binned,
        ["_all"],
        [F.sum("n").alias("_n"), F.sum("p").alias("_p")],
        lambda earlier: [F.sum("_n").over(earlier).alias("_n0"), F.sum("_p").over(earlier).alias("_p0")],
    )
    ranked = carried.select(
        "n",
        "p",
        (F.sum("n").over(here) + F.coalesce("_n0", F.lit(0))).alias("cn"),
        (F.sum("p").over(here) + F.coalesce("_p0", F.lit(0))).alias("cp"),
    )
    # Positives of a tie that reaches over the k-th place count with their share.
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(n_pos) - (F.col("cn") - F.col("n"))))
    both = F.lit(0 < n_pos < n_all)
    return ranked.agg(
        F.lit(n_all).cast("long").alias("n"),
        F.lit(n_pos).cast("long").alias("n_positive"),
        F.when(both, F.sum(F.col("p") * F.col("cp") / F.col("cn")) / max(n_pos, 1)).alias("pr_auc"),
        F.when(both, F.sum(F.col("p") * taken / F.col("n")) / max(n_pos, 1)).alias(
            "precision_at_k"
        ),
    )


def promotion_gate(runs: DataFrame, slice_s: int = 86_400) -> DataFrame:
    """Per kind in training order: promoted iff strictly better than all before (or the first).

    The champion is always the running minimum, carried between days.
    """
    order = ["trained_at", "version"]
    sliced = runs.withColumn(SLICE, time_slice("trained_at", slice_s))
    here = (
        Window.partitionBy("kind", SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = attach_carry(
        sliced,
        ["kind"],
        [F.min("metric").alias("_best")],
        lambda earlier: [F.min("_best").over(earlier).alias("_champion0")],
    )
    return (
        carried.withColumn("champion_metric", F.least(F.min("metric").over(here), "_champion0"))
        .withColumn(
            "promoted",
            F.col("champion_metric").isNull() | (F.col("metric") < F.col("champion_metric")),
        )
        .drop("_champion0", SLICE)
    )


def scorecard(runs: DataFrame, kind: str | None = None) -> DataFrame:
    """The promoted run per kind: best metric, the earliest trained on a tie."""
    if kind is not None:
        runs = runs.where(F.col("kind") == kind)
    return (
        runs.groupBy("kind")
        .agg(
            F.min_by(
                F.struct("version", "trained_at", "metric"),
                F.struct("metric", "trained_at", "version"),
            ).alias("_best")
        )
        .select("kind", "_best.*")
        .orderBy("kind")
    )
