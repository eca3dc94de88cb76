"""Raw reports to clean keyed tables: normalise, reject, dedupe, upsert, retain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.schemas import RAW_REPORT

# Retention of the raw table and the two rollups, in hours.
RETENTION_H = {"raw": 6, "15s": 30 * 24, "60s": 365 * 24}


def parse_reports(df: DataFrame, value: str = "value", received_at: str = "received_at") -> DataFrame:
    """Parse JSON records and add ``reason``: null for a usable report, else why it is dropped.

    Time of a report is its receipt time minus ``seen_pos``. A barometric altitude of
    ``"ground"`` means on the ground with no altitude; numbers that do not parse become null.
    """
    r = F.from_json(F.col(value), RAW_REPORT)
    num = lambda f: F.col(f"_r.{f}").try_cast("double")
    raw = df.withColumn("_r", r)
    hexcode = F.col("_r.hex")
    ground = F.coalesce(F.col("_r.alt_baro") == "ground", F.lit(False))
    key = F.lower(F.trim(hexcode))
    lat, lon = num("lat"), num("lon")
    seen = F.coalesce(num("seen_pos"), F.lit(0.0))
    reason = (
        F.when(F.col("_r").isNull() | hexcode.isNull() | (hexcode == ""), "no_hex")
        .when(F.col("_r.lat").isNull() | F.col("_r.lon").isNull(), "no_position")
        .when(hexcode.startswith("~"), "not_icao")
        .when((key == "") | (F.length(key) > 6), "bad_hex")
        .when(lat.isNull() | lon.isNull(), "bad_position")
        .when(~lat.between(-90, 90), "lat_range")
        .when(~lon.between(-180, 180), "lon_range")
    )
    keep = [c for c in df.columns if c != value]
    return raw.select(
        *keep,
        key.alias("icao24"),
        F.timestamp_micros(
            F.unix_micros(F.col(received_at).cast("timestamp"))
            - F.round(seen * 1_000_000).cast("long")
        ).alias("ts"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.when(~ground, num("alt_baro")).alias("baro_alt_ft"),
        num("alt_geom").alias("geo_alt_ft"),
        num("gs").alias("velocity_kt"),
        num("track").alias("heading_deg"),
        num("baro_rate").alias("vert_rate_fpm"),
        ground.alias("on_ground"),
        F.col("_r.squawk").alias("squawk"),
        F.lit("adsb_lol").alias("source"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.col(value)).alias("rejected_value"),
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable reports, rejected records with their reason)."""
    good = df.where(F.col("reason").isNull()).drop("reason", "rejected_value")
    bad = df.where(F.col("reason").isNotNull()).select(
        *[c for c in ("received_at", "seq") if c in df.columns], "rejected_value", "reason"
    )
    return good, bad


def normalize_reports(df: DataFrame, **kw) -> DataFrame:
    """JSON records to position reports; unusable records are left out."""
    return split_valid(parse_reports(df, **kw))[0]


def _pick(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def dedupe_latest(
    df: DataFrame, key: str = "icao24", ts: str = "ts", arrival: str = "seq"
) -> DataFrame:
    """Latest report per key; among equal times the first to arrive."""
    return _pick(df, [key], F.struct(F.col(ts), -F.col(arrival)))


def first_per_key(df: DataFrame, key: str = "icao24", arrival: str = "seq") -> DataFrame:
    """First report per key in arrival order (overlapping tiles)."""
    return _pick(df, [key], -F.col(arrival))


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: tuple[str, ...] = ("icao24", "ts"),
    version: str = "seq",
) -> DataFrame:
    """Merge by key: a newer delivery replaces all non-key columns."""
    merged = existing.unionByName(incoming, allowMissingColumns=True)
    return _pick(merged, list(keys), F.col(version))


def replace_keys(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Delete every row whose key occurs in ``incoming``, then add ``incoming``."""
    kept = existing.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming)


def retain(df: DataFrame, as_of: str, tier: str, ts: str = "ts") -> DataFrame:
    """Rows still inside the tier's retention at ``as_of``.

    On a table partitioned by ``dt`` the derived date bound lets whole folders be skipped.
    """
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {RETENTION_H[tier]} HOURS")
    kept = df.where(F.col(ts) >= limit)
    if "dt" in df.columns:
        kept = kept.where(F.col("dt") >= F.date_format(limit, "yyyy-MM-dd"))
    return kept
