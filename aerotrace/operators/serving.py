"""Read queries: latest positions, tracks, viewports, feeds, details and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions.geo import in_bbox
from aerotrace.operators.slicing import SLICE, row_number_sliced, time_slice
from aerotrace.operators.spatial import in_cells
from aerotrace.operators.tracks import KEY

# Fixed value: poll interval plus margin is how old a live row may be.
STALE_S = 120

POSITION = ("icao24", "ts", "lat", "lon", "baro_alt_ft", "velocity_kt", "heading_deg",
            "vert_rate_fpm", "on_ground")


def _instant(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def fresh(df: DataFrame, as_of, stale_s: float = STALE_S) -> DataFrame:
    """Reports at most ``stale_s`` old at ``as_of`` (and not from after it)."""
    t = _instant(as_of)
    lo = t - F.make_dt_interval(secs=F.lit(stale_s))
    return _folders(df.where((F.col("ts") > lo) & (F.col("ts") <= t)), lo, t)


def _folders(df: DataFrame, lo: Column | None, hi: Column | None) -> DataFrame:
    """In the archive's layout, bounds on the folders as well, so that whole ones are skipped."""
    if "dt" in df.columns and "hour" in df.columns:
        for bound, above in ((lo, True), (hi, False)):
            if bound is not None:
                day, hour = F.date_format(bound, "yyyy-MM-dd"), F.hour(bound)
                at = F.col("dt").cast("string")
                past = (at > day) | ((at == day) & (F.col("hour").cast("int") >= hour))
                before = (at < day) | ((at == day) & (F.col("hour").cast("int") <= hour))
                df = df.where(past if above else before)
    return df


def latest_of(df: DataFrame, key: str = KEY, ts: str = "ts") -> DataFrame:
    """Newest row per key, as an aggregate combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_best"))
        .select(key, "_best.*")
        .select(*df.columns)
    )


def latest_in_bbox(
    df: DataFrame,
    bbox: tuple[float, float, float, float],
    as_of,
    stale_s: float = STALE_S,
    limit: int | None = None,
) -> DataFrame:
    """Latest in-box fresh row per aircraft, ordered by aircraft.

    The box is applied first: an aircraft that has left still shows its last row inside.
    """
    inside = fresh(df, as_of, stale_s).where(in_bbox("lat", "lon", bbox)).select(*POSITION)
    return _first(latest_of(inside).orderBy(KEY), limit)


def latest_in_cells(df: DataFrame, cells: list[str], as_of, stale_s: float = STALE_S) -> DataFrame:
    """Full frame of a viewport: latest fresh row per aircraft among the subscribed cells."""
    return latest_of(in_cells(fresh(df, as_of, stale_s), cells).select(*POSITION))


def _first(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def track(df: DataFrame, key: str, t0, t1, limit: int | None = None) -> DataFrame:
    """One aircraft's reports between two times, ascending; only a caller's ``limit`` cuts them."""
    found = _between(df, t0, t1).where(F.col(KEY) == key.lower()).select(*POSITION)
    return _first(found.orderBy("ts"), limit)


def tracks(df: DataFrame, t0, t1, limit: int | None = None, slice_s: int = 3600) -> DataFrame:
    """The same for every aircraft at once, with its position ``pos`` in the interval.

    Positions are counted per (aircraft, slice) and carried. With a ``limit`` the rank filter
    is also applied before the shuffle, so a crowded aircraft sends few rows per task.
    """
    found = _between(df, t0, t1).select(*POSITION)
    if limit is not None:
        order = Window.partitionBy(KEY).orderBy("ts")
        ranked = found.withColumn("pos", F.row_number().over(order).cast("long"))
        return ranked.where(F.col("pos") <= limit)
    sliced = found.withColumn(SLICE, time_slice("ts", slice_s))
    return row_number_sliced(sliced, [KEY], ["ts"], "pos").drop(SLICE)


def _between(df: DataFrame, t0, t1) -> DataFrame:
    lo, hi = _instant(t0), _instant(t1)
    return _folders(df.where(F.col("ts").between(lo, hi)), lo, hi)


def anomaly_feed(
    df: DataFrame, since, kind: str | None = None, limit: int | None = None
) -> DataFrame:
    """Anomalies since a time, optionally of one kind, newest first."""
    found = _folders(df.where(F.col("ts") >= _instant(since)), _instant(since), None)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    return _first(found.orderBy(F.col("ts").desc(), KEY, "kind"), limit)


def airport_detail(airports: DataFrame, runways: DataFrame) -> DataFrame:
    """Airports with their runway ends as a nested, ordered list (empty if none)."""
    ends = runways.groupBy(F.col("airport_icao").alias("icao")).agg(
        F.sort_array(
            F.collect_list(
                F.struct("ident", F.col("true_heading_deg").alias("heading_deg"), "length_ft")
            )
        ).alias("runways")
    )
    return airports.join(ends, "icao", "left").withColumn(
        "runways", F.coalesce("runways", F.array())
    )


def top_delayed(waits: DataFrame, n: int = 20) -> DataFrame:
    """Flights with the largest added delay."""
    return waits.orderBy(
        F.col("added_delay_min").desc(), "airport", "day", "scheduled_minute", "flight_id",
        "queue_pos",
    ).limit(n)


def top_neighbors(edges: DataFrame, n: int = 5) -> DataFrame:
    """Strongest flow neighbours of each airport, itself left out."""
    order = Window.partitionBy("src").orderBy(F.col("w").desc(), "dst")
    ranked = edges.where((F.col("src") != F.col("dst")) & (F.col("w") > 0)).withColumn(
        "rank", F.row_number().over(order).cast("long")
    )
    return ranked.where(F.col("rank") <= n)


def similar(emb: DataFrame, query: Column, k: int) -> DataFrame:
    """The ``k`` embeddings of greatest cosine similarity to one query vector."""
    norm = lambda v: F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )
    dot = F.aggregate(
        F.zip_with("embedding", "_q", lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return (
        emb.withColumn("_q", query)
        .withColumn("cosine", dot / (norm(F.col("embedding")) * norm(F.col("_q"))))
        .select("flight_id", "cosine")
        .orderBy(F.col("cosine").desc(), "flight_id")
        .limit(k)
    )


def state_as_of(df: DataFrame, t) -> DataFrame:
    """World state at a time: latest row per aircraft not after it."""
    return latest_of(_folders(df.where(F.col("ts") <= _instant(t)), None, _instant(t)))


def counts_by(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row counts by kind or source (the service counters)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
