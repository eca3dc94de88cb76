"""Range joins on a grid, and the small dimension lookups.

No join here carries a broadcast hint: the planner broadcasts a side only when its measured
size is under the session's threshold, and splits skewed partitions of a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.functions.geo import (
    bearing_delta,
    cell_column,
    cell_id,
    cell_index,
    explode_ring,
    haversine_m,
)

# Match radius, box padding and altitude band.
AIRPORT_MATCH_M = 15_000.0
AIRPORT_PAD_DEG = 0.2
ALTITUDE_BAND_FT = 2000.0
# A 3x3 block of these cells reaches at least 25 km in every direction at mid latitudes.
PAIR_CELL_DEG = 0.3


def nearest_airport(
    points: DataFrame,
    airports: DataFrame,
    max_m: float = AIRPORT_MATCH_M,
    pad_deg: float = AIRPORT_PAD_DEG,
) -> DataFrame:
    """Add ``airport``: the nearest one inside the padded box and ``max_m``, else null.

    Airports are copied to the 3x3 cells around them and put together per cell (few each), so
    each point meets all its candidates by one equi-join on its own cell and stays one row,
    equal points too. Ties go to the greater code.
    """
    ports = explode_ring(
        airports.select(
            F.struct("icao", "lat", "lon").alias("_port"),
            cell_index("lat", pad_deg).alias("_r"),
            cell_column("lon", pad_deg).alias("_c"),
        ),
        1,
        "_r",
        "_c",
        ("_row", "_col"),
        pad_deg,
    )
    ports = ports.groupBy("_row", "_col").agg(F.collect_list("_port").alias("_ports"))
    located = points.select(
        "*", cell_index("lat", pad_deg).alias("_row"), cell_column("lon", pad_deg).alias("_col")
    )

    def candidate(p: Column) -> Column:
        m = haversine_m(F.col("lat"), F.col("lon"), p["lat"], p["lon"])
        near = (
            (F.abs(p["lat"] - F.col("lat")) <= pad_deg)
            & (F.abs(bearing_delta(F.col("lon"), p["lon"])) <= pad_deg)
            & (m <= max_m)
        )
        return F.when(near, F.struct((-m).alias("_d"), p["icao"].alias("_icao")))

    best = F.array_max(F.transform("_ports", candidate))
    return located.join(ports, ["_row", "_col"], "left").select(*points.columns, best["_icao"].alias("airport"))


def candidate_pairs(
    df: DataFrame, k: int = 1, band_ft: float = ALTITUDE_BAND_FT, size_deg: float = PAIR_CELL_DEG
) -> DataFrame:
    """Pairs of aircraft (``_a`` < ``_b``) at most ``k`` cells and ``band_ft`` feet apart.

    ``df`` has one row per aircraft with ``icao24, lat, lon, alt_ft``. The equi-join key holds
    the grid cell and the altitude band, so a crowded cell is cut by height before pairing.
    """
    placed = df.select(
        "icao24",
        "lat",
        "lon",
        "alt_ft",
        cell_index("lat", size_deg).alias("_row"),
        cell_column("lon", size_deg).alias("_col"),
        F.floor(F.col("alt_ft") / band_ft).cast("int").alias("_lev"),
    )
    ring = explode_ring(placed, k, "_row", "_col", ("_row2", "_col2"), size_deg).withColumn(
        "_lev2", F.explode(F.sequence(F.col("_lev") - 1, F.col("_lev") + 1))
    )
    left = ring.select(
        *[F.col(c).alias(f"{c}_a") for c in ("icao24", "lat", "lon", "alt_ft")],
        F.col("_row2").alias("_row"),
        F.col("_col2").alias("_col"),
        F.col("_lev2").alias("_lev"),
    )
    right = placed.select(
        *[F.col(c).alias(f"{c}_b") for c in ("icao24", "lat", "lon", "alt_ft")],
        "_row",
        "_col",
        "_lev",
    )
    return (
        left.join(right, ["_row", "_col", "_lev"])
        .where(
            (F.col("icao24_a") < F.col("icao24_b"))
            & (F.abs(F.col("alt_ft_a") - F.col("alt_ft_b")) <= band_ft)
        )
        .drop("_row", "_col", "_lev")
    )


def with_type(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Left lookup of ``type_code`` by aircraft; an unknown aircraft stays null."""
    return df.join(registry.select("icao24", "type_code"), "icao24", "left")


def with_mass(df: DataFrame, perf: DataFrame) -> DataFrame:
    """Add ``mass_kg``: half way from empty to maximum take-off weight.

    Null unless the aircraft is airborne, its type is known and altitude and speed are given.
    """
    table = perf.select(
        F.lower(F.trim("type_code")).alias("_type"), "oew_kg", "mtow_kg", F.col("wtc").alias("_wtc")
    )
    usable = (
        ~F.col("on_ground") & F.col("baro_alt_ft").isNotNull() & F.col("velocity_kt").isNotNull()
    )
    return (
        df.withColumn("_type", F.lower(F.trim("type_code")))
        .join(table, "_type", "left")
        .withColumn(
            "mass_kg",
            F.when(usable, F.col("oew_kg") + 0.5 * (F.col("mtow_kg") - F.col("oew_kg"))),
        )
        .withColumn("wtc", wake_category(F.col("_wtc")))
        .drop("_type", "_wtc", "oew_kg", "mtow_kg")
    )


def wake_category(wtc: Column) -> Column:
    """A listed wake category, else ``unknown``."""
    return F.when(wtc.isin("L", "M", "H", "J"), wtc).otherwise("unknown")


def subscription(cells: list[str], cap: int | None = None) -> list[str]:
    """A viewport's cells: repeats dropped in order; only a caller's ``cap`` cuts them."""
    return list(dict.fromkeys(cells))[:cap]


def in_cells(df: DataFrame, cells: list[str] | DataFrame, cell: str = "cell") -> DataFrame:
    """Rows whose cell is subscribed.

    A list becomes a filter that reaches the scan; a table of cells (column ``cell``), of any
    size, a semi join.
    """
    if isinstance(cells, DataFrame):
        return df.join(cells.select(F.col("cell").alias(cell)), cell, "left_semi").select(*df.columns)
    return df.where(F.col(cell).isin(subscription(cells)))


def with_cell(df: DataFrame, size_deg: float = PAIR_CELL_DEG) -> DataFrame:
    """Add the storage and subscription cell of each report."""
    return df.withColumn("cell", cell_id("lat", "lon", size_deg))
