"""Geodesy as column expressions: great circles, a local flat frame, boxes and grid cells.

Everything here stays inside generated code, so the functions can sit in projections, join
conditions and aggregates without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: mean earth radius in metres.
EARTH_RADIUS_M = 6_371_008.8


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def destination_lat(lat, lon, bearing, dist_m) -> Column:
    """Latitude reached after ``dist_m`` along a great circle."""
    lat, bearing, dist_m = map(_c, (lat, bearing, dist_m))
    p, d = F.radians(lat), dist_m / EARTH_RADIUS_M
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(F.radians(bearing))
    return F.degrees(F.asin(s))


def destination_lon(lat, lon, bearing, dist_m) -> Column:
    """Longitude reached after ``dist_m`` along a great circle, wrapped to [-180, 180)."""
    lat_c, lon_c, bearing_c, dist_c = map(_c, (lat, lon, bearing, dist_m))
    p, d, b = F.radians(lat_c), dist_c / EARTH_RADIUS_M, F.radians(bearing_c)
    p2 = F.radians(destination_lat(lat, lon, bearing, dist_m))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.pmod(lon_c + F.degrees(turn) + 540.0, F.lit(360.0)) - 180.0


def enu_east(lat, lon, lat0, lon0) -> Column:
    """Metres east of an anchor in the local flat frame."""
    lon, lat0, lon0 = map(_c, (lon, lat0, lon0))
    return F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0))


def enu_north(lat, lon, lat0, lon0) -> Column:
    """Metres north of an anchor in the local flat frame."""
    lat, lat0 = _c(lat), _c(lat0)
    return F.radians(lat - lat0) * EARTH_RADIUS_M


def from_enu_lat(east, north, lat0, lon0) -> Column:
    return _c(lat0) + F.degrees(_c(north) / EARTH_RADIUS_M)


def from_enu_lon(east, north, lat0, lon0) -> Column:
    return _c(lon0) + F.degrees(_c(east) / (EARTH_RADIUS_M * F.cos(F.radians(_c(lat0)))))


def bearing_delta(a, b) -> Column:
    """Signed shortest turn from ``a`` to ``b``, in [-180, 180)."""
    return F.pmod(_c(b) - _c(a) + 180.0, F.lit(360.0)) - 180.0


def check_bbox(bbox: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    min_lat, max_lat, min_lon, max_lon = bbox
    if min_lat > max_lat or min_lon > max_lon:
        raise ValueError("bbox min must be <= max")
    return bbox


def in_bbox(lat, lon, bbox: tuple[float, float, float, float]) -> Column:
    """Inclusive box test; ``bbox`` is (min_lat, max_lat, min_lon, max_lon)."""
    min_lat, max_lat, min_lon, max_lon = check_bbox(bbox)
    return _c(lat).between(min_lat, max_lat) & _c(lon).between(min_lon, max_lon)


def cell_index(v, size_deg: float) -> Column:
    """Integer grid index of one coordinate."""
    return F.floor(_c(v) / F.lit(float(size_deg))).cast("int")


def cell_id(lat, lon, size_deg: float) -> Column:
    """Square grid cell id as text ``row:col``."""
    return F.concat_ws(
        ":", cell_index(lat, size_deg).cast("string"), cell_index(lon, size_deg).cast("string")
    )


def cell_column(lon, size_deg: float) -> Column:
    """Grid column of a longitude, counted round the globe from 0.

    The cells must divide the circle, so that the column after the last one is the first.
    """
    columns = round(360.0 / size_deg)
    if abs(columns * size_deg - 360.0) > 1e-6:
        raise ValueError("cells must divide 360 degrees")
    return F.pmod(cell_index(lon, size_deg), F.lit(columns))


def explode_ring(
    df: DataFrame, k: int, row: str, col: str, out: tuple[str, str], size_deg: float
) -> DataFrame:
    """One output row per cell within ``k`` rings of the row's own cell (a (2k+1)^2 fan-out).

    Columns go round the globe: next to the last one is column 0.
    """
    steps = F.sequence(F.lit(-k), F.lit(k))
    return (
        df.withColumn("_dr", F.explode(steps))
        .withColumn("_dc", F.explode(steps))
        .withColumn(out[0], F.col(row) + F.col("_dr"))
        .withColumn(out[1], F.pmod(F.col(col) + F.col("_dc"), F.lit(round(360.0 / size_deg))))
        .drop("_dr", "_dc")
    )
