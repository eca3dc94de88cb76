"""Times of day, calendar columns, ids and one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days flagged as holidays in 2024.
HOLIDAYS_2024 = (
    "2024-01-01",
    "2024-01-15",
    "2024-02-19",
    "2024-05-27",
    "2024-06-19",
    "2024-07-04",
    "2024-09-02",
    "2024-11-28",
    "2024-11-29",
    "2024-12-24",
    "2024-12-25",
    "2024-12-31",
)

# Phase and wake-category vocabularies, in feature order.
PHASES = ("ground", "climb", "cruise", "descent", "approach", "unknown")
WAKE_CATEGORIES = ("L", "M", "H", "J", "unknown")


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def _int(v) -> Column:
    return _c(v).try_cast("int")


def hhmm_hour(c) -> Column:
    """Hour of an HHMM time of day; 2400 is hour 0."""
    return F.pmod(F.floor(_int(c) / 100), F.lit(24)).cast("int")


def hhmm_minutes(c, nulls: str = "drop") -> Column:
    """Minutes since midnight of an HHMM time; 2400 is 1440.

    ``nulls="drop"`` keeps a missing time null (the caller drops the row), ``"zero"`` reads it
    as midnight.
    """
    if nulls not in ("drop", "zero"):
        raise ValueError("nulls must be 'drop' or 'zero'")
    v = _int(c)
    minutes = (F.floor(v / 100) * 60 + v % 100).cast("int")
    return F.coalesce(minutes, F.lit(0)) if nulls == "zero" else minutes


def flight_key(carrier, number, date) -> Column:
    """Stable flight id: carrier, number, underscore, ISO date."""
    return F.concat(
        _c(carrier).cast("string"),
        _c(number).cast("string"),
        F.lit("_"),
        F.date_format(_c(date), "yyyy-MM-dd"),
    )


def leg_id(icao24, dep_ts) -> Column:
    """Deterministic leg id from the aircraft and its departure instant."""
    return F.md5(
        F.concat_ws("|", _c(icao24), F.unix_millis(_c(dep_ts).cast("timestamp")).cast("string"))
    )


def one_hot(c, values: tuple[str, ...], prefix: str) -> list[Column]:
    """One 0/1 column per listed value; a value outside the list gives all zeros."""
    return [
        F.coalesce((_c(c) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v.lower()}")
        for v in values
    ]


def calendar_cols(ts, holidays: tuple[str, ...] = HOLIDAYS_2024) -> dict[str, Column]:
    """Hour, Monday-is-0 weekday and holiday flag of a timestamp column."""
    t = _c(ts)
    return {
        "hour_of_day": F.hour(t).cast("int"),
        "day_of_week": F.weekday(t).cast("int"),
        "is_holiday": F.date_format(t, "yyyy-MM-dd").isin(*holidays).cast("int"),
    }


def only_arrivals(df: DataFrame) -> DataFrame:
    """Keep flights that have a real arrival delay: not cancelled, not diverted, delay known."""
    return df.where(
        (F.col("cancelled") == 0) & (F.col("diverted") == 0) & F.col("arr_delay_min").isNotNull()
    )
