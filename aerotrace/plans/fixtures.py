"""Reports, flights and airports derived from the given tables, so every query can run on them.

The arithmetic is plain, so that the same views can be written in SQL. Row numbers are taken
per (user, day) with carried counts: no user's events meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.operators.slicing import SLICE, row_number_sliced, time_slice
from aerotrace.session import configure, stored

_STORED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports from ``events``: 60-step flight cycles at a 5 s cadence with one gap.

    Four users make one aircraft, so tracks are long enough for every horizon and for
    resampling. Aircraft fly in four areas; every third one flies 100 minutes later, so that
    late folds have targets too; every fourth one keeps turning.
    """
    events = table(spark, sf_dir, "events").select(
        "event_id", F.floor(F.col("user_id") / 4).alias("user_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    numbered = row_number_sliced(
        events.withColumn(SLICE, time_slice("ts", 86_400)), ["user_id"], ["ts", "event_id"], "_rn"
    )
    n = F.col("_rn") - 1
    p = n % 60
    u, e = F.col("user_id"), F.col("event_id")
    ground = (p < 3) | ((p == 10) & (u % 11 == 0))
    turn = (p == 59) & (u % 7 == 0)
    altitude = (
        F.when(ground, None)
        .when(turn, 3000)
        .when(p < 20, (p - 2) * 2000)
        .when(p < 40, 34000)
        .otherwise(34000 - (p - 39) * 1650)
        .cast("double")
    )
    vrate = (
        F.when(ground, 0)
        .when(turn, 800)
        .when(e % 89 == 0, None)
        .when((e % 53 == 0) & (p >= 55), -4500)
        .when(p < 20, 2000)
        .when(p < 40, 0)
        .otherwise(-1650)
        .cast("double")
    )
    offset = n * 5 + F.when(n >= 40, 300).otherwise(0) + F.when(u % 3 == 2, 6000).otherwise(0)
    return numbered.select(
        F.lpad(F.lower(F.hex(u)), 6, "0").alias("icao24"),
        F.timestamp_seconds(F.lit(1_704_117_600) + offset).alias("ts"),
        (F.lit(39.0) + (u % 4) * F.lit(2.0) + (u % 10) * F.lit(3e-2) + p * F.lit(4e-3)).alias("lat"),
        (F.lit(-98.0) + F.floor(u / 10) * F.lit(3e-2) + p * F.lit(5e-3)).alias("lon"),
        F.when(e % 97 == 0, None).otherwise(altitude).alias("baro_alt_ft"),
        F.when(p < 3, 15).when(p < 20, 280).when(p < 40, 450).otherwise(250).cast("double").alias(
            "velocity_kt"
        ),
        ((45 + p * F.when(u % 4 == 1, 15).otherwise(3)) % 360).cast("double").alias("heading_deg"),
        vrate.alias("vert_rate_fpm"),
        ground.alias("on_ground"),
        F.when(e % 211 == 0, "7700").when(e % 223 == 0, "7600").otherwise("1200").alias("squawk"),
        e.alias("seq"),
        F.lit("fixture").alias("source"),
    )


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of the reports that is delivered again, 100 ft higher."""
    again = reports(spark, sf_dir).where("seq % 10 = 0")
    return again.withColumn("baro_alt_ft", F.col("baro_alt_ft") + 100).withColumn(
        "seq", F.col("seq") + 1_000_000
    )


def reports_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).unionByName(redelivered(spark, sf_dir))


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records of the live feed, some with a relayed id and some without a position."""
    r = reports(spark, sf_dir)
    record = F.to_json(
        F.struct(
            F.when(F.col("seq") % 50 == 0, F.concat(F.lit("~"), "icao24"))
            .otherwise(F.upper("icao24"))
            .alias("hex"),
            F.when(F.col("on_ground"), "ground")
            .otherwise(F.col("baro_alt_ft").cast("int").cast("string"))
            .alias("alt_baro"),
            F.col("velocity_kt").alias("gs"),
            F.col("heading_deg").alias("track"),
            F.col("vert_rate_fpm").alias("baro_rate"),
            F.col("squawk"),
            F.when(F.col("seq") % 61 != 0, F.col("lat")).alias("lat"),
            F.col("lon"),
            (F.col("seq") % 4).alias("seen_pos"),
        )
    )
    return r.select("seq", F.col("ts").alias("received_at"), record.alias("value"))


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One airport per nation, inside the traffic area."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        airport_code(k).alias("icao"),
        F.col("n_name").alias("name"),
        (F.lit(39.0) + (k % 4) * F.lit(2.0) + (k % 5) * F.lit(8e-2)).alias("lat"),
        (F.lit(-98.0) + F.floor(k / 5) * F.lit(8e-2)).alias("lon"),
    )


def airport_code(nation):
    return F.concat(F.lit("K"), F.lpad(nation.cast("string"), 3, "0"))


def runways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runway ends per airport."""
    return airports(spark, sf_dir).select(
        F.col("icao").alias("airport_icao"),
        F.explode(F.array(F.lit("09"), F.lit("27"))).alias("ident"),
    ).select(
        "airport_icao",
        "ident",
        (F.col("ident").cast("int") * 10).cast("double").alias("true_heading_deg"),
        (F.lit(6000.0) + F.substring("airport_icao", 2, 3).cast("int") * 100).alias("length_ft"),
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled flights from ``lineitem`` with the nations of supplier and customer as ends."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    dm = (ok * 37 + F.col("l_linenumber") * 61) % 1440
    el = 45 + pk % 240
    arr = (dm + el) % 1440
    hhmm = lambda m: (F.floor(m / 60) * 100 + m % 60).cast("string")
    cancelled = ok % 67 == 0
    no_arrival = cancelled | (ok % 101 == 0)
    date = F.date_add(F.lit("2024-01-01").cast("date"), (ok % 31).cast("int"))
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .select(
            date.alias("flight_date"),
            F.concat("l_returnflag", "l_linestatus").alias("carrier"),
            pk.cast("string").alias("flight_number"),
            F.when(
                pk % 50 != 0,
                F.concat(F.lit("N"), (F.col("l_suppkey") * 100 + pk % 100).cast("string")),
            ).alias("tail_number"),
            airport_code(F.col("s_nationkey")).alias("origin"),
            airport_code(F.col("c_nationkey")).alias("dest"),
            hhmm(dm).alias("crs_dep_hhmm"),
            hhmm(arr).alias("crs_arr_hhmm"),
            cancelled.cast("double").alias("cancelled"),
            (~cancelled & (ok % 101 == 0)).cast("double").alias("diverted"),
            F.when(~cancelled, F.greatest(F.col("l_quantity") - 20, F.lit(0.0))).alias(
                "dep_delay_min"
            ),
            F.when(
                ~no_arrival,
                F.greatest(F.col("l_quantity") - 24 + F.lit(1e2) * F.col("l_tax"), F.lit(0.0)),
            ).alias("arr_delay_min"),
            el.cast("double").alias("sched_elapsed_min"),
            (F.col("l_linenumber") + 3).cast("double").alias("taxi_in_min"),
            (pk % 2400 + 150).cast("double").alias("distance_mi"),
            (F.weekday(date) + 1).cast("int").alias("day_of_week"),
            F.year(date).alias("year"),
            F.month(date).alias("month"),
        )
    )


def kept(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame] | None = None
) -> DataFrame:
    """A derived view as a stored table, written once per session and used by all queries.

    The reference reads flights and reports from tables; plans that use them several times
    should not derive them again each time. ``build`` makes other tables than those two.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        made = build() if build else {"flights": flights, "reports": reports}[name](spark, sf_dir)
        _STORED[key] = stored(spark, made, name)
    return _STORED[key]


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aircraft types: two known ones, one unknown code, one missing."""
    u = F.col("user_id")
    users = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 4).alias("user_id"))
    return users.distinct().select(
        F.lpad(F.lower(F.hex(u)), 6, "0").alias("icao24"),
        F.when(u % 4 == 0, "b738").when(u % 4 == 1, "a320").when(u % 4 == 2, "zzzz").alias(
            "type_code"
        ),
    )


def perf(spark: SparkSession) -> DataFrame:
    """Empty weight, maximum take-off weight and wake category of two types."""
    return spark.createDataFrame(
        [("b738", 41413.0, 79010.0, "M"), ("a320", 42600.0, 78000.0, "M")],
        "type_code STRING, oew_kg DOUBLE, mtow_kg DOUBLE, wtc STRING",
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs: kind, time, version and metric from ``events``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("trained_at"),
        F.col("event_id").alias("version"),
        F.col("value").alias("metric"),
    )


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closure per airport."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        airport_code(k).alias("airport"),
        (480 + 10 * (k % 12)).cast("double").alias("closed_from"),
        F.lit(90.0).alias("closed_for"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("flight_id"), "embedding"
    )
