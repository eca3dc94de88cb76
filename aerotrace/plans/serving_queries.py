"""C8 and G: read queries over all reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.operators import serving, similarity, spatial, tracks
from aerotrace.plans import fixtures as fx
from aerotrace.plans.ingest_queries import BBOX, report_rounded
from aerotrace.plans.oracle_views import rnd, sql
from aerotrace.plans.registry import query
from aerotrace.session import scratch_dir
from aerotrace.sources import archive

AS_OF = "2024-01-01 14:03:20"
CELLS = ["130:-327", "131:-326", "130:-326", "130:-327", "131:-325"]
FRESH = f"ts > TIMESTAMP '{AS_OF}' - INTERVAL 120 SECOND AND ts <= TIMESTAMP '{AS_OF}'"
IN_BOX = "lat BETWEEN 39.0 AND 39.4 AND lon BETWEEN -98.0 AND -97.0"
CELL = "floor(lat / 0.3e0)::INT || ':' || floor(lon / 0.3e0)::INT"
WANTED = "('130:-327', '131:-326', '130:-326', '131:-325')"


def latest_sql(where: str, tail: str = "") -> str:
    return sql(
        f"""
        SELECT {report_rounded()} FROM (
          SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY ts DESC) AS rn
          FROM fx_reports WHERE {where}) WHERE rn = 1 {tail}
        """,
        "fx_reports",
    )


@query("c8_in_cells", sql(f"SELECT icao24, ts, {CELL} AS cell FROM fx_reports WHERE {CELL} IN {WANTED}", "fx_reports"))
def c8(spark, sf):
    rows = spatial.with_cell(fx.reports(spark, sf))
    return spatial.in_cells(rows, CELLS).select("icao24", "ts", "cell")


@query("g1_latest_in_bbox", latest_sql(f"{IN_BOX} AND {FRESH}", "ORDER BY icao24"))
def g1(spark, sf):
    return serving.latest_in_bbox(fx.reports(spark, sf), BBOX, AS_OF)


def archived(spark, sf):
    """The reports as an archive by date and hour."""
    path = scratch_dir(spark, "archive")
    archive.write_archive(spatial.with_cell(fx.kept(spark, sf, "reports")), path)
    return archive.read_archive(spark, path)


@query("g1_archive", latest_sql(f"{IN_BOX} AND {FRESH}", "ORDER BY icao24"))
def g1_archive(spark, sf):
    return serving.latest_in_bbox(archived(spark, sf), BBOX, AS_OF)


@query("g5_archive", latest_sql(f"{CELL} IN {WANTED} AND {FRESH}"))
def g5_archive(spark, sf):
    return serving.latest_in_cells(archived(spark, sf), CELLS, AS_OF)


@query("g11_archive", latest_sql(f"ts <= TIMESTAMP '{AS_OF}'"))
def g11_archive(spark, sf):
    return serving.state_as_of(archived(spark, sf), AS_OF).select(*serving.POSITION)


@query("g2_latest_of", latest_sql("true"))
def g2(spark, sf):
    return serving.latest_of(fx.reports(spark, sf)).select(*serving.POSITION)


@query(
    "g3_tracks",
    sql(
        f"""
        SELECT {report_rounded()}, pos FROM (
          SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY ts) AS pos FROM fx_reports
          WHERE ts BETWEEN TIMESTAMP '2024-01-01 14:01:00' AND TIMESTAMP '2024-01-01 14:10:00')
        """,
        "fx_reports",
    ),
)
def g3(spark, sf):
    return serving.tracks(fx.reports(spark, sf), "2024-01-01 14:01:00", "2024-01-01 14:10:00")


@query(
    "g4_anomaly_feed",
    sql(
        """
        SELECT icao24, ts, kind, 1e0 AS score,
               CASE WHEN e_kind = 'takeoff'
                    THEN md5(icao24 || '|' || epoch_ms(e_ts)::VARCHAR) END AS flight_id
        FROM hits WHERE ts >= TIMESTAMP '2024-01-01 14:01:00'
        """,
        "hits",
    ),
)
def g4(spark, sf):
    found = tracks.all_anomalies(tracks.track_states(fx.reports(spark, sf)))
    return serving.anomaly_feed(found, "2024-01-01 14:01:00").drop("evidence")


@query("g5_latest_in_cells", latest_sql(f"{CELL} IN {WANTED} AND {FRESH}"))
def g5(spark, sf):
    return serving.latest_in_cells(spatial.with_cell(fx.reports(spark, sf)), CELLS, AS_OF)


@query(
    "g6_airport_detail",
    sql(
        """
        SELECT icao, name, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon,
               '09:90.0,27:270.0' AS ends, 2 AS n_ends,
               6000e0 + 100*substr(icao, 2, 3)::INT AS length_ft
        FROM fx_airports
        """,
        "fx_airports",
    ),
)
def g6(spark, sf):
    detail = serving.airport_detail(fx.airports(spark, sf), fx.runways(spark, sf))
    ends = F.transform(
        "runways", lambda r: F.concat_ws(":", r["ident"], r["heading_deg"].cast("string"))
    )
    return detail.select(
        "icao", "name", "lat", "lon",
        F.array_join(ends, ",").alias("ends"),
        F.size("runways").alias("n_ends"),
        F.col("runways")[0]["length_ft"].alias("length_ft"),
    )


@query(
    "g10_similar",
    sql(
        f"""
        SELECT vec_id AS flight_id,
               {rnd('list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))', 'cosine')}
        FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20
        """
    ),
)
def g10(spark, sf):
    emb = fx.embeddings(spark, sf)
    wanted = emb.where("flight_id = 0").select("embedding").scalar()
    return serving.similar(emb, wanted, 20)


MANY_SQL = f"""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (
      SELECT q.vec_id AS query_id, c.vec_id AS flight_id, round(list_cosine_similarity(q.e, c.e), 9) AS c9
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
    r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c9 DESC, flight_id)::INTEGER AS rank FROM p)
    SELECT query_id, rank, flight_id, {rnd('c9', 'cosine')} FROM r WHERE rank <= 10
"""


@query("g10_similar_many", sql(MANY_SQL))
def g10_many(spark, sf):
    emb = fx.embeddings(spark, sf)
    return similarity.similar(spark, emb, emb.where("flight_id % 20 = 0"), 10)


def similar_lists(spark, sf):
    emb = fx.embeddings(spark, sf)
    index = similarity.build_lists(spark, emb)
    return similarity.similar_by_lists(spark, index, emb.where("flight_id % 20 = 0"), 10)


@query(
    "g10_similar_recall",
    sql(
        f"""
        SELECT count(*) AS neighbours, count(DISTINCT query_id) AS queries, TRUE AS recall_reached, TRUE AS cosines_exact
        FROM ({MANY_SQL})
        """
    ),
)
def g10_recall(spark, sf):
    """Neighbours that the inverted lists find, of all exact ones; at least nine tenths."""
    emb = fx.embeddings(spark, sf)
    exact = similarity.similar(spark, emb, emb.where("flight_id % 20 = 0"), 10)
    found = similar_lists(spark, sf).select("query_id", "flight_id", F.col("cosine").alias("_c"))
    both = exact.join(found, ["query_id", "flight_id"], "left")
    return both.agg(
        F.count("*").alias("neighbours"),
        F.count_distinct("query_id").alias("queries"),
        (F.count("_c") >= 0.9 * F.count("*")).alias("recall_reached"),
        F.bool_and(F.abs(F.col("cosine") - F.col("_c")) < 1e-8).alias("cosines_exact"),
    )


@query("g11_state_as_of", latest_sql(f"ts <= TIMESTAMP '{AS_OF}'"))
def g11(spark, sf):
    return serving.state_as_of(fx.reports(spark, sf), AS_OF).select(*serving.POSITION)
