"""The derived views and the track states in plain SQL, for checking results.

Written on their own: sequential rules are recursive queries here, not windows.
"""

from __future__ import annotations

EARTH = "6371008.8"


def rnd(expr: str, name: str) -> str:
    """A double rounded for comparison; the shift settles exact halves the same way everywhere."""
    return f"round({expr} + 1.3e-9, 6) + 0.0 AS {name}"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2*{EARTH}*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({lat2}-({lat1}))/2),2)"
        f" + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-({lon1}))/2),2)))))"
    )


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dl = f"radians({lon2}-({lon1}))"
    x = f"sin({dl})*cos(radians({lat2}))"
    y = (
        f"cos(radians({lat1}))*sin(radians({lat2}))"
        f" - sin(radians({lat1}))*cos(radians({lat2}))*cos({dl})"
    )
    return f"fmod(degrees(atan2({x}, {y})) + 360.0, 360.0)"


def east(lat: str, lon: str, lat0: str, lon0: str) -> str:
    return f"(radians({lon}-({lon0}))*{EARTH}*cos(radians({lat0})))"


def north(lat: str, lon: str, lat0: str, lon0: str) -> str:
    return f"(radians({lat}-({lat0}))*{EARTH})"


def turn(a: str, b: str) -> str:
    """Signed shortest turn; the inner sum is never below -360."""
    return f"(fmod(({b}) - ({a}) + 540.0, 360.0) - 180.0)"


def mins(c: str) -> str:
    return f"(({c})::INT // 100 * 60 + ({c})::INT % 100)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body)


view(
    "fx_reports",
    """
    SELECT lpad(lower(hex(user_id)), 6, '0') AS icao24,
           TIMESTAMP '2024-01-01 14:00:00'
             + to_seconds(5*n + CASE WHEN n >= 40 THEN 300 ELSE 0 END
                          + CASE WHEN user_id % 3 = 2 THEN 6000 ELSE 0 END) AS ts,
           39e0 + (user_id % 4)*2e0 + (user_id % 10)*3e-2 + p*4e-3 AS lat,
           -98e0 + (user_id // 10)*3e-2 + p*5e-3 AS lon,
           CASE WHEN event_id % 97 = 0 OR g THEN NULL
                WHEN p = 59 AND user_id % 7 = 0 THEN 3000
                WHEN p < 20 THEN (p-2)*2000
                WHEN p < 40 THEN 34000
                ELSE 34000 - (p-39)*1650 END::DOUBLE AS baro_alt_ft,
           CASE WHEN p < 3 THEN 15 WHEN p < 20 THEN 280 WHEN p < 40 THEN 450
                ELSE 250 END::DOUBLE AS velocity_kt,
           ((45 + CASE WHEN user_id % 4 = 1 THEN 15 ELSE 3 END*p) % 360)::DOUBLE AS heading_deg,
           CASE WHEN g THEN 0
                WHEN p = 59 AND user_id % 7 = 0 THEN 800
                WHEN event_id % 89 = 0 THEN NULL
                WHEN event_id % 53 = 0 AND p >= 55 THEN -4500
                WHEN p < 20 THEN 2000 WHEN p < 40 THEN 0
                ELSE -1650 END::DOUBLE AS vert_rate_fpm,
           g AS on_ground,
           CASE WHEN event_id % 211 = 0 THEN '7700' WHEN event_id % 223 = 0 THEN '7600'
                ELSE '1200' END AS squawk,
           event_id AS seq, 'fixture' AS source
    FROM (SELECT *, n % 60 AS p, (n % 60 < 3 OR (n % 60 = 10 AND user_id % 11 = 0)) AS g
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n
                FROM (SELECT * REPLACE (user_id // 4 AS user_id) FROM events)))
    """,
)
view(
    "fx_dup",
    """
    SELECT * FROM fx_reports
    UNION ALL BY NAME
    SELECT * REPLACE (baro_alt_ft + 100 AS baro_alt_ft, seq + 1000000 AS seq)
    FROM fx_reports WHERE seq % 10 = 0
    """,
    "fx_reports",
)
view(
    "fx_airports",
    """
    SELECT 'K' || lpad(n_nationkey::VARCHAR, 3, '0') AS icao, n_name AS name,
           39e0 + (n_nationkey % 4)*2e0 + (n_nationkey % 5)*8e-2 AS lat, -98e0 + (n_nationkey // 5)*8e-2 AS lon
    FROM nation
    """,
)
view(
    "fx_flights",
    """
    SELECT DATE '2024-01-01' + (l_orderkey % 31)::INT AS flight_date,
           l_returnflag || l_linestatus AS carrier,
           l_partkey::VARCHAR AS flight_number,
           CASE WHEN l_partkey % 50 <> 0
                THEN 'N' || (l_suppkey*100 + l_partkey % 100)::VARCHAR END AS tail_number,
           'K' || lpad(s_nationkey::VARCHAR, 3, '0') AS origin,
           'K' || lpad(c_nationkey::VARCHAR, 3, '0') AS dest,
           (dm // 60 * 100 + dm % 60)::VARCHAR AS crs_dep_hhmm,
           (am // 60 * 100 + am % 60)::VARCHAR AS crs_arr_hhmm,
           CASE WHEN l_orderkey % 67 = 0 THEN 1e0 ELSE 0e0 END AS cancelled,
           CASE WHEN l_orderkey % 67 <> 0 AND l_orderkey % 101 = 0 THEN 1e0 ELSE 0e0 END AS diverted,
           CASE WHEN l_orderkey % 67 <> 0 THEN greatest(l_quantity - 20, 0e0) END AS dep_delay_min,
           CASE WHEN l_orderkey % 67 <> 0 AND l_orderkey % 101 <> 0
                THEN greatest(l_quantity - 24 + 1e2*l_tax, 0e0) END AS arr_delay_min,
           el::DOUBLE AS sched_elapsed_min,
           (3 + l_linenumber)::DOUBLE AS taxi_in_min,
           (150 + l_partkey % 2400)::DOUBLE AS distance_mi,
           isodow(DATE '2024-01-01' + (l_orderkey % 31)::INT)::INT AS day_of_week,
           2024 AS year, 1 AS month
    FROM (SELECT *, (dm + el) % 1440 AS am
          FROM (SELECT *, (l_orderkey*37 + l_linenumber*61) % 1440 AS dm,
                       45 + l_partkey % 240 AS el FROM lineitem)) l
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey
    """,
)
view(
    "fx_registry",
    """
    SELECT DISTINCT lpad(lower(hex(user_id)), 6, '0') AS icao24,
           CASE user_id % 4 WHEN 0 THEN 'b738' WHEN 1 THEN 'a320' WHEN 2 THEN 'zzzz' END AS type_code
    FROM events
    """,
)
view(
    "fx_perf",
    "SELECT * FROM (VALUES ('b738', 41413e0, 79010e0, 'M'), ('a320', 42600e0, 78000e0, 'M'))"
    " t(type_code, oew_kg, mtow_kg, wtc)",
)
view(
    "fx_runs",
    "SELECT event_type AS kind, ts AS trained_at, event_id AS version, value AS metric FROM events",
)
view(
    "fx_closures",
    "SELECT 'K' || lpad(n_nationkey::VARCHAR, 3, '0') AS airport,"
    " (480 + 10*(n_nationkey % 12))::DOUBLE AS closed_from, 90e0 AS closed_for FROM nation",
)
view(
    "num",
    "SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY ts) AS i FROM fx_reports",
    "fx_reports",
)


def states_view(name: str, gap: int) -> None:
    """One step per report: phase, edges and the last edge before it."""
    rule = """
        CASE WHEN n.on_ground THEN 'ground'
             WHEN n.baro_alt_ft IS NULL THEN 'unknown'
             WHEN n.baro_alt_ft < 3000 AND {p} IN ('descent', 'approach') THEN 'approach'
             WHEN n.vert_rate_fpm >= 300 THEN 'climb'
             WHEN n.vert_rate_fpm <= -300 THEN 'descent'
             WHEN n.baro_alt_ft >= 18000 THEN 'cruise'
             ELSE {p} END"""
    broke = f"(epoch_us(n.ts) - epoch_us(s.ts) > {gap} * 1000000)"
    edge = "n.on_ground <> s.on_ground"
    was_edge = "(s.took_off OR s.landed)"
    view(
        name,
        f"""
        SELECT n.*, false AS gap, {rule.format(p="'unknown'")} AS phase,
               NULL::VARCHAR AS prev_phase, false AS took_off, false AS landed,
               NULL::VARCHAR AS e_kind, NULL::TIMESTAMP AS e_ts,
               NULL::DOUBLE AS e_lat, NULL::DOUBLE AS e_lon,
               n.ts AS segment_start, 1::BIGINT AS segment_pos
        FROM num n WHERE n.i = 1
        UNION ALL
        SELECT n.*, {broke}, {rule.format(p=f"(CASE WHEN {broke} THEN 'unknown' ELSE s.phase END)")},
               s.phase, s.on_ground AND NOT n.on_ground, n.on_ground AND NOT s.on_ground,
               CASE WHEN s.took_off THEN 'takeoff' WHEN s.landed THEN 'landing' ELSE s.e_kind END,
               CASE WHEN {was_edge} THEN s.ts ELSE s.e_ts END,
               CASE WHEN {was_edge} THEN s.lat ELSE s.e_lat END,
               CASE WHEN {was_edge} THEN s.lon ELSE s.e_lon END,
               CASE WHEN {broke} THEN n.ts ELSE s.segment_start END,
               CASE WHEN {broke} THEN 1 ELSE s.segment_pos + 1 END
        FROM {name} s JOIN num n ON n.icao24 = s.icao24 AND n.i = s.i + 1
        """,
        "num",
    )


states_view("states", 120)
states_view("states15", 15)


def near_view(name: str, source: str, cols: str, *needs: str) -> None:
    """Nearest airport of each point (columns ``cols`` identify it)."""
    d = hav("p.lat", "p.lon", "a.lat", "a.lon")
    view(
        name,
        f"""
        SELECT {cols}, icao AS airport FROM (
          SELECT p.*, a.icao,
                 row_number() OVER (PARTITION BY {cols} ORDER BY {d}, a.icao DESC) AS rn
          FROM {source} p LEFT JOIN fx_airports a
            ON a.lat BETWEEN p.lat - 0.2e0 AND p.lat + 0.2e0
           AND a.lon BETWEEN p.lon - 0.2e0 AND p.lon + 0.2e0 AND {d} <= 15000)
        WHERE rn = 1
        """,
        "fx_airports",
        *needs,
    )


view("edges", "SELECT icao24, ts, lat, lon, took_off, landed FROM states WHERE took_off OR landed", "states")
near_view("edge_near", "edges", "icao24, ts, took_off", "edges")
view(
    "pairs_legs",
    """
    SELECT icao24, CASE WHEN e_kind = 'takeoff' THEN e_ts END AS dep_ts, ts AS arr_ts,
           CASE WHEN e_kind = 'takeoff' AND epoch_us(ts) - epoch_us(e_ts)
                     BETWEEN 120000000 AND 28800000000 THEN 'closed' ELSE 'rejected' END AS outcome
    FROM states WHERE landed
    """,
    "states",
)
view(
    "fx_legs",
    """
    SELECT md5(t.icao24 || '|' || epoch_ms(t.ts)::VARCHAR) AS flight_id, t.icao24,
           t.airport AS origin_icao, l.airport AS dest_icao, t.ts AS actual_dep,
           c.arr_ts AS actual_arr,
           CASE WHEN c.arr_ts IS NULL THEN 'airborne' ELSE 'landed' END AS status
    FROM (SELECT * FROM edge_near WHERE took_off) t
    LEFT JOIN pairs_legs c ON c.icao24 = t.icao24 AND c.dep_ts = t.ts AND c.outcome = 'closed'
    LEFT JOIN (SELECT * FROM edge_near WHERE NOT took_off) l
           ON l.icao24 = c.icao24 AND l.ts = c.arr_ts
    """,
    "edge_near",
    "pairs_legs",
)
view(
    "hits",
    """
    SELECT * FROM (
      SELECT *, 'squawk_emergency' AS kind FROM states WHERE squawk IN ('7500', '7600', '7700')
      UNION ALL
      SELECT *, 'rapid_descent' FROM states
      WHERE NOT on_ground AND vert_rate_fpm <= -4000 AND baro_alt_ft <= 10000
      UNION ALL
      SELECT *, 'go_around' FROM states
      WHERE prev_phase = 'approach' AND phase = 'climb' AND baro_alt_ft <= 3000
        AND vert_rate_fpm >= 500)
    """,
    "states",
)


def sql(body: str, *needs: str) -> str:
    """``body`` under a WITH clause that holds the needed views in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        add(n)
    # Kept once: recursive queries read them at every step.
    once = lambda n: "" if "UNION ALL" in VIEWS[n][1] and f"{n} " in VIEWS[n][1] else "MATERIALIZED "
    ctes = ", ".join(f"{n} AS {once(n)}({VIEWS[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {ctes} {body}" if ordered else body
