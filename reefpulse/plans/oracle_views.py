"""The surrogate inputs once more, as SQL views for the correctness check.

They are written apart from the Spark side: DAFM compares every date with every
moon, bins are filled by a join against a full spine, and ring containment
counts crossings over a table of edges.
"""

from __future__ import annotations

import re

from reefpulse.plans.surrogate import MOON_EPOCH, MOON_EPOCH_SECONDS, RING, SYNODIC_SECONDS

_SITES = "('AUTOMOBILE', 'BUILDING', 'MACHINERY')"

_DETECTIONS = """
SELECT CAST(tag AS VARCHAR) AS transmitter, CASE WHEN event_id % 16 = 0 THEN 'X' ELSE '' END || CAST(k AS VARCHAR) AS station, t AS detection_time_ast,
       176e-1 + 1e-3 * k AS lat_nad83, -6492e-2 + 1e-3 * k AS long_nad83, event_id
FROM ({rows})
"""


def _moons(det: str) -> str:
    def lunation(end: str) -> str:
        return f"CAST(floor((epoch_us({end}(detection_time_ast)) / 1e6 - {MOON_EPOCH_SECONDS}) / {SYNODIC_SECONDS}) AS BIGINT)"

    return f"""
    SELECT TIMESTAMP '{MOON_EPOCH}' + to_seconds(n * {SYNODIC_SECONDS}) AS datetime_utc,
           TIMESTAMP '{MOON_EPOCH}' + to_seconds(n * {SYNODIC_SECONDS}) - INTERVAL 4 HOUR AS datetime_local,
           CAST(TIMESTAMP '{MOON_EPOCH}' + to_seconds(n * {SYNODIC_SECONDS}) - INTERVAL 4 HOUR AS DATE) AS date
    FROM (SELECT unnest(generate_series({lunation('min')} - 1, {lunation('max')} + 2)) AS n FROM {det})
    """


def _calendar(det: str, moons: str) -> str:
    return f"""
    SELECT date, CAST(CASE WHEN neg > -10 THEN neg ELSE pos END AS INTEGER) AS dafm
    FROM (SELECT d.date, min(CASE WHEN d.date >= m.date THEN d.date - m.date END) AS pos,
                 max(CASE WHEN d.date < m.date THEN d.date - m.date END) AS neg
          FROM (SELECT DISTINCT CAST(detection_time_ast AS DATE) AS date FROM {det}) d CROSS JOIN {moons} m
          GROUP BY d.date)
    """


def _dated(det: str, cal: str) -> str:
    return f"""
    SELECT d.*, CAST(year(d.detection_time_ast) AS INTEGER) AS year, CAST(d.detection_time_ast AS DATE) AS date,
           CAST(hour(d.detection_time_ast) AS INTEGER) AS hour, CAST(minute(d.detection_time_ast) AS INTEGER) AS min,
           second(d.detection_time_ast) + (microsecond(d.detection_time_ast) % 1000000) / 1e6 AS sec,
           hour(d.detection_time_ast) + CASE WHEN minute(d.detection_time_ast) < 30 THEN 0e0 ELSE 5e-1 END AS halfhour,
           c.dafm
    FROM {det} d LEFT JOIN {cal} c ON c.date = CAST(d.detection_time_ast AS DATE)
    """


def _utm(source: str) -> str:
    """Krueger series on GRS80, written out step by step."""
    n = "(1 / 298.257222101e0 / (2 - 1 / 298.257222101e0))"
    a = {
        1: f"({n}/2e0 - 2e0*{n}**2/3e0 + 5e0*{n}**3/16e0 + 41e0*{n}**4/180e0)",
        2: f"(13e0*{n}**2/48e0 - 3e0*{n}**3/5e0 + 557e0*{n}**4/1440e0)",
        3: f"(61e0*{n}**3/240e0 - 103e0*{n}**4/140e0)",
        4: f"(49561e0*{n}**4/161280e0)",
    }
    big = f"(6378137e0 / (1 + {n}) * (1 + {n}**2/4e0 + {n}**4/64e0))"
    x = " + ".join(f"{a[j]}*cos({2*j}*xi)*sinh({2*j}*eta)" for j in a)
    y = " + ".join(f"{a[j]}*sin({2*j}*xi)*cosh({2*j}*eta)" for j in a)
    return f"""
    SELECT * EXCLUDE (s, t, xi, eta), 500000e0 + 9996e-4*{big}*(eta + {x}) AS x_utm20n, 9996e-4*{big}*(xi + {y}) AS y_utm20n
    FROM (SELECT *, atan2(t, cos(radians(long_nad83 + 63))) AS xi,
                 asinh(sin(radians(long_nad83 + 63)) / sqrt(t*t + cos(radians(long_nad83 + 63))**2)) AS eta
          FROM (SELECT *, sinh(atanh(s) - 2*sqrt({n})/(1+{n}) * atanh(2*sqrt({n})/(1+{n})*s)) AS t
                FROM (SELECT *, sin(radians(lat_nad83)) AS s FROM {source})))
    """


def _edges() -> str:
    pts = RING + RING[:1]
    rows = ", ".join(
        f"(CAST({x1!r} AS DOUBLE), CAST({y1!r} AS DOUBLE), CAST({x2!r} AS DOUBLE), CAST({y2!r} AS DOUBLE))"
        for (x1, y1), (x2, y2) in zip(pts, pts[1:])
    )
    return f"SELECT * FROM (VALUES {rows}) AS e(x1, y1, x2, y2)"


def _area_edges() -> str:
    (x0, y0), pts = RING[0], RING + RING[:1]
    rows = ", ".join(
        f"(CAST({a - x0!r} AS DOUBLE), CAST({b - y0!r} AS DOUBLE), CAST({c - x0!r} AS DOUBLE), CAST({d - y0!r} AS DOUBLE))"
        for (a, b), (c, d) in zip(pts, pts[1:])
    )
    move, scale = "4e-3 * n_nationkey", "(n_regionkey + 1) / 2e0"
    x, y = (f"{base} + {move} + {{}} * ({scale})" for base in ("-6492e-2", "176e-1"))
    ends = ", ".join(f"{e.format(c)} AS {c}" for e, c in ((x, "x1"), (y, "y1"), (x, "x2"), (y, "y2")))
    return f"SELECT n_nationkey AS area, {ends} FROM nation CROSS JOIN (VALUES {rows}) AS e(x1, y1, x2, y2)"


def inside_sql(source: str, lon: str, lat: str) -> str:
    """Distinct points of ``source`` with whether the ring holds them."""
    turn = f"((x2 - x1) * (p.{lat} - y1) - (y2 - y1) * (p.{lon} - x1))"
    return f"""
    SELECT p.{lon}, p.{lat},
           coalesce(bool_or({turn} = 0 AND p.{lon} BETWEEN least(x1, x2) AND greatest(x1, x2)
                            AND p.{lat} BETWEEN least(y1, y2) AND greatest(y1, y2)), FALSE)
           OR (count(*) FILTER (WHERE (y1 > p.{lat}) <> (y2 > p.{lat}) AND {turn} <> 0
                                AND ({turn} > 0) = (y2 > y1))) % 2 = 1 AS inside
    FROM (SELECT DISTINCT {lon}, {lat} FROM {source} WHERE {lon} IS NOT NULL AND {lat} IS NOT NULL) p CROSS JOIN edges
    GROUP BY p.{lon}, p.{lat}
    """


def _trip_days(compare: str) -> str:
    return f"""
    SELECT *, 1 + coalesce(sum(CASE WHEN prior {compare} 7 THEN 1 ELSE 0 END)
                           OVER (PARTITION BY transmitter ORDER BY date), 0) AS tripnum
    FROM (SELECT *, date - lag(date) OVER (PARTITION BY transmitter ORDER BY date) AS prior FROM days_long)
    """


def _occupied(det: str) -> str:
    return f"""
    SELECT transmitter, year, date, halfhour, count(DISTINCT station) AS no_stations, count(*) AS no_detections,
           min(dafm) AS dafm, round(avg(lat_nad83), 5) AS avg_lat, round(avg(long_nad83), 5) AS avg_long,
           round(avg(x_utm20n), 2) AS avg_x, round(avg(y_utm20n), 2) AS avg_y
    FROM {det} GROUP BY ALL
    """


def _zoned(occupied: str, inside: str) -> str:
    return f"""
    SELECT o.*, CASE WHEN i.inside THEN 'in' WHEN NOT i.inside THEN 'out' END AS mssca
    FROM {occupied} o LEFT JOIN {inside} i ON i.avg_long = o.avg_long AND i.avg_lat = o.avg_lat
    """


def _spine(occupied: str) -> str:
    slot = "date + to_minutes(CAST(halfhour * 60 AS BIGINT))"
    return f"""
    SELECT transmitter, CAST(slot AS DATE) AS date,
           hour(slot) + CASE WHEN minute(slot) < 30 THEN 0e0 ELSE 5e-1 END AS halfhour
    FROM (SELECT transmitter, unnest(generate_series(min({slot}), max({slot}), INTERVAL 30 MINUTE)) AS slot
          FROM {occupied} GROUP BY transmitter)
    """


def _bins(spine: str, zoned: str) -> str:
    return f"""
    SELECT s.transmitter, CAST(year(s.date) AS INTEGER) AS year, s.date, s.halfhour,
           coalesce(z.no_stations, 0) AS no_stations, coalesce(z.no_detections, 0) AS no_detections,
           CASE WHEN z.transmitter IS NULL THEN d.dafm ELSE z.dafm END AS dafm,
           z.avg_lat, z.avg_long, z.avg_x, z.avg_y, z.mssca,
           CASE WHEN coalesce(z.no_stations, 0) > 0 THEN 'P' ELSE 'A' END AS pa
    FROM {spine} s
    LEFT JOIN {zoned} z ON z.transmitter = s.transmitter AND z.date = s.date AND z.halfhour = s.halfhour
    LEFT JOIN day_dafm d ON d.date = s.date
    """


VIEWS: dict[str, str] = {
    "det_short": _DETECTIONS.format(
        rows="SELECT user_id AS tag, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts AS t, event_id FROM events"
    ),
    "det_long": _DETECTIONS.format(
        rows="SELECT o_custkey AS tag, CAST(o_orderkey % 100 AS INTEGER) AS k, o_orderdate AS t, o_orderkey AS event_id FROM orders"
    ),
    "stations": """
    SELECT CAST(s_suppkey AS VARCHAR) AS station, CASE WHEN s_nationkey % 2 = 0 THEN 'in' ELSE 'out' END AS mssca,
           CAST(1 + s_suppkey % 3 AS INTEGER) AS years_deployed
    FROM supplier
    UNION ALL SELECT 'S566', 'out', 1
    """,
    "tags": """
    SELECT CAST(c_custkey AS VARCHAR) AS transmitter, 'tagged' AS species, c_mktsegment AS release_site,
           CAST(year(DATE '2024-01-01' + CAST(c_custkey % 10 AS INTEGER)) AS INTEGER) AS release_year,
           DATE '2024-01-01' + CAST(c_custkey % 10 AS INTEGER) AS release_date,
           CASE WHEN c_custkey % 17 <> 0 THEN 40e0 + (c_custkey % 350) / 10e0 END AS tl,
           CASE c_nationkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'U' END AS sex,
           CASE WHEN c_custkey % 12 = 0 THEN 'pressure' ELSE 'plain' END AS tag_model
    FROM customer
    """,
    "analysed": f"SELECT transmitter FROM tags WHERE release_site IN {_SITES}",
    "moons_short": _moons("det_short"),
    "moons_long": _moons("det_long"),
    "cal_short": _calendar("det_short", "moons_short"),
    "cal_long": _calendar("det_long", "moons_long"),
    "dated_short": _dated("det_short", "cal_short"),
    "dated_long": _dated("det_long", "cal_long"),
    "edges": _edges(),
    "area_edges": _area_edges(),
    "places": "SELECT DISTINCT long_nad83 AS lon, lat_nad83 AS lat FROM det_short",
    "utm_short": _utm("dated_short"),
    "cut_short": """
    SELECT u.* FROM utm_short u JOIN tags t ON t.transmitter = u.transmitter
    WHERE u.station IN (SELECT station FROM stations) AND u.transmitter IN (SELECT transmitter FROM analysed)
      AND u.date > t.release_date
    """,
    "occupied": _occupied("utm_short"),
    "cut_occupied": _occupied("cut_short"),
    "inside_bins": inside_sql("occupied", "avg_long", "avg_lat"),
    "cut_inside": inside_sql("cut_occupied", "avg_long", "avg_lat"),
    "zoned": _zoned("occupied", "inside_bins"),
    "cut_zoned": _zoned("cut_occupied", "cut_inside"),
    "day_dafm": """
    SELECT d.date, CAST(CASE WHEN neg > -10 THEN neg ELSE pos END AS INTEGER) AS dafm
    FROM (SELECT d.date, min(CASE WHEN d.date >= m.date THEN d.date - m.date END) AS pos,
                 max(CASE WHEN d.date < m.date THEN d.date - m.date END) AS neg
          FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM occupied) d
          CROSS JOIN moons_short m GROUP BY d.date) d
    """,
    "spine": _spine("occupied"),
    "cut_spine": _spine("cut_occupied"),
    "bins": _bins("spine", "zoned"),
    "cut_bins": _bins("cut_spine", "cut_zoned"),
    "days_long": "SELECT DISTINCT transmitter, CAST(detection_time_ast AS DATE) AS date FROM det_long",
    "gaps": """
    SELECT transmitter, date AS last_date, CAST(nxt - date AS INTEGER) AS absdays
    FROM (SELECT *, lead(date) OVER (PARTITION BY transmitter ORDER BY date) AS nxt FROM days_long)
    WHERE nxt - date > 7
    """,
    "strict": f"SELECT transmitter, CAST(max(tripnum) AS BIGINT) AS trips FROM ({_trip_days('>')}) GROUP BY transmitter",
    "all_trips": f"""
    SELECT transmitter, CAST(tripnum AS BIGINT) AS tripnum, count(*) AS triplen, max(date) AS last_date,
           max(tripnum) OVER (PARTITION BY transmitter) AS trips,
           CAST(lead(min(date)) OVER (PARTITION BY transmitter ORDER BY tripnum) - max(date) AS INTEGER) AS abslen
    FROM ({_trip_days('>=')}) GROUP BY transmitter, tripnum
    """,
    "trips": """
    SELECT transmitter, CAST(CASE WHEN abslen IS NOT NULL THEN year(last_date) END AS INTEGER) AS year,
           CAST(CASE WHEN abslen IS NOT NULL THEN month(last_date) END AS INTEGER) AS monthnum, tripnum, triplen, abslen
    FROM all_trips WHERE abslen IS NOT NULL OR (trips = 1 AND triplen = 1)
    """,
    "by_dafm": """
    SELECT transmitter, year, CAST(month(date) AS INTEGER) AS monthint, strftime(date, '%b') AS monthname, dafm,
           count(*) AS detfreq
    FROM dated_long GROUP BY ALL
    """,
    "attend": """
    SELECT transmitter, count(DISTINCT date) AS no_days, count(DISTINCT strftime(date, '%Y-%m')) AS no_months,
           count(DISTINCT year(date)) AS no_years
    FROM dated_long GROUP BY transmitter
    """,
    "month_bins": """
    SELECT transmitter, CAST(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)),
           INTERVAL 1 MONTH)) AS DATE) AS date, 'A' AS pa FROM days_long GROUP BY transmitter
    UNION ALL SELECT transmitter, CAST(detection_time_ast AS DATE), 'P' FROM det_long
    """,
    "tag_months": """
    SELECT transmitter, CAST(year(date) AS INTEGER) AS year, strftime(date, '%b') AS month,
           CASE WHEN bool_or(pa = 'P') THEN 'P' ELSE 'A' END AS pa
    FROM month_bins GROUP BY ALL
    """,
    "depth": """
    SELECT CAST(user_id AS VARCHAR) AS transmitter, ts AS detection_time_ast, value AS sensor_value,
           -6492e-2 + 1e-3 * CAST(json_extract_string(props, '$.k') AS INTEGER) AS long_nad83,
           CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS fish,
           hour(ts) + CASE WHEN minute(ts) < 30 THEN 0e0 ELSE 5e-1 END AS halfhour, -value AS z,
           CASE WHEN -value > -10 THEN 'shallow' WHEN -value < -30 THEN 'deep' END AS depthcat
    FROM events
    """,
    "currents": "SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(vec_id) AS ts_local, "
    + ", ".join(f"180e0 * (1e0 + CAST(embedding[{i}] AS DOUBLE)) AS direction_{i}" for i in range(1, 33))
    + ", "
    + ", ".join(f"abs(CAST(embedding[{32 + i}] AS DOUBLE)) AS speed_{i}" for i in range(1, 33))
    + " FROM embeddings",
    "current_means": "SELECT ts_local, round(("
    + " + ".join(f"direction_{i}" for i in range(1, 10))
    + ") / 9e0, 2) AS direction_1_9, round(("
    + " + ".join(f"speed_{i}" for i in range(1, 10))
    + ") / 9e0, 2) AS speed_1_9 FROM currents",
    "east": "SELECT *, cos(radians(direction_1_9 - 90)) AS direction_1_9_s FROM current_means",
    "reports": "SELECT CAST(o_orderkey AS VARCHAR) AS spawning_id, o_orderpriority AS current_status FROM orders",
    "slack": "SELECT DISTINCT date, (15e-1 * day(date)) % 24e0 AS slack_halfhour FROM bins",
    "zone_cells": "SELECT halfhour, mssca, CAST(sum(no_detections) AS BIGINT) AS tot_freq FROM bins WHERE mssca IS NOT NULL GROUP BY ALL",
    "availability": """
    SELECT mssca, CAST(sum(years_deployed) AS DOUBLE) / (SELECT sum(years_deployed) FROM stations) AS chesson_p
    FROM stations GROUP BY mssca
    """,
    "full_cells": """
    SELECT h.halfhour, z.mssca, coalesce(c.tot_freq, 0) AS o
    FROM (SELECT DISTINCT halfhour FROM zone_cells) h CROSS JOIN (VALUES ('in'), ('out')) z(mssca)
    LEFT JOIN zone_cells c ON c.halfhour = h.halfhour AND c.mssca = z.mssca
    """,
    "expected": """
    SELECT halfhour, mssca, CAST(o AS DOUBLE) AS o,
           CAST(sum(o) OVER (PARTITION BY halfhour) AS DOUBLE) * CAST(sum(o) OVER (PARTITION BY mssca) AS DOUBLE)
           / (SELECT sum(o) FROM full_cells) AS e
    FROM full_cells
    """,
    "halfhour_index": """
    SELECT c.halfhour, c.mssca, c.tot_freq, r / sum(r) OVER () AS s, p
    FROM (SELECT c.*, a.chesson_p / 48 AS p, CAST(tot_freq AS DOUBLE) / (SELECT sum(tot_freq) FROM zone_cells) / (a.chesson_p / 48) AS r
          FROM zone_cells c LEFT JOIN availability a ON a.mssca = c.mssca) c
    """,
    "dafm_index": """
    SELECT dafm, p AS chesson_p, rp / sum(rp) OVER () AS chesson_s, ra / sum(ra) OVER () AS chesson_s_abs
    FROM (SELECT dafm, n / t AS p, np / t / (n / t) AS rp, na / t / (n / t) AS ra
          FROM (SELECT dafm, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE pa = 'P') AS DOUBLE) AS np,
                       CAST(count(*) FILTER (WHERE pa = 'A') AS DOUBLE) AS na, CAST(sum(count(*)) OVER () AS DOUBLE) AS t
                FROM bins WHERE dafm IS NOT NULL GROUP BY dafm))
    """,
}


def with_views(sql: str) -> str:
    """Puts the views that ``sql`` needs ahead of it, in order of dependence."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql.strip()
    head = ",\n".join(f"{name} AS (\n{VIEWS[name].strip()}\n)" for name in order)
    return f"WITH {head}\n{sql.strip()}"
