"""Half-hour bins, zones, positions, currents and tides."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reefpulse.operators import binning, distribution, geometry, restrict, summary
from reefpulse.plans import surrogate as s
from reefpulse.plans.oracle_views import inside_sql
from reefpulse.plans.registry import query, rounded

JAN = (dt.date(2024, 1, 5), dt.date(2024, 1, 12))


@query("half_hour", "SELECT event_id, halfhour FROM dated_short")
def half_hour(spark, d):
    return restrict.add_half_hour(s.detections_short(spark, d)).select("event_id", "halfhour")


@query("project_utm", "SELECT event_id, round(x_utm20n, 4) AS x_utm20n, round(y_utm20n, 4) AS y_utm20n FROM utm_short")
def project_utm(spark, d):
    projected = geometry.project_utm(s.detections_short(spark, d))
    return rounded(projected.select("event_id", "x_utm20n", "y_utm20n"), 4)


@query(
    "point_in_polygon",
    f"""SELECT d.event_id, i.inside FROM det_short d
        JOIN ({inside_sql('det_short', 'long_nad83', 'lat_nad83')}) i
          ON i.long_nad83 = d.long_nad83 AND i.lat_nad83 = d.lat_nad83 CROSS JOIN (SELECT count(*) FROM edges)""",
)
def point_in_polygon(spark, d):
    det = s.detections_short(spark, d)
    return geometry.point_in_polygon(det, "long_nad83", "lat_nad83", s.RING).select("event_id", "inside")


@query(
    "points_in_rings",
    """SELECT d.event_id, i.area FROM det_short d JOIN (
         SELECT lon, lat, area,
                bool_or((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
                        AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))
                OR (count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) <> 0
                                     AND ((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) > 0) = (y2 > y1))) % 2 = 1 AS inside
         FROM places CROSS JOIN area_edges GROUP BY ALL) i ON i.lon = d.long_nad83 AND i.lat = d.lat_nad83
       WHERE i.inside""",
)
def points_in_rings(spark, d):
    det, areas = s.detections_short(spark, d), s.closed_areas(spark, d)
    return geometry.points_in_rings(det, "long_nad83", "lat_nad83", areas, "area", "outline").select("event_id", "area")


@query("bin_positions", "SELECT * FROM occupied")
def bin_positions(spark, d):
    return s.occupied_bins(s.dated_short(spark, d))


@query("zone_of_bin", "SELECT transmitter, date, halfhour, avg_long, avg_lat, mssca FROM zoned")
def zone_of_bin(spark, d):
    return s.located_bins(spark, d).select("transmitter", "date", "halfhour", "avg_long", "avg_lat", "mssca")


@query("fill_gaps", "SELECT * FROM bins")
def fill_gaps(spark, d):
    return s.bins(spark, d)


@query(
    "zone_share",
    "SELECT round(CAST(count(*) FILTER (WHERE mssca = 'in') AS DOUBLE) / count(*) * 100, 9) AS pct_in FROM bins WHERE mssca IS NOT NULL",
)
def zone_share(spark, d):
    return rounded(binning.zone_share(s.located_bins(spark, d).select("mssca")))


@query(
    "zone_share_by_year",
    """SELECT year, round(CAST(i AS DOUBLE) / (i + o) * 100, 9) AS "in", round(CAST(o AS DOUBLE) / (i + o) * 100, 9) AS "out", i + o AS sum
       FROM (SELECT year, nullif(count(*) FILTER (WHERE mssca = 'in'), 0) AS i,
                    nullif(count(*) FILTER (WHERE mssca = 'out'), 0) AS o
             FROM bins WHERE mssca IS NOT NULL GROUP BY year)""",
)
def zone_share_by_year(spark, d):
    return rounded(binning.zone_share_by_year(s.located_bins(spark, d).select("year", "mssca")))


@query("detections_by_halfhour_zone", "SELECT * FROM zone_cells")
def detections_by_halfhour_zone(spark, d):
    return binning.detections_by_halfhour_zone(s.located_bins(spark, d))


POSITION = """
SELECT {keys}, round(avg(avg_lat), 9) AS avglat, round(avg(avg_long), 9) AS avglong, count(*) AS n,
       round(stddev_samp(avg_long) / sqrt(count(*)), 9) AS se
FROM bins WHERE avg_lat IS NOT NULL {where} GROUP BY {keys}
"""
IN_JAN = "AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"


@query("position_by_halfhour", POSITION.format(keys="transmitter, year, halfhour", where=""))
def position_by_halfhour(spark, d):
    return rounded(binning.position_by(s.located_bins(spark, d), "transmitter", "year", "halfhour"))


@query("position_by_day_halfhour", POSITION.format(keys="date, halfhour", where=IN_JAN))
def position_by_day_halfhour(spark, d):
    kept = restrict.between_dates(s.located_bins(spark, d), *JAN)
    return rounded(binning.position_by(kept, "date", "halfhour")).orderBy("avglong", "date", "halfhour")


@query("position_window", POSITION.format(keys="transmitter, halfhour", where=IN_JAN))
def position_window(spark, d):
    kept = restrict.between_dates(s.located_bins(spark, d), *JAN)
    return rounded(binning.position_by(kept, "transmitter", "halfhour"))


@query("presence_by_month", "SELECT * FROM tag_months")
def presence_by_month(spark, d):
    return binning.presence_by_month(s.month_bins(spark, d))


@query(
    "tide_overlay",
    """SELECT b.transmitter, b.date, b.halfhour, b.avg_long, s.slack_halfhour, b.halfhour - s.slack_halfhour AS hours_from_slack
       FROM bins b JOIN slack s ON s.date = b.date
       WHERE b.avg_lat IS NOT NULL AND b.date >= DATE '2024-01-05' AND b.date < DATE '2024-01-12'""",
)
def tide_overlay(spark, d):
    bins = s.located_bins(spark, d)
    tides = restrict.between_dates(s.slack_tides(bins), *JAN, closed=False, located=None)
    kept = restrict.between_dates(bins, *JAN, closed=False)
    beside = binning.tide_overlay(kept, tides)
    return beside.select("transmitter", "date", "halfhour", "avg_long", "slack_halfhour", "hours_from_slack")


@query(
    "tide_nearest",
    """SELECT b.transmitter, b.date, b.halfhour, b.avg_long, n.slack_date, n.slack_halfhour, n.hours_from_slack
       FROM bins b JOIN (
         SELECT t.date, t.halfhour, s.date AS slack_date, s.slack_halfhour,
                datediff('day', s.date, t.date) * 24e0 + t.halfhour - s.slack_halfhour AS hours_from_slack
         FROM (SELECT DISTINCT date, halfhour FROM bins) t CROSS JOIN slack s
         QUALIFY row_number() OVER (PARTITION BY t.date, t.halfhour ORDER BY abs(hours_from_slack), s.date, s.slack_halfhour) = 1
       ) n ON n.date = b.date AND n.halfhour = b.halfhour
       WHERE b.avg_lat IS NOT NULL""",
)
def tide_nearest(spark, d):
    bins = s.located_bins(spark, d)
    beside = binning.tide_nearest(bins, s.slack_tides(bins))
    return beside.select("transmitter", "date", "halfhour", "avg_long", "slack_date", "slack_halfhour", "hours_from_slack")


@query("current_means", "SELECT * FROM current_means")
def current_means(spark, d):
    return summary.current_means(s.currents(spark, d))


@query("current_component", "SELECT ts_local, direction_1_9, speed_1_9, round(direction_1_9_s, 9) AS direction_1_9_s FROM east")
def current_component(spark, d):
    return rounded(geometry.current_component(summary.current_means(s.currents(spark, d))))


EAST_JAN = "ts_local >= TIMESTAMP '2024-01-05 00:00:00' AND ts_local <= TIMESTAMP '2024-01-12 00:00:00'"


def _east(spark, d):
    return geometry.current_component(summary.current_means(restrict.between_midnights(s.currents(spark, d), *JAN)))


@query(
    "current_by_hour",
    f"""SELECT hour, n, round(mean, 9) AS mean, round(se, 9) AS se, round(mean - se, 9) AS ymin, round(mean + se, 9) AS ymax
        FROM (SELECT CAST(hour(ts_local) AS INTEGER) AS hour, count(*) AS n, avg(direction_1_9_s) AS mean,
                     stddev_samp(direction_1_9_s) / sqrt(count(*)) AS se
              FROM east WHERE {EAST_JAN} GROUP BY hour(ts_local))""",
)
def current_by_hour(spark, d):
    return rounded(summary.current_by_hour(_east(spark, d)))


BOX_SQL = """
SELECT e.*, q.lower, q.middle, q.upper, v BETWEEN lower - 15e-1 * (upper - lower) AND upper + 15e-1 * (upper - lower) AS inner_row
FROM (SELECT CAST(hour(ts_local) AS INTEGER) AS hour, direction_1_9_s AS v FROM east) e
JOIN (SELECT CAST(hour(ts_local) AS INTEGER) AS hour, quantile_cont(direction_1_9_s, 0.25) AS lower,
             quantile_cont(direction_1_9_s, 0.5) AS middle, quantile_cont(direction_1_9_s, 0.75) AS upper
      FROM east GROUP BY 1) q ON q.hour = e.hour
"""


def _east_hours(spark, d):
    east = geometry.current_component(summary.current_means(s.currents(spark, d)))
    return east.select(F.hour("ts_local").alias("hour"), F.col("direction_1_9_s").alias("v"))


@query(
    "boxplot_stats",
    f"""SELECT hour, round(min(v) FILTER (WHERE inner_row), 9) AS ymin, round(lower, 9) AS lower, round(middle, 9) AS middle,
               round(upper, 9) AS upper, round(max(v) FILTER (WHERE inner_row), 9) AS ymax,
               count(*) FILTER (WHERE NOT inner_row) AS outliers FROM ({BOX_SQL}) GROUP BY hour, lower, middle, upper""",
)
def boxplot_stats(spark, d):
    return rounded(distribution.boxplot_stats(_east_hours(spark, d), "v", ["hour"]))


@query("boxplot_outliers", f"SELECT hour, round(v, 9) AS v, count(*) AS n FROM ({BOX_SQL}) WHERE NOT inner_row GROUP BY hour, v")
def boxplot_outliers(spark, d):
    return rounded(distribution.boxplot_outliers(_east_hours(spark, d), "v", ["hour"]))


LOESS_SQL = """
SELECT {keys} x, n, round(fitted, 7) AS fitted
FROM (SELECT {keys} x, n,
             CASE WHEN abs(det) > abs(s0 * (s2 * s4 - s3 * s3)) * 1e-12
                  THEN (t0 * (s2 * s4 - s3 * s3) - t1 * (s1 * s4 - s2 * s3) + t2 * (s1 * s3 - s2 * s2)) / det END AS fitted
      FROM (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det
            FROM (SELECT {akeys} a.x, a.n, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3,
                         sum(w * u * u * u * u) AS s4, sum(wy) AS t0, sum(wy * u) AS t1, sum(wy * u * u) AS t2
                  FROM (SELECT a.*, b.x - a.x AS u,
                               CASE WHEN abs(b.x - a.x) < a.h THEN (1 - (abs(b.x - a.x) / a.h) ** 3) ** 3 ELSE 0 END * b.n AS w,
                               CASE WHEN abs(b.x - a.x) < a.h THEN (1 - (abs(b.x - a.x) / a.h) ** 3) ** 3 ELSE 0 END * b.sy AS wy
                        FROM (SELECT {keys} x, n, min(dist) FILTER (WHERE seen >= floor(total * 0.75 + 1e-5)) AS h
                              FROM (SELECT {akeys} a.x, a.n, abs(b.x - a.x) AS dist,
                                           sum(b.n) OVER (PARTITION BY {akeys} a.x ORDER BY abs(b.x - a.x)) AS seen,
                                           sum(b.n) OVER (PARTITION BY {akeys} a.x) AS total
                                    FROM ({pts}) a JOIN ({pts}) b ON {same}) GROUP BY ALL) a
                        JOIN ({pts}) b ON {same} WHERE a.h > 0) a
                  GROUP BY {akeys} a.x, a.n)))
"""


def _loess_sql(keys: str, source: str) -> str:
    names = [k for k in keys.split(", ") if k]
    lead = "".join(f"{k}, " for k in names)
    pts = f"SELECT {lead} halfhour AS x, count(*) AS n, sum(y) AS sy FROM ({source}) GROUP BY ALL"
    same = " AND ".join(f"b.{k} = a.{k}" for k in names) or "TRUE"
    return LOESS_SQL.format(keys=lead, akeys="".join(f"a.{k}, " for k in names), pts=pts, same=same)


@query(
    "local_regression",
    _loess_sql(
        "year",
        "SELECT year, halfhour, avg(avg_long) AS y FROM bins WHERE avg_lat IS NOT NULL GROUP BY transmitter, year, halfhour",
    ),
)
def local_regression(spark, d):
    points = binning.position_by(s.located_bins(spark, d), "transmitter", "year", "halfhour")
    return rounded(distribution.local_regression(points, "avglong", "halfhour", ["year"]), 7)


@query(
    "local_regression_by_date",
    _loess_sql(
        "date",
        """SELECT date, halfhour, avg_long AS y FROM bins
           WHERE avg_lat IS NOT NULL AND date >= DATE '2024-01-05' AND date < DATE '2024-01-12'""",
    ),
)
def local_regression_by_date(spark, d):
    kept = restrict.between_dates(s.located_bins(spark, d), *JAN, closed=False)
    return rounded(distribution.local_regression(kept, "avg_long", "halfhour", ["date"]), 7)


@query(
    "local_regression_window",
    _loess_sql(
        "",
        """SELECT transmitter, halfhour, avg(avg_long) AS y FROM bins
           WHERE avg_lat IS NOT NULL AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY transmitter, halfhour""",
    ),
)
def local_regression_window(spark, d):
    kept = restrict.between_dates(s.located_bins(spark, d), *JAN)
    points = binning.position_by(kept, "transmitter", "halfhour")
    return rounded(distribution.local_regression(points, "avglong", "halfhour"), 7)
