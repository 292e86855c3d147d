"""Sorting, limiting, uniting and reshaping, on the study's own tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefpulse.operators import binning, restrict, visits
from reefpulse.plans import surrogate as s
from reefpulse.plans.registry import query


@query("sort_asc", "SELECT transmitter, detection_time_ast, station, event_id FROM det_short")
def sort_asc(spark, d):
    det = s.detections_short(spark, d).select("transmitter", "detection_time_ast", "station", "event_id")
    return det.orderBy("detection_time_ast", "event_id")


@query("sort_desc", "SELECT transmitter, no_days FROM attend")
def sort_desc(spark, d):
    seen = visits.attendance(restrict.split_datetime(s.detections_long(spark, d)))
    return seen.select("transmitter", "no_days").orderBy(F.desc("no_days"), "transmitter")


@query("head_n", "SELECT * FROM attend WHERE no_months > 1 ORDER BY no_months DESC, transmitter LIMIT 11")
def head_n(spark, d):
    """Top-k report: the tags seen in most months."""
    seen = visits.attendance(restrict.split_datetime(s.detections_long(spark, d)))
    return seen.filter(F.col("no_months") > 1).orderBy(F.desc("no_months"), "transmitter").limit(11)


@query(
    "union_all",
    """SELECT transmitter, station, event_id, lat_nad83 FROM det_short
       UNION ALL SELECT transmitter, station, event_id, NULL FROM det_long""",
)
def union_all(spark, d):
    short = s.detections_short(spark, d).select("transmitter", "station", "event_id", "lat_nad83")
    long = s.detections_long(spark, d).select("event_id", "station", "transmitter")
    return short.unionByName(long, allowMissingColumns=True)


@query("union_distinct", "SELECT station FROM det_short UNION SELECT station FROM det_long")
def union_distinct(spark, d):
    short, long = s.detections_short(spark, d), s.detections_long(spark, d)
    return short.select("station").union(long.select("station")).distinct()


@query("distinct_rows", "SELECT DISTINCT transmitter, date FROM dated_short")
def distinct_rows(spark, d):
    return restrict.split_datetime(s.detections_short(spark, d)).select("transmitter", "date").distinct()


@query(
    "pivot_wider",
    """SELECT transmitter, count(*) FILTER (WHERE mssca = 'in') AS "in", count(*) FILTER (WHERE mssca = 'out') AS "out"
       FROM bins WHERE mssca IS NOT NULL GROUP BY transmitter""",
)
def pivot_wider(spark, d):
    located = s.located_bins(spark, d).filter(F.col("mssca").isNotNull())
    return located.groupBy("transmitter").pivot("mssca", ["in", "out"]).count().fillna(0, ["in", "out"])


@query(
    "pivot_longer",
    """SELECT transmitter, 'no_days' AS span, no_days AS n FROM attend
       UNION ALL SELECT transmitter, 'no_months', no_months FROM attend
       UNION ALL SELECT transmitter, 'no_years', no_years FROM attend""",
)
def pivot_longer(spark, d):
    seen = visits.attendance(restrict.split_datetime(s.detections_long(spark, d)))
    return seen.unpivot(["transmitter"], ["no_days", "no_months", "no_years"], "span", "n")


@query("add_rows", "SELECT transmitter, date, halfhour, no_stations, no_detections FROM bins WHERE no_detections = 0")
def add_rows(spark, d):
    """The empty half-hours added between detections."""
    det = restrict.add_half_hour(s.dated_short(spark, d)).withColumns(
        {"x_utm20n": F.lit(0.0), "y_utm20n": F.lit(0.0)}
    )
    filled = binning.fill_gaps(binning.bin_positions(det), s.moons(s.detections_short(spark, d)))
    empty = filled.filter(F.col("no_detections") == 0)
    return empty.select("transmitter", "date", "halfhour", "no_stations", "no_detections")
