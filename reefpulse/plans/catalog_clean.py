"""Reading, writing, restricting and splitting detections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reefpulse.operators import binning, restrict, visits
from reefpulse.plans import stages
from reefpulse.plans import surrogate as s
from reefpulse.plans.registry import query, rounded
from reefpulse.session import shared_folder
from reefpulse.sources import readers, schemas
from reefpulse.sources.writers import write_per_key

JAN = (dt.date(2024, 1, 5), dt.date(2024, 1, 12))
DET = [name for _, _, name in schemas.DETECTIONS]
DET_SQL = ", ".join(DET)


def _csv(df, path):
    df.write.option("header", True).option("nullValue", "NA").csv(path)
    return path


@query("scan_detections", f"SELECT {DET_SQL} FROM det_short")
def scan_detections(spark, d):
    path = shared_folder(spark, "detections")
    write_per_key(s.detections_short(spark, d), path, fmt="csv")
    return readers.read_detections(spark, path)


@query(
    "scan_allowlist",
    "SELECT b.* FROM bins b WHERE transmitter IN (SELECT transmitter FROM analysed)",
)
def scan_allowlist(spark, d):
    days = s.gap_days(spark, d)
    path = write_per_key(days, shared_folder(spark, "bins"), expand=binning.fill_days, size=binning.half_hours())
    mine = restrict.keep_tags(readers.stage_folders(spark, path), s.analysed_tags(spark, d))
    return restrict.flag_presence(readers.read_folders(spark, path, binning.fill_days(days).schema, mine))


@query("scan_typed_dim", "SELECT * FROM tags")
def scan_typed_dim(spark, d):
    names = {new: old for old, _, new in schemas.TRANSMITTERS}
    text = s.transmitter_master(spark, d).withColumns(
        {
            "release_date": F.date_format("release_date", "M/d/yy"),
            "tl": F.coalesce(F.col("tl").cast("string"), F.lit("unknown")),
        }
    )
    path = _csv(text.withColumnsRenamed(names), shared_folder(spark, "tags"))
    return readers.read_dimension(spark, path, schemas.TRANSMITTERS, {"release_date": "M/d/yy"})


@query(
    "scan_moon_table",
    """SELECT strftime(datetime_utc, '%b') AS month, CAST(day(datetime_utc) AS INTEGER) AS day,
              CAST(year(datetime_utc) AS INTEGER) AS year, strftime(datetime_utc, '%H:%M:%S') AS time_utc,
              datetime_utc, datetime_local, date FROM moons_long""",
)
def scan_moon_table(spark, d):
    """Writes the table as a file while the query is built, and reads it back."""
    rows = s.moon_rows(s.detections_long(spark, d)).withColumnsRenamed({new: old for old, _, new in schemas.MOONS})
    return readers.read_moons(spark, _csv(rows, shared_folder(spark, "moons")))


@query("scan_currents", "SELECT * FROM currents")
def scan_currents(spark, d):
    names = {new: old for old, _, new in schemas.currents(s.DEPTH_BINS)}
    text = s.currents(spark, d).withColumn("ts_local", F.date_format("ts_local", "M/d/yy H:mm"))
    path = _csv(text.withColumnsRenamed(names), shared_folder(spark, "currents"))
    return readers.read_currents(spark, path)


@query("sink_per_key", "SELECT * FROM det_short")
def sink_per_key(spark, d):
    det = s.detections_short(spark, d)
    path = write_per_key(det, shared_folder(spark, "per-tag"))
    return readers.read_stage(spark, path, det.schema)


@query(
    "sink_migration",
    f"SELECT {DET_SQL} FROM det_short WHERE station NOT IN (SELECT station FROM stations)",
)
def sink_migration(spark, d):
    away = restrict.off_stations(s.detections_short(spark, d), s.station_master(spark, d))
    path = shared_folder(spark, "migration")
    write_per_key(away.select(DET), path, fmt="csv")
    return readers.read_detections(spark, path)


@query("project_columns", f"SELECT {DET_SQL} FROM det_short")
def project_columns(spark, d):
    return s.detections_short(spark, d).select(DET)


@query(
    "split_datetime",
    "SELECT event_id, year, date, hour, min, round(sec, 6) AS sec FROM dated_short",
)
def split_datetime(spark, d):
    split = restrict.split_datetime(s.detections_short(spark, d))
    return rounded(split.select("event_id", "year", "date", "hour", "min", "sec"), 6)


@query(
    "trim_tag_day",
    """SELECT d.event_id, d.transmitter, d.date FROM dated_short d JOIN tags t ON t.transmitter = d.transmitter
       WHERE d.date > t.release_date""",
)
def trim_tag_day(spark, d):
    split = restrict.split_datetime(s.detections_short(spark, d))
    return restrict.trim_tag_day(split, s.transmitter_master(spark, d)).select("event_id", "transmitter", "date")


@query(
    "filter_allowlist",
    f"SELECT {DET_SQL} FROM det_short WHERE transmitter IN (SELECT transmitter FROM analysed)",
)
def filter_allowlist(spark, d):
    return restrict.keep_tags(s.detections_short(spark, d), s.analysed_tags(spark, d)).select(DET)


@query(
    "filter_dim_predicate",
    "SELECT * FROM tags WHERE species = 'tagged' AND release_site IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')",
)
def filter_dim_predicate(spark, d):
    return restrict.keep_dimension(s.transmitter_master(spark, d), "tagged", s.ANALYSED_SITES)


@query(
    "filter_date_closed",
    """SELECT transmitter, date, halfhour, avg_lat, avg_long FROM bins
       WHERE avg_lat IS NOT NULL AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""",
)
def filter_date_closed(spark, d):
    kept = restrict.between_dates(s.located_bins(spark, d), *JAN)
    return kept.select("transmitter", "date", "halfhour", "avg_lat", "avg_long")


@query(
    "filter_date_half_open",
    """SELECT transmitter, date, halfhour, no_detections FROM bins
       WHERE date >= DATE '2024-01-05' AND date < DATE '2024-01-12'""",
)
def filter_date_half_open(spark, d):
    kept = restrict.between_dates(s.bins(spark, d), *JAN, closed=False, located=None)
    return kept.select("transmitter", "date", "halfhour", "no_detections")


@query(
    "filter_ts_by_date",
    """SELECT * FROM currents
       WHERE ts_local >= TIMESTAMP '2024-01-05 00:00:00' AND ts_local <= TIMESTAMP '2024-01-12 00:00:00'""",
)
def filter_ts_by_date(spark, d):
    return restrict.between_midnights(s.currents(spark, d), *JAN)


@query(
    "filter_ts_before_date",
    "SELECT transmitter, detection_time_ast, z FROM depth WHERE detection_time_ast < TIMESTAMP '2024-01-12 00:00:00'",
)
def filter_ts_before_date(spark, d):
    depth = restrict.before_date(s.categorized_depth(spark, d), JAN[1], "detection_time_ast")
    return depth.select("transmitter", "detection_time_ast", "z")


@query("flag_presence", "SELECT transmitter, date, halfhour, no_stations, pa FROM bins")
def flag_presence(spark, d):
    return s.bins(spark, d).select("transmitter", "date", "halfhour", "no_stations", "pa")


@query("categorize_depth", "SELECT transmitter, detection_time_ast, z, depthcat FROM depth")
def categorize_depth(spark, d):
    return s.categorized_depth(spark, d).select("transmitter", "detection_time_ast", "z", "depthcat")


@query(
    "drop_any_null",
    """SELECT transmitter, date, halfhour, mssca FROM bins
       WHERE avg_lat IS NOT NULL AND avg_long IS NOT NULL AND mssca IS NOT NULL AND dafm IS NOT NULL""",
)
def drop_any_null(spark, d):
    return restrict.drop_any_null(s.bins(spark, d)).select("transmitter", "date", "halfhour", "mssca")


@query(
    "month_parts",
    """SELECT event_id, CAST(month(date) AS INTEGER) AS monthint, strftime(date, '%b') AS monthname,
              strftime(date, '%Y') AS year_text, strftime(date, '%Y-%m') AS year_month FROM dated_long""",
)
def month_parts(spark, d):
    split = restrict.month_parts(restrict.split_datetime(s.detections_long(spark, d)))
    return split.select("event_id", "monthint", "monthname", "year_text", "year_month")


@query(
    "tag_short_id",
    """SELECT event_id, transmitter, substr(transmitter, 10, 5) AS short_id
       FROM (SELECT event_id, 'A69-1601-' || lpad(transmitter, 5, '0') AS transmitter FROM det_short)""",
)
def tag_short_id(spark, d):
    det = s.detections_short(spark, d)
    named = det.withColumn("transmitter", F.concat(F.lit("A69-1601-"), F.lpad("transmitter", 5, "0")))
    return restrict.tag_short_id(named).select("event_id", "transmitter", "short_id")


@query("semi_station", f"SELECT {DET_SQL} FROM det_short WHERE station IN (SELECT station FROM stations)")
def semi_station(spark, d):
    return restrict.at_stations(s.detections_short(spark, d), s.station_master(spark, d)).select(DET)


@query("anti_station", f"SELECT {DET_SQL} FROM det_short WHERE station NOT IN (SELECT station FROM stations)")
def anti_station(spark, d):
    return restrict.off_stations(s.detections_short(spark, d), s.station_master(spark, d)).select(DET)


@query(
    "membership",
    "SELECT event_id, station, station IN (SELECT station FROM stations) AS listed FROM det_short",
)
def membership(spark, d):
    det, master = s.detections_short(spark, d), s.station_master(spark, d)
    return restrict.flag_listed(det, master).select("event_id", "station", "listed")


@query(
    "stations_unvisited",
    "SELECT * FROM stations WHERE station NOT IN (SELECT station FROM det_short)",
)
def stations_unvisited(spark, d):
    return restrict.stations_unvisited(s.station_master(spark, d), s.detections_short(spark, d))


@query(
    "stations_visited_counts",
    """SELECT visited, count(*) AS n FROM (SELECT station IN (SELECT station FROM det_short) AS visited FROM stations)
       GROUP BY visited""",
)
def stations_visited_counts(spark, d):
    flagged = restrict.flag_visited(s.station_master(spark, d), s.detections_short(spark, d))
    return flagged.groupBy("visited").agg(F.count(F.lit(1)).alias("n"))


@query("stations_visited", "SELECT DISTINCT station FROM det_short")
def stations_visited(spark, d):
    return restrict.stations_visited(s.detections_short(spark, d))


@query(
    "attach_zone",
    "SELECT d.event_id, d.station, s.mssca FROM det_short d LEFT JOIN stations s ON s.station = d.station",
)
def attach_zone(spark, d):
    zoned = restrict.attach_zone(s.detections_short(spark, d), s.station_master(spark, d))
    return zoned.select("event_id", "station", "mssca")


@query(
    "time_gap",
    """SELECT event_id, transmitter, station,
              (epoch_us(lead(detection_time_ast) OVER (PARTITION BY transmitter ORDER BY detection_time_ast, station, event_id))
               - epoch_us(detection_time_ast)) / 1e6 AS timediff FROM det_short""",
)
def time_gap(spark, d):
    gaps = visits.time_gap(s.detections_short(spark, d), ties=("station", "event_id"))
    return gaps.select("event_id", "transmitter", "station", "timediff")


@query(
    "processed_detections",
    """SELECT p.event_id, p.transmitter, p.station, p.year, p.date, p.hour, p.min, p.dafm, s.mssca, p.timediff,
              round(p.x_utm20n, 4) AS x_utm20n, round(p.y_utm20n, 4) AS y_utm20n
       FROM (SELECT u.*, (epoch_us(lead(detection_time_ast) OVER (PARTITION BY transmitter ORDER BY detection_time_ast, station, event_id))
                    - epoch_us(detection_time_ast)) / 1e6 AS timediff
             FROM utm_short u WHERE station IN (SELECT station FROM stations)) p
       JOIN stations s ON s.station = p.station""",
)
def processed_detections(spark, d):
    """The whole first stage."""
    det = s.detections_short(spark, d)
    out = stages.clean(det, s.station_master(spark, d), s.moons(det), ties=("station", "event_id"))
    columns = ["event_id", "transmitter", "station", "year", "date", "hour", "min", "dafm", "mssca", "timediff"]
    return rounded(out.select(*columns, "x_utm20n", "y_utm20n"), 4, timediff=6)


def _cut(spark, d):
    """Tags are restricted first: nothing is computed for rows that go, nor the gap, which no one reads."""
    det = s.detections_short(spark, d)
    mine = restrict.keep_tags(det, s.analysed_tags(spark, d))
    cleaned = stages.clean(mine, s.station_master(spark, d), s.moons(det), gap=False)
    return restrict.trim_tag_day(cleaned, s.transmitter_master(spark, d))


@query(
    "cut_detections",
    "SELECT event_id, transmitter, station, date, halfhour, dafm FROM cut_short",
)
def cut_detections(spark, d):
    """The first two stages."""
    columns = ["event_id", "transmitter", "station", "date", "halfhour", "dafm"]
    return restrict.add_half_hour(_cut(spark, d)).select(columns)


@query("cut_bins", "SELECT * EXCLUDE (pa) FROM cut_bins")
def cut_bins(spark, d):
    """All three stages: gap-free bins of the analysed tags on the array."""
    return stages.bin_half_hours(_cut(spark, d), s.RING, s.moons(s.detections_short(spark, d)))
