"""Choosing rows: stations, tags, dates, and the flags derived from rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from reefpulse.functions.clock import half_hour, midnight, second_of_minute
from reefpulse.operators.joining import join_null_safe


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias(key))


def at_stations(det: DataFrame, stations: DataFrame, key: str = "station") -> DataFrame:
    """Detections at a listed station."""
    return join_null_safe(det, _keys(stations, key), [key], "left_semi")


def off_stations(det: DataFrame, stations: DataFrame, key: str = "station") -> DataFrame:
    """Detections at other arrays."""
    return join_null_safe(det, _keys(stations, key), [key], "left_anti")


def flag_listed(det: DataFrame, stations: DataFrame, key: str = "station") -> DataFrame:
    """Detections with a boolean ``listed``; one pass over them."""
    known = _keys(stations, key).distinct().withColumn("listed", F.lit(True))
    return join_null_safe(det, known, [key]).withColumn("listed", F.coalesce("listed", F.lit(False)))


def at_zoned_stations(det: DataFrame, stations: DataFrame) -> DataFrame:
    """Detections at a listed station with its ``mssca``, by one join."""
    zones = stations.select(F.col("station").cast("string").alias("station"), "mssca")
    return join_null_safe(det, zones, ["station"], "inner")


def stations_visited(det: DataFrame) -> DataFrame:
    return det.select("station").distinct()


def flag_visited(stations: DataFrame, det: DataFrame) -> DataFrame:
    """Listed stations with a boolean ``visited``."""
    seen = stations_visited(det).withColumn("visited", F.lit(True))
    keyed = stations.withColumn("station", F.col("station").cast("string"))
    return join_null_safe(keyed, seen, ["station"]).withColumn("visited", F.coalesce("visited", F.lit(False)))


def stations_unvisited(stations: DataFrame, det: DataFrame) -> DataFrame:
    keyed = stations.withColumn("station", F.col("station").cast("string"))
    return join_null_safe(keyed, stations_visited(det), ["station"], "left_anti")


def attach_zone(det: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds the station's ``mssca`` (in / out); null for a station not listed."""
    zones = stations.select(F.col("station").cast("string").alias("station"), "mssca")
    return join_null_safe(det, zones, ["station"])


def split_datetime(det: DataFrame, ts: str = "detection_time_ast") -> DataFrame:
    """Adds year, date, hour, min and sec (sec keeps its fraction)."""
    c = F.col(ts)
    return det.withColumns(
        {
            "year": F.year(c),
            "date": c.cast("date"),
            "hour": F.hour(c),
            "min": F.minute(c),
            "sec": second_of_minute(c).cast("double"),
        }
    )


def add_half_hour(det: DataFrame, ts: str = "detection_time_ast") -> DataFrame:
    return det.withColumn("halfhour", half_hour(ts))


def trim_tag_day(det: DataFrame, tags: DataFrame) -> DataFrame:
    """Drops detections up to and including the tag's release date."""
    release = tags.select("transmitter", "release_date")
    return det.join(release, "transmitter").filter(F.col("date") > F.col("release_date")).drop("release_date")


def keep_tags(det: DataFrame, allow: Iterable[str] | DataFrame) -> DataFrame:
    """Detections of the analysed tags, given as a short list or as a table."""
    if isinstance(allow, DataFrame):
        return det.join(allow.select("transmitter"), "transmitter", "left_semi")
    return det.filter(F.col("transmitter").isin(list(allow)))


def keep_dimension(tags: DataFrame, species: str, sites: Iterable[str]) -> DataFrame:
    return tags.filter((F.col("species") == species) & F.col("release_site").isin(list(sites)))


def between_dates(
    bins: DataFrame, start: dt.date, end: dt.date, *, closed: bool = True, located: str | None = "avg_lat"
) -> DataFrame:
    """Rows from ``start`` to ``end``, the end included if ``closed``; with
    ``located``, only rows where that column is known."""
    upper = F.col("date") <= F.lit(end) if closed else F.col("date") < F.lit(end)
    out = bins.filter((F.col("date") >= F.lit(start)) & upper)
    return out.filter(F.col(located).isNotNull()) if located else out


def between_midnights(df: DataFrame, start: dt.date, end: dt.date, ts: str = "ts_local") -> DataFrame:
    """Rows from midnight of ``start`` to midnight of ``end``, both included."""
    return df.filter(F.col(ts).between(midnight(F.lit(start)), midnight(F.lit(end))))


def before_date(df: DataFrame, end: dt.date, ts: str) -> DataFrame:
    return df.filter(F.col(ts) < midnight(F.lit(end)))


def flag_presence(bins: DataFrame) -> DataFrame:
    """'P' for a bin with any station, 'A' for none, null if unknown."""
    n = F.col("no_stations")
    return bins.withColumn("pa", F.when(n > 0, "P").when(n <= 0, "A"))


def categorize_depth(depth: DataFrame, shallow: float = -10.0, deep: float = -30.0) -> DataFrame:
    """Adds z (negative downwards) and its class; both limits are exclusive."""
    z = -F.col("sensor_value")
    return depth.withColumn("z", z).withColumn(
        "depthcat", F.when(F.col("z") > shallow, "shallow").when(F.col("z") < deep, "deep")
    )


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def month_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """Adds monthint, monthname, year_text and year_month (text YYYY-MM)."""
    d = F.col(date)
    return df.withColumns(
        {
            "monthint": F.month(d),
            "monthname": F.date_format(d, "MMM"),
            "year_text": F.date_format(d, "yyyy"),
            "year_month": F.substring(d.cast("string"), 1, 7),
        }
    )


def tag_short_id(df: DataFrame, tag: str = "transmitter") -> DataFrame:
    """Adds the serial part of a tag name, characters 10 to 14."""
    return df.withColumn("short_id", F.substring(F.col(tag), 10, 5))
