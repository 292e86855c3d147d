"""Small hand-made tables."""

from __future__ import annotations

import datetime as dt

DET_SCHEMA = "transmitter string, station string, detection_time_ast timestamp_ntz, lat_nad83 double, long_nad83 double"


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def detections(spark, rows):
    """Rows of (tag, station, time text[, lat, long])."""
    full = [(r[0], r[1], ts(r[2]), *(r[3:] or (17.64, -64.86))) for r in rows]
    return spark.createDataFrame(full, DET_SCHEMA)


def dates(spark, **by_tag):
    rows = [(t, day(d)) for t, ds in by_tag.items() for d in ds]
    return spark.createDataFrame(rows, "transmitter string, date date")


def moons(spark, *texts):
    return spark.createDataFrame([(day(t),) for t in texts], "date date")


def tuples(df, *columns, sort=True):
    rows = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(rows, key=repr) if sort else rows
