"""Column names as they stand in the files, their types, and the names used here.

Each table is a list of (file column, type, column). Reading always goes by a
schema built from these lists; nothing is inferred.
"""

from __future__ import annotations

Columns = list[tuple[str, str, str]]

DETECTIONS: Columns = [
    ("station", "string", "station"),
    ("transmitter", "string", "transmitter"),
    ("detection_time_ast", "timestamp_ntz", "detection_time_ast"),
    ("lat_nad83", "double", "lat_nad83"),
    ("long_nad83", "double", "long_nad83"),
]

DEPTH_DETECTIONS: Columns = DETECTIONS + [("sensor_value", "double", "sensor_value")]

BINS: Columns = [
    ("transmitter", "string", "transmitter"),
    ("year", "int", "year"),
    ("date", "date", "date"),
    ("halfhour", "double", "halfhour"),
    ("No.stations", "bigint", "no_stations"),
    ("No.detections", "bigint", "no_detections"),
    ("DAFM", "int", "dafm"),
    ("avg_lat", "double", "avg_lat"),
    ("avg_long", "double", "avg_long"),
    ("avg_x", "double", "avg_x"),
    ("avg_y", "double", "avg_y"),
    ("mssca", "string", "mssca"),
]

STATIONS: Columns = [
    ("station", "string", "station"),
    ("mssca", "string", "mssca"),
    ("yearsDeployed", "int", "years_deployed"),
    ("ChessonP", "double", "chesson_p"),
]

TRANSMITTERS: Columns = [
    ("transmitter", "string", "transmitter"),
    ("species", "string", "species"),
    ("release_site", "string", "release_site"),
    ("release_year", "int", "release_year"),
    ("release_date", "date", "release_date"),
    ("TL", "double", "tl"),
    ("Sex", "string", "sex"),
    ("tag_model", "string", "tag_model"),
]

MOONS: Columns = [
    ("month", "string", "month"),
    ("day", "int", "day"),
    ("year", "int", "year"),
    ("timeUTC", "string", "time_utc"),
]

CLOSED_AREA: Columns = [("long", "double", "long"), ("lat", "double", "lat")]

CURRENT_TIME = ("DateTime(UTC-4)", "timestamp_ntz", "ts_local")


def currents(bins: int) -> Columns:
    """A profiler export with so many depth bins."""
    return (
        [CURRENT_TIME]
        + [(f"Direction {i}", "double", f"direction_{i}") for i in range(1, bins + 1)]
        + [(f"Speed {i}", "double", f"speed_{i}") for i in range(1, bins + 1)]
    )

SLACK_TIDES: Columns = [("date", "date", "date"), ("halfhour", "double", "halfhour")]

POPULATION_REPORTS: Columns = [
    ("SpawningID", "string", "spawning_id"),
    ("CurrentStatus", "string", "current_status"),
]
