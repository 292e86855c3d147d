from __future__ import annotations

import pytest

from reefpulse.functions.clock import micros, slot_date, slot_half_hour, slot_of
from reefpulse.operators import restrict
from tests.frames import DET_SCHEMA, day, detections, ts, tuples

STATIONS = "station string, mssca string, years_deployed int"


@pytest.fixture
def master(spark):
    return spark.createDataFrame([("1", "in", 1), ("2", "out", 2), (None, "in", 1)], STATIONS)


def test_null_station_matches_null(spark, master):
    det = detections(spark, [("a", "1", "2024-01-01 00:00"), ("a", None, "2024-01-01 00:01"), ("a", "9", "2024-01-01 00:02")])
    assert tuples(restrict.at_stations(det, master), "station") == [("1",), (None,)]
    assert tuples(restrict.off_stations(det, master), "station") == [("9",)]
    zones = tuples(restrict.attach_zone(det, master), "station", "mssca")
    assert zones == [("1", "in"), ("9", None), (None, "in")]


def test_semi_and_anti_make_up_the_input(spark, master):
    det = detections(spark, [("a", str(i % 4), f"2024-01-01 00:{i:02d}") for i in range(20)])
    both = restrict.at_stations(det, master).count() + restrict.off_stations(det, master).count()
    assert both == det.count()


def test_numeric_station_list(spark):
    det = detections(spark, [("a", "1", "2024-01-01 00:00")])
    numbers = spark.createDataFrame([(1, "in", 1), (5, "out", 2)], "station int, mssca string, years_deployed int")
    assert restrict.at_stations(det, numbers).count() == 1
    assert tuples(restrict.stations_unvisited(numbers, det), "station") == [("5",)]
    assert tuples(restrict.flag_visited(numbers, det), "station", "visited") == [("1", True), ("5", False)]


def test_trim_is_strict_and_drops_unknown_tags(spark):
    det = restrict.split_datetime(
        detections(spark, [("a", "1", "2024-01-02 23:59"), ("a", "1", "2024-01-03 00:00"), ("b", "1", "2024-01-03 00:00")])
    )
    tags = spark.createDataFrame([("a", day("2024-01-02"))], "transmitter string, release_date date")
    assert tuples(restrict.trim_tag_day(det, tags), "transmitter", "date") == [("a", day("2024-01-03"))]


def test_empty_in_empty_out(spark, master):
    none = spark.createDataFrame([], DET_SCHEMA)
    split = restrict.add_half_hour(restrict.split_datetime(restrict.at_stations(none, master)))
    assert split.count() == 0


def test_half_hour_edges(spark):
    det = detections(spark, [("a", "1", "2024-01-01 10:29:59.999999"), ("a", "1", "2024-01-01 10:30:00"), ("a", "1", "2024-01-01 23:59")])
    assert [r[0] for r in tuples(restrict.add_half_hour(det), "halfhour")] == [10.0, 10.5, 23.5]


def test_wall_clock_ignores_the_session_zone(spark):
    det = detections(spark, [("a", "1", "2024-03-10 02:30:00.25")])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = restrict.split_datetime(restrict.add_half_hour(det)).withColumn("us", micros("detection_time_ast")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (r.hour, r.min, r.sec, r.halfhour) == (2, 30, 0.25, 2.5)
    assert r.us == 1_710_037_800_250_000


def test_slots_before_and_after_the_epoch(spark):
    df = spark.createDataFrame([(day("1969-12-31"), 23.5), (day("2024-02-29"), 0.0)], "date date, halfhour double")
    df = df.withColumn("slot", slot_of("date", "halfhour"))
    df = df.withColumns({"d": slot_date("slot"), "h": slot_half_hour("slot")})
    assert all((r.date, r.halfhour) == (r.d, r.h) for r in df.collect())
    assert [r.slot for r in df.collect()][0] == -1


def test_midnight_of_the_end_date_is_included(spark):
    rows = [(ts(t),) for t in ("2024-01-01 23:59", "2024-01-02 00:00", "2024-01-03 00:00", "2024-01-03 00:01")]
    df = spark.createDataFrame(rows, "ts_local timestamp_ntz")
    kept = restrict.between_midnights(df, day("2024-01-02"), day("2024-01-03"))
    assert [r[0] for r in tuples(kept)] == [ts("2024-01-02 00:00"), ts("2024-01-03 00:00")]
    assert restrict.before_date(df, day("2024-01-03"), "ts_local").count() == 2


def test_depth_limits_fall_in_neither_class(spark):
    df = spark.createDataFrame([(x,) for x in (9.9, 10.0, 30.0, 30.1, None)], "sensor_value double")
    got = {r.sensor_value: r.depthcat for r in restrict.categorize_depth(df).collect()}
    assert got == {9.9: "shallow", 10.0: None, 30.0: None, 30.1: "deep", None: None}


def test_presence_of_unknown_is_unknown(spark):
    df = spark.createDataFrame([(0,), (3,), (None,)], "no_stations long")
    assert {r.no_stations: r.pa for r in restrict.flag_presence(df).collect()} == {0: "A", 3: "P", None: None}


def test_tag_list_and_tag_table_agree(spark):
    det = detections(spark, [("a", "1", "2024-01-01 00:00"), ("b", "1", "2024-01-01 00:00")])
    table = spark.createDataFrame([("b",), ("z",)], "transmitter string")
    assert tuples(restrict.keep_tags(det, ["b", "z"])) == tuples(restrict.keep_tags(det, table))


def test_short_id(spark):
    df = spark.createDataFrame([("A69-1601-24991",)], "transmitter string")
    assert restrict.tag_short_id(df).first().short_id == "24991"
