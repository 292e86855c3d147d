from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reefpulse.operators import lunar, restrict, visits
from tests.frames import dates, day, detections, moons, tuples


def _dafm(spark, moon_dates, *texts):
    df = spark.createDataFrame([(day(t),) for t in texts], "date date")
    return {str(r.date): r.dafm for r in lunar.add_dafm(df, moons(spark, *moon_dates)).collect()}


def test_dafm_between_moons(spark):
    got = _dafm(
        spark, ["2023-12-27", "2024-01-25"],
        "2024-01-01", "2024-01-15", "2024-01-16", "2024-01-24", "2024-01-25", "2024-01-30",
    )
    assert got == {
        "2024-01-01": 5, "2024-01-15": 19, "2024-01-16": -9, "2024-01-24": -1, "2024-01-25": 0, "2024-01-30": 5,
    }


def test_dafm_outside_the_moon_table(spark):
    got = _dafm(spark, ["2024-01-25"], "2024-01-15", "2024-01-16", "2024-01-24", "2024-01-25", "2025-01-25")
    assert got == {"2024-01-15": None, "2024-01-16": -9, "2024-01-24": -1, "2024-01-25": 0, "2025-01-25": 366}
    assert _dafm(spark, [], "2024-01-15") == {"2024-01-15": None}


def test_dafm_equals_comparing_with_every_moon(spark):
    rng = random.Random(7)
    moon_days = sorted(rng.sample(range(19000, 19400), 9))
    table = spark.createDataFrame([(m,) for m in moon_days + moon_days[:2]], "d int").select(F.date_from_unix_date("d").alias("date"))
    days = spark.range(18980, 19430).select(F.date_from_unix_date(F.col("id").cast("int")).alias("date"), "id")
    for r in lunar.add_dafm(days, table).collect():
        diffs = [r.id - m for m in moon_days]
        neg, pos = [x for x in diffs if x < 0], [x for x in diffs if x >= 0]
        want = max(neg) if neg and max(neg) > -10 else (min(pos) if pos else None)
        assert r.dafm == want, r


def test_dafm_threshold_is_a_parameter(spark):
    df = spark.createDataFrame([(day("2024-01-20"),)], "date date")
    table = moons(spark, "2023-12-27", "2024-01-25")
    assert lunar.add_dafm(df, table, early_days=5).first().dafm == 24
    assert lunar.add_dafm(df, table, early_days=6).first().dafm == -5


def test_arrive_depart(spark):
    rows = [("a", "2024-01-24", -1), ("a", "2024-01-24", -1), ("a", "2024-01-30", 5), ("b", "2024-01-26", 1)]
    df = spark.createDataFrame([(t, day(d), x) for t, d, x in rows], "transmitter string, date date, dafm int")
    ranges = lunar.arrive_depart(df)
    assert tuples(ranges) == [("a", day("2024-01-25"), -1, 5), ("b", day("2024-01-25"), 1, 1)]
    s = lunar.arrive_depart_summary(ranges.filter("transmitter = 'b'")).first()
    assert (s.n, s.meanarrive, s.sdarrive, s.semdepart) == (1, 1.0, None, None)


def _brute_gaps(rows):
    out = []
    by_tag = {}
    for r in rows:
        by_tag.setdefault(r[0], []).append(r)
    for tag, rs in by_tag.items():
        rs.sort(key=lambda r: (r[2], r[1]))
        for a, b in zip(rs, rs[1:] + [None]):
            out.append((tag, a[1], a[2], None if b is None else (b[2] - a[2]).total_seconds()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_time_gap_with_ties_and_a_hot_tag(spark, ranges):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        tag = "hot" if i % 3 == 0 else f"t{rng.randrange(40)}"
        rows.append((tag, str(i), f"2024-01-{rng.randrange(1, 4):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.choice(['00', '30.5'])}"))
    det = detections(spark, rows)
    got = tuples(visits.time_gap(det, ranges=ranges), "transmitter", "station", "detection_time_ast", "timediff")
    want = _brute_gaps([(r.transmitter, r.station, r.detection_time_ast) for r in det.collect()])
    assert got == want


def test_no_detections_no_gaps(spark):
    none = detections(spark, [])
    assert visits.time_gap(none).count() == 0
    assert visits.last_before_gap(none).count() == 0


def _brute_last(rows, gap, keep):
    out, by_tag = [], {}
    for r in rows:
        by_tag.setdefault(r[0], []).append(r)
    for tag, rs in by_tag.items():
        rs.sort(key=lambda r: (r[2], r[1]))
        group = 0
        for i, (a, b) in enumerate(zip(rs, rs[1:])):
            if (b[2] - a[2]).total_seconds() > gap:
                group += 1
                out += [(tag, r[1], group) for r in rs[max(0, i - keep + 1): i + 1]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_last_before_gap_clips_and_overlaps(spark, ranges):
    rows = [("a", str(i), t) for i, t in enumerate(
        ["2024-01-01 00:00", "2024-01-20 00:00", "2024-01-20 00:00", "2024-01-20 01:00", "2024-02-20 00:00",
         "2024-02-20 00:00:01", "2024-04-01 00:00"])]
    rng = random.Random(5)
    for i in range(200):
        rows.append(("busy", f"s{i}", f"2024-{rng.choice([1, 3, 4, 9]):02d}-01 {rng.randrange(3):02d}:{rng.randrange(60):02d}"))
    rows.append(("once", "x", "2024-01-01 00:00"))
    det = detections(spark, rows)
    got = tuples(visits.last_before_gap(det, ranges=ranges), "transmitter", "station", "group")
    assert got == _brute_last([(r.transmitter, r.station, r.detection_time_ast) for r in det.collect()], 604_800, 5)


@pytest.fixture
def days(spark):
    return visits.visit_days(
        dates(
            spark,
            six=["2015-01-01", "2015-01-07"],
            seven=["2015-01-01", "2015-01-08", "2015-01-08"],
            eight=["2015-12-30", "2016-01-07", "2016-01-08"],
            one=["2016-05-05"],
            calm=["2016-05-05", "2016-05-06", "2016-05-07"],
        )
    )


def test_trip_counts_break_after_seven_days(spark, days):
    got = dict(tuples(visits.trips_strict(days)))
    assert got == {"six": 1, "seven": 1, "eight": 2, "one": 1, "calm": 1}
    assert tuples(visits.absences(days)) == [("eight", day("2015-12-30"), 8)]


def test_trip_lengths_break_at_seven_days(spark, days):
    got = tuples(visits.trip_lengths(days))
    assert got == [
        ("eight", 2015, 12, 1, 1, 8),
        ("one", None, None, 1, 1, None),
        ("seven", 2015, 1, 1, 1, 7),
    ]


def test_all_trips_add_up_to_the_distinct_dates(spark, days):
    every = visits.trip_lengths(days, include_last=True)
    assert every.agg(F.sum("triplen")).first()[0] == days.count()
    assert ("calm", 2016, 5, 1, 3, None) in tuples(every)


def test_trips_by_year_counts_departures(spark, days):
    got = tuples(visits.trips_by_year(days, days, [2015, 2016]).filter("transmitter in ('eight', 'one')"))
    assert got == [("eight", 2015, 1), ("eight", 2016, 0), ("one", 2015, 0), ("one", 2016, 0)]


def test_absence_limits_fall_in_neither(spark):
    trips = spark.createDataFrame([(x,) for x in (7, 8, 39, 40, 41, None)], "abslen int")
    got = tuples(visits.absence_split(trips))
    assert got == [(39, "within"), (41, "between"), (8, "within")]


def test_attendance_and_returners(spark):
    det = dates(spark, a=["2015-01-31", "2015-02-01", "2015-02-01"], b=["2015-01-01"], c=["2015-12-31", "2016-01-01"])
    seen = visits.attendance(det)
    assert tuples(seen) == [("a", 2, 2, 1), ("b", 1, 1, 1), ("c", 2, 2, 2)]
    r = visits.returners(seen).first()
    assert (r.returndays, r.returnmonths, r.returnyears, r.mean_months, r.sd_months) == (2, 2, 1, 2.0, 0.0)
    tags = spark.createDataFrame([("a",), ("z",)], "transmitter string")
    assert tuples(visits.fish_attendance(tags, seen)) == [("a", 2, 2, 1), ("z", 0, 0, 0)]


def test_individuals_counts_tags_once(spark):
    det = restrict.month_parts(
        spark.createDataFrame(
            [("a", 2015, day("2015-04-01"), 1), ("a", 2015, day("2015-04-01"), 1), ("b", 2015, day("2015-04-01"), 1)],
            "transmitter string, year int, date date, dafm int",
        )
    )
    got = tuples(lunar.individuals_by_dafm(lunar.detections_by_dafm(det)))
    assert got == [(2015, 4, "Apr", 1, 2, 3)]
    assert lunar.individuals_by_dafm(lunar.detections_by_dafm(det), after_year=2015).count() == 0


def test_trips_by_year_sum_to_the_absences(spark):
    days = visits.visit_days(dates(spark, a=["1995-12-20", "1996-01-20", "1997-06-01"], b=["1998-01-01"]))
    got = visits.trips_by_year(days, days)
    assert tuples(got, "transmitter", "year", "trips") == [("a", 1995, 1), ("a", 1996, 1), ("a", 1997, 0), ("b", 1998, 0)]
    assert got.agg({"trips": "sum"}).first()[0] == visits.absences(days).count()
