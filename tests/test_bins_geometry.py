from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from reefpulse.functions.geo import edges_of, in_edges, in_ring, in_unrolled, unrolled
from reefpulse.operators import binning, electivity, geometry, restrict, summary
from reefpulse.plans.surrogate import RING
from tests.frames import day, detections, moons, ts, tuples

MOONS = ("2023-12-27", "2024-01-25")


def _occupied(spark, rows):
    det = geometry.project_utm(restrict.add_half_hour(restrict.split_datetime(detections(spark, rows))))
    return binning.bin_positions(det)


def _filled(spark, rows):
    zoned = geometry.zone_of_bin(_occupied(spark, rows), RING)
    return binning.fill_gaps(zoned, moons(spark, *MOONS))


def test_bins_run_from_first_to_last(spark):
    got = _filled(spark, [("a", "1", "2024-01-15 23:30"), ("a", "2", "2024-01-16 00:00"), ("a", "2", "2024-01-16 01:10"), ("b", "1", "2024-01-02 12:00")])
    rows = tuples(got, "transmitter", "date", "halfhour", "no_stations", "no_detections", "dafm", "mssca")
    d15, d16 = day("2024-01-15"), day("2024-01-16")
    assert rows == [
        ("a", d15, 23.5, 1, 1, 19, "out"),
        ("a", d16, 0.0, 1, 1, -9, "out"),
        ("a", d16, 0.5, 0, 0, -9, None),
        ("a", d16, 1.0, 1, 1, -9, "out"),
        ("b", day("2024-01-02"), 12.0, 1, 1, 6, "out"),
    ]


def test_bins_are_contiguous_over_many_days(spark):
    got = _filled(spark, [("a", "1", "2023-12-30 05:10"), ("a", "1", "2024-01-09 17:40")])
    assert got.count() == 10 * 48 + 25 + 1
    assert got.select("date", "halfhour").distinct().count() == got.count()
    assert got.agg(F.sum("no_detections")).first()[0] == 2


def test_counting_presence_equals_filling(spark):
    rows = [("a", "1", f"2024-01-{d:02d} {h:02d}:{m}") for d, h, m in ((1, 0, "00"), (1, 23, "59"), (2, 0, "01"), (9, 12, "30"), (9, 13, "00"))]
    rows += [("b", "1", "2024-01-05 12:00"), ("b", "2", "2024-01-05 12:10")]
    table = moons(spark, *MOONS)
    filled = restrict.flag_presence(binning.fill_gaps(_occupied(spark, rows), table))
    want = tuples(electivity.crosstab(filled, "dafm", "pa", ["A", "P"]), "dafm", "A", "P")
    assert tuples(binning.presence_by_dafm(_occupied(spark, rows), table), "dafm", "A", "P") == want


def test_null_position_and_null_station_in_a_bin(spark):
    got = _occupied(spark, [("a", "1", "2024-01-01 00:00", 17.6, -64.9), ("a", None, "2024-01-01 00:01", None, -64.8)]).first()
    assert (got.no_stations, got.no_detections, got.avg_lat, got.avg_long, got.avg_x) == (2, 2, None, -64.85, None)


@pytest.mark.parametrize(
    "lon, lat, x, y",
    [
        (-64.86, 17.64, 302671.36045, 1951328.12576),
        (-64.88333, 17.63, 300184.51114, 1950245.83189),
        (-64.91, 17.70, 297432.45531, 1958022.01871),
        (-63.0, 0.0, 500000.0, 0.0),
    ],
)
def test_projection(spark, lon, lat, x, y):
    df = spark.createDataFrame([(lon, lat)], "long_nad83 double, lat_nad83 double")
    r = geometry.project_utm(df).first()
    assert r.x_utm20n == pytest.approx(x, abs=2e-5) and r.y_utm20n == pytest.approx(y, abs=2e-5)


POINTS = [
    ((-64.86, 17.69), True),
    ((-64.86, 17.63), False),  # in the notch
    ((-64.86, 17.675), True),  # tip of the notch
    ((-64.88333, 17.65), True),  # on an edge
    ((-64.88333, 17.62), True),  # on a corner
    ((-64.875, 17.62), True),
    ((-64.875, 17.6199), False),
    ((-64.9, 17.65), False),
    ((-64.9, 17.70), False),  # level with the upper edge
    ((-64.8, 17.62), False),
]


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("as_column", [False, True])
def test_ring(spark, as_column, closed):
    ring = RING + RING[:1] if closed else RING
    df = spark.createDataFrame([(*p, want) for p, want in POINTS] + [(None, 17.65, None)], "x double, y double, want boolean")
    arg = ring
    if as_column:
        arg = F.array(*[F.struct(F.lit(x).alias("long"), F.lit(y).alias("lat")) for x, y in ring])
    for r in df.withColumn("got", in_ring(F.col("x"), F.col("y"), arg)).collect():
        assert r.got == r.want, r


def test_year_with_one_zone_only(spark):
    rows = [(2015, "in"), (2015, "in"), (2016, "in"), (2016, "out"), (2016, None)]
    got = tuples(binning.zone_share_by_year(spark.createDataFrame(rows, "year int, mssca string")))
    assert got == [(2015, None, None, None), (2016, 50.0, 50.0, 2)]


def test_zone_share_of_no_bins(spark):
    none = spark.createDataFrame([], "mssca string")
    assert binning.zone_share(none).first().pct_in is None


def test_one_present_bin_makes_a_present_month(spark):
    rows = [("a", day("2024-01-01"), "A"), ("a", day("2024-01-02"), "P"), ("a", day("2024-02-01"), None), ("b", day("2024-01-01"), "A")]
    df = spark.createDataFrame(rows, "transmitter string, date date, pa string")
    assert tuples(binning.presence_by_month(df)) == [("a", 2024, "Feb", "A"), ("a", 2024, "Jan", "P"), ("b", 2024, "Jan", "A")]


def test_one_missing_depth_bin_makes_the_mean_missing(spark):
    cols = [f"direction_{i}" for i in range(1, 10)] + [f"speed_{i}" for i in range(1, 10)]
    rows = [(ts("2024-01-01 00:00"), *([10.0] * 8 + [19.0]), *([1.0] * 9)), (ts("2024-01-01 01:00"), *([90.0] * 9), *([1.0] * 8 + [None]))]
    df = spark.createDataFrame(rows, "ts_local timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))
    got = geometry.current_component(summary.current_means(df)).orderBy("ts_local").collect()
    assert (got[0].direction_1_9, got[0].speed_1_9) == (11.0, 1.0)
    assert (got[1].direction_1_9, got[1].speed_1_9, got[1].direction_1_9_s) == (90.0, None, 1.0)


def test_tide_overlay_keeps_located_bins_of_tide_days(spark):
    bins = spark.createDataFrame(
        [("a", day("2024-01-01"), 5.0, 17.6), ("a", day("2024-01-01"), 5.5, None), ("a", day("2024-01-02"), 1.0, 17.6)],
        "transmitter string, date date, halfhour double, avg_lat double",
    )
    slack = spark.createDataFrame([(day("2024-01-01"), 2.0), (day("2024-01-01"), 14.5)], "date date, halfhour double")
    assert tuples(binning.tide_overlay(bins, slack), "slack_halfhour", "hours_from_slack") == [(14.5, -9.5), (2.0, 3.0)]


def test_chesson_sums_to_one_and_ignores_null_zones(spark):
    stations = spark.createDataFrame([("1", "in", 3), ("2", "out", 1)], "station string, mssca string, years_deployed int")
    bins = spark.createDataFrame([("in",), ("in",), ("in",), ("out",), (None,)], "mssca string")
    got = {r.mssca: r for r in electivity.chesson_zone(bins, stations).collect()}
    assert set(got) == {"in", "out"}
    assert got["in"].chesson_s == pytest.approx(0.5) and got["out"].rdivp == pytest.approx(1.0)
    station_index = electivity.chesson_station(detections(spark, [("a", "1", "2024-01-01 00:00")]), stations)
    assert tuples(station_index, "station", "tot_freq", "chesson_s") == [("1", 1, 1.0), ("2", 0, 0.0)]


def test_chesson_by_dafm_with_an_unseen_cell(spark):
    bins = spark.createDataFrame([(0, "P"), (0, "A"), (1, "A"), (1, "A"), (None, "P")], "dafm int, pa string")
    table = electivity.crosstab(bins, "dafm", "pa", ["A", "P"])
    got = {r.dafm: r for r in electivity.chesson_dafm(table).collect()}
    assert set(got) == {0, 1}
    assert (got[0].chesson_s, got[1].chesson_s) == (1.0, 0.0)
    assert got[0].chesson_s_abs == pytest.approx(1 / 3) and got[0].chesson_p == 0.5
    long = electivity.unpivot_index(electivity.chesson_dafm(table))
    assert long.count() == 6


def test_month_order(spark):
    df = spark.createDataFrame([("Jan", "P"), ("Dec", "A"), ("Dec", "P")], "month string, pa string")
    got = {r.month: (r.month_no, r.A, r.P) for r in electivity.chesson_month(df).collect()}
    assert got == {"Jan": (1, 0, 1), "Dec": (12, 1, 1)}


def test_status_share_with_few_statuses_and_a_missing_one(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "a"), ("3", None), ("4", "a")], "spawning_id string, current_status string")
    got = {r.current_status: (r.freq, r.proptot, r.propknown) for r in summary.status_share(df).collect()}
    assert got == {"a": (2, 50.0, 50.0), "b": (1, 25.0, 25.0), None: (1, 25.0, 25.0)}
    known = {r.current_status: r.propknown for r in summary.status_share(df, ["a"]).collect()}
    assert known == {"a": 100.0, "b": 50.0, None: 50.0}


def _random_rings(n, seed):
    rng = random.Random(seed)
    rings = []
    for k in range(n):
        x, y, r = rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([0.02, 0.3, 0.9, 40.0])
        turns = sorted(rng.uniform(0, 6.283) for _ in range(rng.choice([3, 5, 17])))
        rings.append((k, [(x + r * rng.uniform(0.3, 1) * math.cos(a), y + r * rng.uniform(0.3, 1) * math.sin(a)) for a in turns]))
    rings.append((n, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.5), (0.0, 1.0)]))
    return rings


@pytest.mark.parametrize("cell", [None, 0.05, 7.0])
def test_points_meet_rings_as_one_by_one(spark, cell):
    rings = _random_rings(20, 5)
    rng = random.Random(6)
    pts = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(600)]
    pts += [(1000 + i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.25, 0.75), (0.5, 0.75), (1.0, 1.0), (1.0, 0.3)])]
    pts += [(2000, None, 1.0), (2001, 1.0, None)]
    points = spark.createDataFrame(pts, "i int, lon double, lat double")
    table = spark.createDataFrame([*rings, (98, []), (99, None), rings[0]], "ring_id int, ring array<struct<long: double, lat: double>>")
    got = {(r.i, r.ring_id) for r in geometry.points_in_rings(points, "lon", "lat", table, cell=cell).collect()}
    one = points.select("i", *[in_ring(F.col("lon"), F.col("lat"), r).alias(str(k)) for k, r in rings]).collect()
    want = {(r.i, k) for r in one for k, _ in rings if r[str(k)]}
    assert got == want and len(want) > 300
    assert geometry.points_in_rings(points, "lon", "lat", table.limit(0)).count() == 0
    assert geometry.points_in_rings(points.limit(0), "lon", "lat", table).count() == 0


@pytest.mark.parametrize("edges", [3, 4, 5, 40])
def test_edges_in_generated_code_hold_what_walked_ones_do(spark, edges):
    """Rings of fewer, as many and more edges than are unrolled, at points inside, outside, on edges and on vertices; columns keep their names."""
    ring = [(math.cos(6.283 * k / edges) * (1 + k % 2), math.sin(6.283 * k / edges)) for k in range(edges)]
    pts = [(x / 8, y / 8) for x in range(-17, 18) for y in range(-9, 10)] + ring + [(float("inf"), 0.0), (0.0, float("nan"))]
    points = spark.createDataFrame([(x, y, "w", k) for k, (x, y) in enumerate(pts)], "lon double, lat double, whole string, edges int")
    table = points.withColumn("es", edges_of(F.array(*[F.struct(F.lit(x).alias("long"), F.lit(y).alias("lat")) for x, y in ring])))
    lon, lat = F.col("lon"), F.col("lat")
    both = table.withColumns(unrolled(F.col("es"))).select(in_edges(lon, lat, F.col("es")).alias("a"), in_unrolled(lon, lat, F.col("es")).alias("b"))
    assert both.filter("a IS DISTINCT FROM b").count() == 0 and both.filter("a").count() > 3
    near = points.filter("lon < 3 AND lat < 3")
    rings = spark.createDataFrame([(7, ring)], "ring_id int, ring array<struct<long: double, lat: double>>")
    got = geometry.points_in_rings(near, "lon", "lat", rings)
    assert got.columns == [*points.columns, "ring_id"]
    assert sorted(got.select("edges").collect()) == sorted(near.filter(in_ring(lon, lat, ring)).select("edges").collect())


def test_slack_across_midnight(spark):
    bins = spark.createDataFrame(
        [("a", day("2024-01-02"), 0.5, 17.6), ("a", day("2024-01-02"), 12.0, 17.6), ("b", day("2024-01-09"), 3.0, 17.6), ("b", day("2024-01-01"), 0.0, 17.6), ("c", day("2024-01-02"), 1.0, None)],
        "transmitter string, date date, halfhour double, avg_lat double",
    )
    slack = spark.createDataFrame([(day("2024-01-01"), 23.5), (day("2024-01-02"), 5.0), (day("2024-01-02"), 19.0), (day("2024-01-12"), 1.0)], "date date, halfhour double")
    got = tuples(binning.tide_nearest(bins, slack), "transmitter", "date", "slack_date", "slack_halfhour", "hours_from_slack")
    assert got == [
        ("a", day("2024-01-02"), day("2024-01-01"), 23.5, 1.0),
        ("a", day("2024-01-02"), day("2024-01-02"), 5.0, 7.0),
        ("b", day("2024-01-01"), day("2024-01-01"), 23.5, -23.5),
        ("b", day("2024-01-09"), day("2024-01-12"), 1.0, -70.0),
    ]
    none = binning.tide_nearest(bins, slack.limit(0)).select("slack_date", "hours_from_slack").distinct().collect()
    assert [tuple(r) for r in none] == [(None, None)]


def test_a_gap_of_a_century_is_spread(spark):
    bins = _occupied(spark, [("a", "1", "1924-01-01 00:00"), ("a", "1", "2024-01-01 00:00"), ("b", "1", "2024-01-01 00:00"), ("b", "1", "2024-01-01 02:00")])
    filled = binning.fill_gaps(bins, moons(spark, *MOONS))
    per_tag = {r.transmitter: (r.n, r.d) for r in filled.groupBy("transmitter").agg(F.count(F.lit(1)).alias("n"), F.sum("no_detections").alias("d")).collect()}
    assert per_tag == {"a": (36525 * 48 + 1, 2), "b": (5, 2)}
    most = filled.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 36525 * 48 * 0.4


def test_days_stand_for_the_half_hours_they_become(spark):
    """A gap is a row a day until its half-hours are made, in order and by the task that holds the day."""
    bins = _occupied(spark, [("a", "1", "2023-12-30 05:10"), ("a", "1", "2024-01-09 17:40"), ("a", "1", "2024-01-09 18:10"), ("b", "1", "2024-01-02 23:50")])
    days = binning.gap_days(bins, moons(spark, *MOONS))
    assert days.count() == 11 + 1 + 1 + 1
    assert days.agg(F.sum(binning.half_hours())).first()[0] == 10 * 48 + 26 + 1 + 1
    filled = binning.fill_days(days.coalesce(1).sortWithinPartitions("transmitter", "__from"))
    rows = [(r.transmitter, r.date, r.halfhour) for r in filled.collect()]
    assert rows == sorted(rows) and len(set(rows)) == 10 * 48 + 28
    assert tuples(filled) == tuples(binning.fill_gaps(bins, moons(spark, *MOONS)))
    assert "Exchange" not in binning.fill_days(spark.createDataFrame([], days.schema))._jdf.queryExecution().executedPlan().toString()


def test_a_bins_own_dafm_stays_and_empty_ones_have_their_dates(spark):
    bins = _occupied(spark, [("a", "1", "2024-01-15 23:30"), ("a", "2", "2024-01-16 00:40")]).withColumn("dafm", F.lit(77))
    got = tuples(binning.fill_gaps(bins, moons(spark, *MOONS)), "halfhour", "no_detections", "dafm")
    assert got == [(0.0, 0, -9), (0.5, 1, 77), (23.5, 1, 77)]
