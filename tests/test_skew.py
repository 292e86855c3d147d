"""A tag, a value and a group that hold a third of all rows, with broadcasting off,
against brute force; and what the plans must not contain."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reefpulse.plans.catalog import QUERIES
from reefpulse.operators import binning, distribution, geometry, joining, lunar, ranks, restrict, visits
from reefpulse.plans import surrogate as s
from tests.conftest import SF_SMALL
from tests.frames import tuples


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    yield spark
    for n in names:
        spark.conf.unset(n)


@pytest.fixture
def hot(no_broadcast):
    det = s.detections_short(no_broadcast, SF_SMALL)
    tag = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("transmitter"))
    return det.withColumn("transmitter", tag)


def test_gaps_of_a_hot_tag(hot):
    rows = sorted((r.transmitter, r.detection_time_ast, r.station, r.event_id) for r in hot.collect())
    want = []
    for a, b in zip(rows, rows[1:] + [("", None, "", 0)]):
        want.append((a[3], (b[1] - a[1]).total_seconds() if a[0] == b[0] else None))
    got = visits.time_gap(hot, ties=("station", "event_id"), ranges=20)
    assert tuples(got, "event_id", "timediff") == sorted(want, key=repr)


def test_bins_of_a_hot_tag(hot):
    det = geometry.project_utm(restrict.add_half_hour(restrict.split_datetime(hot)))
    filled = binning.fill_gaps(binning.bin_positions(det), s.moons(hot))
    per_tag = filled.groupBy("transmitter").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("date", "halfhour").alias("d"),
        F.sum("no_detections").alias("dets"),
        F.expr("(max(unix_date(date) * 48 + halfhour * 2) - min(unix_date(date) * 48 + halfhour * 2)) + 1").alias("span"),
    )
    assert per_tag.filter("n <> d OR n <> span").count() == 0
    assert per_tag.agg(F.sum("dets")).first()[0] == hot.count()


def test_lookups_of_a_hot_tag(hot, no_broadcast):
    dated = lunar.add_dafm(restrict.split_datetime(hot), s.moons(hot))
    assert dated.filter("dafm IS NULL OR dafm < -9 OR dafm > 20").count() == 0
    tags = hot.select("transmitter").distinct().withColumn("release_date", F.lit("2024-01-10").cast("date"))
    assert restrict.trim_tag_day(dated, tags).count() == dated.filter("date > '2024-01-10'").count()
    assert restrict.keep_tags(dated, tags).count() == hot.count()


def test_quantiles_with_a_hot_value_and_a_hot_group(no_broadcast):
    depth = s.depth(no_broadcast, SF_SMALL).withColumn(
        "sensor_value", F.when(F.col("sensor_value") < 20, 12.5).otherwise(F.col("sensor_value"))
    )
    depth = depth.withColumn("g", F.when(F.col("sensor_value") < 60, "hot").otherwise(F.col("fish")))
    probs = (0.1, 0.25, 0.5, 0.75, 0.9)
    got = ranks.exact_quantiles(depth, "sensor_value", probs, ["g"])
    want = depth.groupBy("g").agg(F.percentile("sensor_value", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    by_group = {r.g: r.q for r in want}
    for r in got.collect():
        assert list(r)[1:] == pytest.approx(by_group[r.g])
    whole = ranks.exact_quantiles(depth, "sensor_value", probs).first()
    every = depth.agg(F.percentile("sensor_value", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert list(whole) == pytest.approx(every)


def test_rank_sum_with_a_hot_value(no_broadcast):
    depth = s.depth(no_broadcast, SF_SMALL).withColumn(
        "v", F.when(F.col("sensor_value") < 20, 12.5).otherwise(F.col("sensor_value"))
    )
    rows = depth.select("fish", "v").collect()
    a, b = [r.v for r in rows if r.fish == "even"], [r.v for r in rows if r.fish == "odd"]
    w = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert distribution.rank_sum(depth, "v", "fish", "even").first().w == w


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans(spark, name):
    """No cross joins, no row-at-a-time Python, no unneeded columns of the scans."""
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert ("ArrowEvalPython" in plan) == (name == "test_p_values")
    for column in ("event_type", "o_totalprice", "o_orderstatus", "c_acctbal", "c_name"):
        assert column not in plan


def test_filters_reach_the_scan(spark):
    det = restrict.before_date(s.detections_short(spark, SF_SMALL), dt.date(2024, 1, 5), "detection_time_ast")
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in _plan(det)


def _scans(df, table):
    df.collect()
    plan = _plan(df).split("Initial Plan")[0]
    return sum(f"/{table}.parquet" in line and "Scan parquet" in line for line in plan.splitlines())


def _burst(spark):
    """Half of all rows are one tag's within one second, most of them at one instant."""
    second = F.when(F.col("id") < 20_000, F.lit(1_700_000_000)).otherwise(1_700_000_000 + F.pmod(F.hash("id"), F.lit(60 * 86_400)))
    return spark.range(40_000).select(
        F.when(F.col("id") < 20_000, "burst").otherwise(F.concat(F.lit("t"), (F.col("id") % 100).cast("string"))).alias("transmitter"),
        F.format_string("s%06d", "id").alias("station"), F.timestamp_seconds(second).cast("timestamp_ntz").alias("detection_time_ast"), "id",
    )


def test_a_burst_is_cut_by_rank(no_broadcast):
    det = _burst(no_broadcast)
    laid = visits._in_ranges(det, "detection_time_ast", ("station",), 40)
    assert laid.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 2 * 40_000 / 40
    got = visits.time_gap(det, ranges=40)
    assert got.count() == 40_000
    rows = sorted((r.transmitter, r.detection_time_ast, r.station, r.id) for r in det.collect())
    want = {a[3]: (b[1] - a[1]).total_seconds() if a[0] == b[0] else None for a, b in zip(rows, rows[1:] + [("", None, "", 0)])}
    assert {r.id: r.timediff for r in got.collect()} == want


def test_batches_that_cut_tags_and_gaps(no_broadcast):
    """Rows of a range come in batches of seven."""
    det = _burst(no_broadcast).filter("id % 50 = 0")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = no_broadcast.conf.get(key)
    whole = [tuples(visits.time_gap(det, ranges=3), "id", "timediff"), tuples(visits.last_before_gap(det, gap_seconds=86_400, ranges=3), "id", "group")]
    no_broadcast.conf.set(key, "7")
    try:
        for ranges in (1, 6):
            small = [tuples(visits.time_gap(det, ranges=ranges), "id", "timediff"), tuples(visits.last_before_gap(det, gap_seconds=86_400, ranges=ranges), "id", "group")]
            assert small == whole
    finally:
        no_broadcast.conf.set(key, before)


def test_reads(spark):
    """How often the detections are read."""
    assert _scans(QUERIES["time_gap"](spark, SF_SMALL), "events") == 1
    assert _scans(QUERIES["last_before_gap"](spark, SF_SMALL), "orders") == 1
    assert _scans(QUERIES["membership"](spark, SF_SMALL), "events") == 1
    assert _scans(QUERIES["cut_bins"](spark, SF_SMALL), "events") <= 2


@pytest.mark.parametrize("odd", [[1e9], [-9999.0, 1e300], [float("inf"), float("-inf")], [float("nan"), 1e9]])
def test_outliers_do_not_fill_a_cell(spark, odd):
    plain = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("v"))
    df = plain.unionByName(spark.createDataFrame([(x,) for x in odd], "v double"))
    for by in ([], ["g"]):
        counted = ranks.value_counts(df.withColumn("g", F.lit("a")), "v", by)
        rows, _ = ranks._grid(counted, by, ranks.LEVELS)
        assert rows.groupBy("__b1", "__b2").count().agg(F.max("count")).first()[0] < 200_000 / ranks.CUTS**2 * 8
    probs = (0.001, 0.25, 0.5, 0.75, 0.999)
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert list(ranks.exact_quantiles(df, "v", probs).first()) == pytest.approx(want)
    grouped = ranks.exact_quantiles(df.withColumn("g", F.lit("a")), "v", probs, ["g"])
    assert list(grouped.drop("g").first()) == pytest.approx(want)


def test_a_tail_of_ten_powers_does_not_fill_a_cell(spark):
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    df = spark.range(200_000).select(F.pow(F.lit(10.0), u * 10).alias("v"))
    rows, cells = ranks._grid(ranks.value_counts(df, "v"), [], ranks.LEVELS)
    assert rows.groupBy("__b1", "__b2").count().agg(F.max("count")).first()[0] < 200_000 / ranks.CUTS**2 * 8
    assert cells.agg(F.sum("__m")).first()[0] == 200_000
    ahead = cells.orderBy("__b1", "__b2").collect()
    assert [r["__ahead"] for r in ahead] == [sum(x["__m"] for x in ahead[:k]) for k in range(len(ahead))]
    probs = (0.0, 0.001, 0.25, 0.5, 0.999, 1.0)
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
    for levels in (1, 3):
        got = ranks._counts_at(ranks.value_counts(df, "v"), (0.5,), (), levels).filter("before <= 99999 and before + n > 99999").collect()
        assert len(got) == 1
    assert list(ranks.exact_quantiles(df, "v", probs).first()) == pytest.approx(want)


def test_a_crowded_place_meets_many_rings(no_broadcast):
    """A third of all points at one place: its cell is dealt over salts, and every ring there is met."""
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rings = no_broadcast.createDataFrame([(k, [(x + k * 0.01, y) for x, y in square]) for k in range(20)], "ring_id int, ring array<struct<long: double, lat: double>>")
    at = F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.pmod(F.hash("id"), F.lit(3000)) / 1000.0)
    points = no_broadcast.range(9_000).select("id", at.alias("lon"), F.lit(0.5).alias("lat"))
    got = geometry.points_in_rings(points, "lon", "lat", rings, least=100)
    want = sum(sum(k * 0.01 <= r.lon <= 1.0 + k * 0.01 for k in range(20)) for r in points.collect())
    assert got.count() == want and got.filter("lon = 0.5").count() >= 3_000 * 20


def test_salts_follow_counts(no_broadcast):
    rows = no_broadcast.range(60_000).select(
        F.when(F.col("id") < 50_000, F.pmod("id", F.lit(2)).cast("string")).otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("v")
    )
    hot = joining.hot_groups(rows, ["g"], least=200)
    salts = joining.salted(rows, hot, ["g"], ["v"]).groupBy("g").agg(F.count_distinct("__salt").alias("n"))
    spread = {r.n for r in salts.filter("g IN ('0', '1')").collect()}
    assert min(spread) > 90 and {r.n for r in salts.filter("g NOT IN ('0', '1')").collect()} == {1}
    stats = rows.groupBy("g").agg(F.max("v").alias("most"))
    copies = joining.repeated(stats, hot, ["g"]).groupBy("g").count()
    assert copies.filter("g NOT IN ('0', '1')").agg(F.max("count")).first()[0] == 1
    got = joining.join_group_row(rows, stats, ["g"], "v", least=200)
    assert got.count() == 60_000 and got.filter("v > most").count() == 0
    assert joining.join_group_row(rows.limit(0), stats.limit(0), ["g"], "v").count() == 0


def test_a_narrow_histogram_over_a_wide_range(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 10_000_000_000)], "v double")
    assert tuples(distribution.histogram(df, "v", width=1.0, empty=False), "center", "n") == [(1.0, 2), (10_000_000_000.0, 1), (2.0, 1)]
    near = df.filter("v < 3").unionByName(spark.createDataFrame([(20_000.0,)], "v double"))
    assert distribution.histogram(near, "v", width=1.0).count() == 20_000
