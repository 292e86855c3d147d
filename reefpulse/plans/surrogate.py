"""The study's inputs as views over the given tables.

Every view grows with the tables it reads; see FIXTURES.md for what stands in
for what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reefpulse.functions.clock import micros
from reefpulse.operators import binning, geometry, lunar, restrict
from reefpulse.sources.readers import parse_moons

# Closed-area outline (long, lat), with a notch in its southern edge.
RING = [
    (-64.88333, 17.62),
    (-64.87, 17.62),
    (-64.86, 17.675),
    (-64.85, 17.62),
    (-64.84167, 17.62),
    (-64.84167, 17.70),
    (-64.88333, 17.70),
]

# One full moon (UTC) and the synodic month in seconds.
MOON_EPOCH = "2023-12-27 00:33:00"
MOON_EPOCH_SECONDS = 1_703_637_180
SYNODIC_SECONDS = 2_551_443

# Fixed value: depth bins of the profiler, half the length of a vector.
DEPTH_BINS = 32

# Release sites of the analysed tags.
ANALYSED_SITES = ("AUTOMOBILE", "BUILDING", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _detections(rows: DataFrame) -> DataFrame:
    """Every 16th detection is heard at another array, at a station named after X."""
    k = F.col("k").cast("int")
    away = F.when(F.pmod("event_id", F.lit(16)) == 0, "X").otherwise("")
    return rows.select(
        F.col("tag").cast("string").alias("transmitter"),
        F.concat(away, k.cast("string")).alias("station"),
        F.col("t").cast("timestamp_ntz").alias("detection_time_ast"),
        (F.lit(17.6) + F.lit(0.001) * k).alias("lat_nad83"),
        (F.lit(-64.92) + F.lit(0.001) * k).alias("long_nad83"),
        "event_id",
    )


def detections_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of frequent detections, from ``events``."""
    events = table(spark, sf_dir, "events")
    return _detections(
        events.select(
            F.col("user_id").alias("tag"), F.get_json_object("props", "$.k").alias("k"), F.col("ts").alias("t"), "event_id"
        )
    )


def detections_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of sparse detections, from ``orders``."""
    orders = table(spark, sf_dir, "orders")
    return _detections(
        orders.select(
            F.col("o_custkey").alias("tag"),
            F.pmod("o_orderkey", F.lit(100)).alias("k"),
            F.col("o_orderdate").alias("t"),
            F.col("o_orderkey").alias("event_id"),
        )
    )


def station_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as listed stations, and one station no tag ever visits."""
    s = table(spark, sf_dir, "supplier")
    silent = spark.range(566, 567).select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("station"), F.lit("out").alias("mssca"), F.lit(1).alias("years_deployed")
    )
    listed = s.select(
        F.col("s_suppkey").cast("string").alias("station"),
        F.when(F.col("s_nationkey") % 2 == 0, "in").otherwise("out").alias("mssca"),
        (F.lit(1) + F.pmod("s_suppkey", F.lit(3))).cast("int").alias("years_deployed"),
    )
    return listed.unionByName(silent)


def transmitter_master(spark: SparkSession, sf_dir: str, epoch: str = "2024-01-01", spread: int = 10) -> DataFrame:
    """Customers as tagged fish, released within ``spread`` days of ``epoch``."""
    key = F.col("c_custkey")
    day = F.date_add(F.lit(epoch).cast("date"), F.pmod(key, F.lit(spread)).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("transmitter"),
        F.lit("tagged").alias("species"),
        F.col("c_mktsegment").alias("release_site"),
        F.year(day).alias("release_year"),
        day.alias("release_date"),
        F.when(F.pmod(key, F.lit(17)) != 0, F.lit(40.0) + F.pmod(key, F.lit(350)) / 10.0).alias("tl"),
        F.element_at(F.array(F.lit("F"), F.lit("M"), F.lit("U")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("sex"),
        F.when(F.pmod(key, F.lit(12)) == 0, "pressure").otherwise("plain").alias("tag_model"),
    )


def analysed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = transmitter_master(spark, sf_dir)
    return restrict.keep_dimension(tags, "tagged", ANALYSED_SITES).select("transmitter")


def moon_rows(det: DataFrame, ts: str = "detection_time_ast") -> DataFrame:
    """Moon-table text rows covering the detections, one lunation spare on each side."""
    ends = det.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    n = ends.select(
        F.explode(
            F.sequence(
                F.floor((micros("lo") / 1_000_000 - MOON_EPOCH_SECONDS) / SYNODIC_SECONDS) - 1,
                F.floor((micros("hi") / 1_000_000 - MOON_EPOCH_SECONDS) / SYNODIC_SECONDS) + 2,
            )
        ).alias("n")
    )
    utc = F.expr(f"timestamp_ntz'{MOON_EPOCH}' + make_dt_interval(0, 0, 0, n * {SYNODIC_SECONDS})")
    return n.withColumn("utc", utc).select(
        F.date_format("utc", "MMM").alias("month"),
        F.dayofmonth("utc").alias("day"),
        F.year("utc").alias("year"),
        F.date_format("utc", "HH:mm:ss").alias("time_utc"),
    )


def moons(det: DataFrame) -> DataFrame:
    return parse_moons(moon_rows(det))


def dated(det: DataFrame) -> DataFrame:
    """Detections with split date, half-hour free, and DAFM."""
    return lunar.add_dafm(restrict.split_datetime(det), moons(det))


def dated_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(detections_short(spark, sf_dir))


def dated_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(detections_long(spark, sf_dir))


def occupied_bins(det: DataFrame) -> DataFrame:
    return binning.bin_positions(geometry.project_utm(restrict.add_half_hour(det)))


def located_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied bins with their zone: what all questions about positions need."""
    det = restrict.split_datetime(detections_short(spark, sf_dir))
    return geometry.zone_of_bin(occupied_bins(det), RING)


def gap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins and the days up to the tag's next one, of which ``binning.fill_days`` makes gap-free half-hours.

    DAFM is added to these, not to the detections: it is the same per date.
    """
    return binning.gap_days(located_bins(spark, sf_dir), moons(detections_short(spark, sf_dir)))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free half-hour bins with zone and presence flag."""
    filled = binning.fill_gaps(located_bins(spark, sf_dir), moons(detections_short(spark, sf_dir)))
    return restrict.flag_presence(filled)


def closed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One area per nation: the outline moved and scaled by nation and region, so that areas overlap."""
    x0, y0 = RING[0]
    move, scale = F.lit(0.004) * F.col("n_nationkey"), (F.col("n_regionkey") + 1) / F.lit(2.0)
    vertices = [
        F.struct((F.lit(-64.92) + move + F.lit(x - x0) * scale).alias("long"), (F.lit(17.6) + move + F.lit(y - y0) * scale).alias("lat"))
        for x, y in RING
    ]
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), F.array(*vertices).alias("outline"))


def presence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hours present and absent per DAFM."""
    det = detections_short(spark, sf_dir)
    return binning.presence_by_dafm(occupied_bins(restrict.split_datetime(det)), moons(det))


def month_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per tag and month from its first to its last order ('A'), and one per
    order ('P')."""
    det = restrict.split_datetime(detections_long(spark, sf_dir)).select("transmitter", "date")
    present = det.withColumn("pa", F.lit("P"))
    spans = det.groupBy("transmitter").agg(
        F.trunc(F.min("date"), "month").alias("lo"), F.trunc(F.max("date"), "month").alias("hi")
    )
    months = spans.select(
        "transmitter", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("date"), F.lit("A").alias("pa")
    )
    return months.unionByName(present)


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth readings from ``events``, two fish groups by parity of the tag."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").cast("string").alias("transmitter"),
        F.col("ts").alias("detection_time_ast"),
        F.col("value").alias("sensor_value"),
        (F.lit(-64.92) + F.lit(0.001) * F.get_json_object("props", "$.k").cast("int")).alias("long_nad83"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "even").otherwise("odd").alias("fish"),
    )


def categorized_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restrict.categorize_depth(restrict.add_half_hour(depth(spark, sf_dir)))


def currents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly profiler rows from ``embeddings``: half of a vector is directions, half speeds."""
    e = table(spark, sf_dir, "embeddings")
    bins = range(1, DEPTH_BINS + 1)

    def at(i: int):
        return F.element_at("embedding", i).cast("double")

    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(vec_id AS int), 0, 0)")
    return e.select(
        start.alias("ts_local"),
        *[(F.lit(180.0) * (F.lit(1.0) + at(i))).alias(f"direction_{i}") for i in bins],
        *[F.abs(at(DEPTH_BINS + i)).alias(f"speed_{i}") for i in bins],
    )


def slack_tides(bins: DataFrame) -> DataFrame:
    """One slack time per day that has bins."""
    return bins.select("date").distinct().withColumn("halfhour", F.pmod(F.lit(1.5) * F.dayofmonth("date"), F.lit(24.0)))


def population_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("spawning_id"), F.col("o_orderpriority").alias("current_status")
    )
