"""Half-hour bins per tag, gap-free from first to last detection.

Operators that look at located bins only (shares, positions, zones) give the same
result on filled and on occupied bins; feed them the occupied ones and the fill
is never computed. ``presence_by_dafm`` counts the empty half-hours of a gap per
day instead of making them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reefpulse.functions.clock import SLOTS_PER_DAY, slot_half_hour, slot_of
from reefpulse.functions.nulls import distinct_with_null, share, strict_avg
from reefpulse.operators.asof import around, nearest
from reefpulse.operators.lunar import EARLY_DAYS, add_dafm

POSITIONS = ("avg_lat", "avg_long", "avg_x", "avg_y")


def bin_positions(det: DataFrame) -> DataFrame:
    """One row per occupied half-hour of a tag.

    DAFM is carried along if the detections have it; it depends on the date
    only, so ``fill_gaps`` can also add it later, to far fewer rows. Means are null if any position of the bin is; a null station counts as one
    more station. Rounding is half-up on the decimal digits.
    """
    dafm = [F.min("dafm").alias("dafm")] if "dafm" in det.columns else []
    return det.groupBy("transmitter", "year", "date", "halfhour").agg(
        distinct_with_null("station").alias("no_stations"),
        F.count(F.lit(1)).alias("no_detections"),
        *dafm,
        F.round(strict_avg("lat_nad83"), 5).alias("avg_lat"),
        F.round(strict_avg("long_nad83"), 5).alias("avg_long"),
        F.round(strict_avg("x_utm20n"), 2).alias("avg_x"),
        F.round(strict_avg("y_utm20n"), 2).alias("avg_y"),
    )


# Half-hours of a gap that one task makes from a row.
FILL_BLOCK = 4096


def _blocks(spread: DataFrame) -> DataFrame:
    """Adds the half-hours ``__from`` to ``__until`` that a row stands for, from ``__slot`` to ``__to``.

    Gaps of more than a block are cut in blocks that are dealt over all tasks before
    they are expanded, so that years without a detection are not made by one.
    """
    long_gap = F.col("__to") - F.col("__slot") >= FILL_BLOCK
    short = spread.filter(~long_gap).withColumns({"__from": F.col("__slot"), "__until": F.col("__to")})
    block = F.explode(F.sequence(F.floor(F.col("__slot") / FILL_BLOCK), F.floor(F.col("__to") / FILL_BLOCK)))
    tasks = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = spread.filter(long_gap).withColumn("__block", block).repartition(tasks, "transmitter", "__block")
    first = F.greatest(F.col("__slot"), F.col("__block") * FILL_BLOCK)
    last = F.least(F.col("__to"), F.col("__block") * FILL_BLOCK + FILL_BLOCK - 1)
    return short.unionByName(blocks.withColumns({"__from": first, "__until": last}).drop("__block"))


def gap_days(bins: DataFrame, moons: DataFrame, early_days: int = EARLY_DAYS, *, deal: bool = False) -> DataFrame:
    """The first half of ``fill_gaps``: a row for each bin and each further day up to the tag's next one.

    A row stands for the half-hours ``__from`` to ``__until`` of its date, ``half_hours`` of them, the first of which is
    the bin if ``__kept``. ``fill_days`` makes them; what has to be shuffled or counted is so before that, as these rows are
    far fewer. DAFM is looked up here, once a row. With ``deal``, long gaps are spread over all tasks.
    """
    per_tag = Window.partitionBy("transmitter").orderBy("__slot")
    spread = (
        bins.withColumn("__slot", slot_of("date", "halfhour"))
        .withColumn("__to", F.coalesce(F.lead("__slot").over(per_tag) - 1, F.col("__slot")))
    )
    slots, day = F.lit(SLOTS_PER_DAY), F.col("__day")
    whole = spread.withColumns({"__from": F.col("__slot"), "__until": F.col("__to")})
    days = (_blocks(spread) if deal else whole).withColumn(
        "__day", F.explode(F.sequence(F.floor(F.col("__from") / slots), F.floor(F.col("__until") / slots)))
    )
    first = F.greatest(F.col("__from"), day * slots)
    kept = first == F.col("__slot")
    zero = F.lit(0).cast("long")
    has_dafm = "dafm" in bins.columns
    carried = [c for c in (*POSITIONS, "mssca") if c in bins.columns]
    pieces = days.select(
        "transmitter",
        F.date_from_unix_date(day.cast("int")).alias("date"),
        first.alias("__from"),
        F.least(F.col("__until"), day * slots + slots - 1).alias("__until"),
        kept.alias("__kept"),
        F.when(kept, F.col("no_stations")).otherwise(zero).alias("no_stations"),
        F.when(kept, F.col("no_detections")).otherwise(zero).alias("no_detections"),
        *([F.when(kept, F.col("dafm")).alias("__dafm")] if has_dafm else []),
        *[F.when(kept, F.col(c)).alias(c) for c in carried],
    )
    return add_dafm(pieces, moons, early_days=early_days)


def half_hours() -> Column:
    """The half-hours that a row of ``gap_days`` stands for."""
    return F.col("__until") - F.col("__from") + 1


def fill_days(days: DataFrame) -> DataFrame:
    """The second half of ``fill_gaps``: the half-hours that the rows of ``gap_days`` stand for, in their order and
    within their tasks."""
    kept = F.col("__kept") & (F.col("__at") == F.col("__from"))
    zero = F.lit(0).cast("long")
    dafm = F.col("dafm")
    if "__dafm" in days.columns:
        dafm = F.when(kept, F.col("__dafm")).otherwise(dafm)
    return days.withColumn("__at", F.explode(F.sequence("__from", "__until"))).select(
        "transmitter",
        F.year("date").alias("year"),
        "date",
        slot_half_hour("__at").alias("halfhour"),
        F.when(kept, F.col("no_stations")).otherwise(zero).alias("no_stations"),
        F.when(kept, F.col("no_detections")).otherwise(zero).alias("no_detections"),
        dafm.alias("dafm"),
        *[F.when(kept, F.col(c)).alias(c) for c in (*POSITIONS, "mssca") if c in days.columns],
    )


def fill_gaps(bins: DataFrame, moons: DataFrame, early_days: int = EARLY_DAYS) -> DataFrame:
    """Adds the empty half-hours between a tag's first and last bin.

    Every bin is expanded up to the tag's next one, by days and then by half-hours, so the result is contiguous
    without a join against a spine. The only shuffles are by tag, on at most 48
    rows per tag and day, and of the blocks of long gaps. Empty bins have zero counts, no position, and the DAFM
    of their date.
    """
    return fill_days(gap_days(bins, moons, early_days, deal=True))


def presence_by_day(bins: DataFrame) -> DataFrame:
    """Occupied (P) and empty (A) half-hours per date over all tags.

    Equals counting the filled bins, but a gap makes one row per day it touches
    rather than one per half-hour.
    """
    per_tag = Window.partitionBy("transmitter").orderBy("__slot")
    slots = F.lit(SLOTS_PER_DAY)
    spread = (
        bins.select("transmitter", slot_of("date", "halfhour").alias("__slot"))
        .withColumn("__to", F.coalesce(F.lead("__slot").over(per_tag) - 1, F.col("__slot")))
        .withColumn(
            "__day",
            F.explode(F.sequence(F.floor(F.col("__slot") / slots), F.floor(F.col("__to") / slots))),
        )
    )
    first = F.greatest(F.col("__slot") + 1, F.col("__day") * slots)
    last = F.least(F.col("__to"), F.col("__day") * slots + slots - 1)
    return spread.groupBy(F.date_from_unix_date(F.col("__day").cast("int")).alias("date")).agg(
        F.sum(F.greatest(last - first + 1, F.lit(0).cast("long"))).alias("A"),
        F.count_if(F.floor(F.col("__slot") / slots) == F.col("__day")).alias("P"),
    )


def presence_by_dafm(bins: DataFrame, moons: DataFrame, early_days: int = EARLY_DAYS) -> DataFrame:
    """Occupied and empty half-hours per DAFM: the cross table of the filled bins.

    DAFM is looked up once per calendar date.
    """
    days = add_dafm(presence_by_day(bins), moons, early_days=early_days)
    return (
        days.filter(F.col("dafm").isNotNull()).groupBy("dafm").agg(F.sum("A").alias("A"), F.sum("P").alias("P"))
    )


def zone_share(bins: DataFrame) -> DataFrame:
    """Percent of complete bins inside the closed area. Complete means without a null
    in any column given: pass only the columns that should count."""
    whole = bins.dropna("any")
    return whole.agg((share(F.count_if(F.col("mssca") == "in"), F.count(F.lit(1))) * 100).alias("pct_in"))


def zone_share_by_year(bins: DataFrame) -> DataFrame:
    """In and out percent per year; a year without one of them has null sums."""
    cells = [F.nullif(F.count_if(F.col("mssca") == z), F.lit(0)).alias(z) for z in ("in", "out")]
    counts = bins.dropna("any").groupBy("year").agg(*cells)
    total = F.col("in") + F.col("out")
    return counts.select(
        "year",
        (share(F.col("in"), total) * 100).alias("in"),
        (share(F.col("out"), total) * 100).alias("out"),
        total.alias("sum"),
    )


def position_by(bins: DataFrame, *keys: str) -> DataFrame:
    """Mean position, row count and standard error of longitude of located bins."""
    n = F.count("avg_long")
    return (
        bins.filter(F.col("avg_lat").isNotNull())
        .groupBy(*keys)
        .agg(
            F.avg("avg_lat").alias("avglat"),
            F.avg("avg_long").alias("avglong"),
            n.alias("n"),
            (F.stddev_samp("avg_long") / F.sqrt(n)).alias("se"),
        )
    )


def detections_by_halfhour_zone(bins: DataFrame) -> DataFrame:
    return (
        bins.filter(F.col("mssca").isNotNull())
        .groupBy("halfhour", "mssca")
        .agg(F.sum("no_detections").alias("tot_freq"))
    )


def presence_by_month(bins: DataFrame) -> DataFrame:
    """'P' for a tag's month with any present bin, else 'A'."""
    present = F.bool_or(F.coalesce(F.col("pa") == "P", F.lit(False)))
    return bins.groupBy(
        "transmitter", F.year("date").alias("year"), F.date_format("date", "MMM").alias("month")
    ).agg(F.when(present, "P").otherwise("A").alias("pa"))


def tide_overlay(bins: DataFrame, slack: DataFrame) -> DataFrame:
    """Located bins of a day beside that day's slack tides, with the hours since slack."""
    tides = slack.select("date", F.col("halfhour").alias("slack_halfhour"))
    return (
        bins.filter(F.col("avg_lat").isNotNull())
        .join(tides, "date")
        .withColumn("hours_from_slack", F.col("halfhour") - F.col("slack_halfhour"))
    )


def tide_nearest(bins: DataFrame, slack: DataFrame) -> DataFrame:
    """Located bins with the slack tide nearest in time, of whatever day, and the hours since it.

    ``slack`` has date and halfhour, any number of rows; hours are negative ahead of a slack.
    """
    def hours(c: str) -> Column:
        return F.unix_date("date") * 24.0 + F.col(c)

    located = bins.filter(F.col("avg_lat").isNotNull()).withColumn("__hours", hours("halfhour"))
    tides = slack.select(hours("halfhour").alias("__slack"))
    beside = around(located, tides, "__hours", "__slack", width=24.0).withColumn("__near", nearest(F.col("__hours")))
    day = F.floor(F.col("__near") / 24.0)
    return beside.select(
        *bins.columns,
        F.date_from_unix_date(day.cast("int")).alias("slack_date"),
        (F.col("__near") - day * 24.0).alias("slack_halfhour"),
        (F.col("__hours") - F.col("__near")).alias("hours_from_slack"),
    )
