"""Gaps between detections, trips, absences and attendance.

Per-row work on a tag goes by rank: detections are dealt in ranges of (tag, time), cut at
sampled ranks, so neither a hot tag, a hot month nor a burst within a second is one task's work;
only the ends of ranges are ordered per tag. Day-level work starts from distinct
(tag, date), at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from reefpulse.functions.clock import MICROS, micros
from reefpulse.functions.nulls import sem
from reefpulse.operators.ranks import exact_quantiles

WEEK_SECONDS = 604_800


def _in_ranges(det: DataFrame, ts: str, ties: Sequence[str], ranges: int | None) -> DataFrame:
    """The rows with ``__us`` (microseconds) in ranges of (tag, time, ties), ordered within each.

    The number of ranges is fixed, so that every reader of this one exchange sees the same ranges.
    """
    ranges = ranges or int(det.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("transmitter", "__us", *ties)
    return det.withColumn("__us", micros(ts)).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)


def _same_as_next(tags: pa.Array, following: pa.Array | None) -> np.ndarray:
    """Whether each row has the tag of the row after it; ``following`` holds the one after the last."""
    if following is not None:
        tags = pa.concat_arrays([tags, following])
    codes = pc.fill_null(tags.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    same = codes[1:] == codes[:-1]
    return same if following is not None else np.append(same, False)


def _numbered(same: np.ndarray, carried: int) -> np.ndarray:
    """The place of each row within its tag; ``carried`` rows of the first tag came before."""
    start = np.append(True, ~same[:-1])
    at = np.arange(len(same))
    first = np.maximum.accumulate(np.where(start, at, 0))
    return at - first + 1 + np.where(first == 0, carried, 0)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None, np.ndarray, np.ndarray]]:
    """Each batch of an ordered range, the one after it, and per row whether the next has its
    tag and its place within the tag."""
    carried, held = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            same = _same_as_next(held.column("transmitter"), batch.column("transmitter").slice(0, 1))
            place = _numbered(same, carried)
            yield held, batch, same, place
            carried = int(place[-1]) if same[-1] else 0
        held = batch
    if held is not None:
        same = _same_as_next(held.column("transmitter"), None)
        yield held, None, same, _numbered(same, carried)


def _next_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds __range, __row (from 1 in a tag and range), __last of them, and __next, the next row's time."""
    of = TaskContext.get().partitionId()
    for batch, after, same, place in _walk(batches):
        us = batch.column("__us")
        following = after.column("__us").slice(0, 1) if after is not None else pa.nulls(1, us.type)
        then = pc.if_else(pa.array(same), pa.concat_arrays([us.slice(1), following]), pa.nulls(len(us), us.type))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(us), of, np.int32)), pa.array(place), pa.array(~same), then],
            [*batch.schema.names, "__range", "__row", "__last", "__next"],
        )


def time_gap(
    det: DataFrame, ts: str = "detection_time_ast", ties: Sequence[str] = ("station",), ranges: int | None = None
) -> DataFrame:
    """Adds ``timediff``: seconds to the tag's next detection, null on its last.

    Within a range the next row follows; the last row of a tag in a range finds the first of the
    tag's next range among the ends of ranges, at most two rows a tag and range. One shuffle carries
    the rows; the Arrow pass over it is cheaper than a second one by tag and range.
    """
    laid = _in_ranges(det, ts, ties, ranges)
    added = StructType.fromDDL("__range int, __row long, __last boolean, __next long")
    led = laid.mapInArrow(_next_in_range, StructType([*laid.schema.fields, *added.fields]))
    per_tag = Window.partitionBy("transmitter").orderBy("__range", "__row")
    ends = led.filter("__last OR __row = 1").withColumn("__next", F.lead("__us").over(per_tag)).filter("__last")
    both = led.filter("NOT __last").unionByName(ends)
    return both.select(*det.columns, ((F.col("__next") - F.col("__us")) / F.lit(float(MICROS))).alias("timediff"))


def _near_gaps(gap: int, keep: int):
    """The rows of a range that may be among the ``keep`` ahead of a gap, and the first of each tag."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = TaskContext.get().partitionId()
        # Rows that are not settled yet: whether one stays depends on the next keep - 1 rows.
        held: list[pa.Table] = []

        def settle(table: pa.Table, final: bool) -> tuple[pa.Table, pa.Table]:
            n = len(table)
            ready = n if final else max(n - keep, 0)
            stop = table.column("__stop").to_numpy()
            tag_end = table.column("__last").to_numpy()
            # A stop counts for the rows of its own tag alone.
            tag = np.cumsum(np.append(0, tag_end[:-1]))
            stays = table.column("__row").to_numpy() == 1
            for ahead in range(min(keep, n)):
                m = n - ahead
                stays[:m] |= stop[ahead:] & (tag[:m] == tag[ahead:])
            settled = table.slice(0, ready)
            return settled.filter(pa.array(stays[:ready])), table.slice(ready)

        for batch, after, same, place in _walk(batches):
            us = batch.column("__us")
            following = after.column("__us").slice(0, 1) if after is not None else pa.nulls(1, us.type)
            then = pa.concat_arrays([us.slice(1), following])
            far = pc.fill_null(pc.greater(pc.subtract(then, us), gap), False).to_numpy(zero_copy_only=False) & same
            rows = pa.Table.from_batches([pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(us), of, np.int32)), pa.array(place), pa.array(~same), pa.array(far), pa.array(far | ~same)],
                [*batch.schema.names, "__range", "__row", "__last", "__far", "__stop"],
            )])
            done, rest = settle(pa.concat_tables([*held, rows]), after is None)
            held = [rest]
            yield from done.drop_columns(["__stop"]).to_batches()

    return run


def last_before_gap(
    det: DataFrame, gap_seconds: int = WEEK_SECONDS, keep: int = 5, ts: str = "detection_time_ast", ties: Sequence[str] = ("station",),
    ranges: int | None = None,
) -> DataFrame:
    """The last ``keep`` detections ahead of every gap longer than ``gap_seconds``,
    with the gap's number within the tag as ``group``.

    A range leaves only the rows that may be among them: those ahead of its own gaps and of the
    end of each tag in it. What is left is ordered per tag; there the ends of ranges meet, and
    each row's place in the tag follows from the sizes of the ranges before it.
    """
    gap = gap_seconds * MICROS
    laid = _in_ranges(det, ts, ties, ranges)
    added = StructType.fromDDL("__range int, __row long, __last boolean, __far boolean")
    near = laid.mapInArrow(_near_gaps(gap, keep), StructType([*laid.schema.fields, *added.fields]))
    per_tag = Window.partitionBy("transmitter").orderBy("__range", "__row")
    before = per_tag.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.when(F.col("__last"), F.col("__row"))).over(before), F.lit(0).cast("long"))
    over_edge = F.col("__last") & (F.lead("__us").over(per_tag) - F.col("__us") > gap)
    placed = near.withColumns({"__place": ahead + F.col("__row"), "__gap": F.col("__far") | F.coalesce(over_edge, F.lit(False))})
    placed = placed.withColumn("__group", F.count_if("__gap").over(per_tag.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.collect_list(F.when(F.col("__gap"), F.struct(F.col("__group").alias("group"), F.col("__place").alias("end"))))
    placed = placed.withColumn("__ends", ends.over(per_tag.rowsBetween(0, keep - 1)))
    mine = F.filter("__ends", lambda g: F.col("__place") > g["end"] - keep)
    return placed.withColumn("__g", F.explode(mine)).select(*det.columns, F.col("__g.group").alias("group"))


def visit_days(det: DataFrame) -> DataFrame:
    """Distinct (tag, date) with the days to the tag's next date as ``gap``."""
    per_tag = Window.partitionBy("transmitter").orderBy("date")
    return (
        det.select("transmitter", "date")
        .filter(F.col("date").isNotNull())
        .distinct()
        .withColumn("gap", F.datediff(F.lead("date").over(per_tag), F.col("date")))
    )


def trips_strict(days: DataFrame, gap_days: int = 7) -> DataFrame:
    """Trips per tag: one more than its gaps longer than ``gap_days``."""
    return days.groupBy("transmitter").agg((F.count_if(F.col("gap") > gap_days) + 1).alias("trips"))


def absences(days: DataFrame, gap_days: int = 7) -> DataFrame:
    """One row per gap longer than ``gap_days``, with its last date and length."""
    return days.filter(F.col("gap") > gap_days).select(
        "transmitter", F.col("date").alias("last_date"), F.col("gap").alias("absdays")
    )


def trips_by_year(days: DataFrame, tags: DataFrame, years: Sequence[int] | None = None, gap_days: int = 7) -> DataFrame:
    """Departures per tag and year, zero-filled over the years in which each tag was
    detected, or over ``tags`` x ``years`` if those are listed.

    The year is that of the last date ahead of the gap, so a tag's last trip is
    not counted.
    """
    gone = (
        absences(days, gap_days)
        .groupBy("transmitter", F.year("last_date").alias("year"))
        .agg(F.count(F.lit(1)).alias("trips"))
    )
    if years is None:
        grid = days.join(tags.select("transmitter").distinct(), "transmitter", "left_semi")
        grid = grid.select("transmitter", F.year("date").alias("year")).distinct()
    else:
        listed = F.array(*[F.lit(int(y)) for y in years])
        grid = tags.select("transmitter").distinct().withColumn("year", F.explode(listed))
    return grid.join(gone, ["transmitter", "year"], "left").withColumn(
        "trips", F.coalesce("trips", F.lit(0).cast("long"))
    )


def trip_lengths(days: DataFrame, gap_days: int = 7, include_last: bool = False) -> DataFrame:
    """Trips broken by gaps of ``gap_days`` or more.

    ``triplen`` counts detected dates; year and monthnum are those of the trip's
    last date; ``abslen`` is the absence after it. By default the last trip of a
    tag with several dates is not reported, and a tag with one date is reported
    without year, month and absence. ``include_last`` reports every trip in full.
    """
    per_tag = Window.partitionBy("transmitter").orderBy("date")
    breaks_before = F.sum(F.when(F.col("gap") >= gap_days, 1).otherwise(0)).over(
        per_tag.rowsBetween(Window.unboundedPreceding, -1)
    )
    trips = (
        days.withColumn("tripnum", F.coalesce(breaks_before, F.lit(0)) + 1)
        .groupBy("transmitter", "tripnum")
        .agg(
            F.count(F.lit(1)).alias("triplen"),
            F.max("date").alias("__last"),
            F.max_by("gap", "date").alias("abslen"),
        )
    )
    out = trips.select(
        "transmitter",
        F.year("__last").alias("year"),
        F.month("__last").alias("monthnum"),
        "tripnum",
        "triplen",
        "abslen",
    )
    if include_last:
        return out
    known = F.col("abslen").isNotNull()
    single = (F.col("tripnum") == 1) & (F.col("triplen") == 1)
    return out.filter(known | single).withColumns(
        {"year": F.when(known, F.col("year")), "monthnum": F.when(known, F.col("monthnum"))}
    )


def absence_split(trips: DataFrame, low: int = 7, high: int = 40) -> DataFrame:
    """Absences within a season (between the limits) and between seasons (above
    the upper one); the limits themselves fall in neither."""
    a = F.col("abslen")
    kind = F.when((a > low) & (a < high), "within").when(a > high, "between")
    return trips.withColumn("absence", kind).filter(F.col("absence").isNotNull())


def trip_length_by_month(trips: DataFrame) -> DataFrame:
    return trips.groupBy("monthnum").agg(
        F.avg("triplen").alias("meanlen"),
        F.stddev_samp("triplen").alias("sdlen"),
        F.count(F.lit(1)).alias("nlen"),
        sem("triplen").alias("semlen"),
    )


def attendance(det: DataFrame) -> DataFrame:
    """Distinct days, months and years per tag.

    Dates are made distinct first, so each tag brings at most one row per day.
    """
    days = det.select("transmitter", "date").distinct()
    return days.groupBy("transmitter").agg(
        F.count("date").alias("no_days"),
        F.count_distinct(F.trunc("date", "month")).alias("no_months"),
        F.count_distinct(F.year("date")).alias("no_years"),
    )


def fish_attendance(tags: DataFrame, seen: DataFrame) -> DataFrame:
    """Every tagged fish with its attendance, zero where never detected."""
    counts = ("no_days", "no_months", "no_years")
    zero = F.lit(0).cast("long")
    return tags.join(seen, "transmitter", "left").withColumns({c: F.coalesce(c, zero) for c in counts})


def returners(seen: DataFrame) -> DataFrame:
    """Tags seen on more than one day, month and year; months among the returning."""
    several = F.when(F.col("no_months") > 1, F.col("no_months"))
    return seen.agg(
        F.count_if(F.col("no_days") > 1).alias("returndays"),
        F.count_if(F.col("no_months") > 1).alias("returnmonths"),
        F.count_if(F.col("no_years") > 1).alias("returnyears"),
        F.avg(several).alias("mean_months"),
        F.stddev_samp(several).alias("sd_months"),
    )


def spread_of(df: DataFrame, value: str) -> DataFrame:
    """Number, minimum, median, mean, maximum and standard error of one column, nulls left out."""
    moments = df.agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), sem(value).alias("sem"),
    )
    return moments.withColumn("median", exact_quantiles(df, value, (0.5,), names=("median",)).scalar())


def trip_stats(trips: DataFrame) -> DataFrame:
    """Median trips per tag, tags with a single trip, and mean and standard error of the others'."""
    several = F.when(F.col("trips") != 1, F.col("trips"))
    stats = trips.agg(F.count_if(F.col("trips") == 1).alias("single"), F.avg(several).alias("mean_multi"), sem(several).alias("sem_multi"))
    return stats.withColumn("median_trips", exact_quantiles(trips, "trips", (0.5,), names=("median",)).scalar())
