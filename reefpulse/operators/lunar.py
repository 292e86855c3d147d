"""Days after full moon (DAFM), signed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EARLY_DAYS = 10


def _moon_dates(moons: DataFrame) -> DataFrame:
    """One row with the sorted distinct moon dates; a century has 1,237."""
    return moons.agg(F.array_sort(F.collect_set("date")).alias("moons"))


def dafm_calendar(moons: DataFrame, early_days: int = EARLY_DAYS) -> DataFrame:
    """One row per calendar date the moon table decides: (date, dafm).

    Each date lies between one full moon and the next, so the rule "days to the
    next moon if fewer than ``early_days``, else days since the last" needs only
    that pair. The calendar has one row per day from ``early_days`` before the
    first moon to the last moon, whatever the number of detections.
    """
    pairs = F.arrays_zip(
        F.col("moons").alias("moon"), F.expr("slice(moons, 2, size(moons))").alias("after")
    )
    nights = _moon_dates(moons).select(F.posexplode(pairs).alias("at", "pair")).select("at", "pair.*")
    first = F.when(F.col("at") == 0, F.date_sub("moon", early_days - 1)).otherwise(F.col("moon"))
    last = F.coalesce(F.date_sub("after", 1), F.col("moon"))
    days = nights.withColumn("date", F.explode(F.sequence(first, last)))
    since = F.datediff("date", "moon")
    until = F.datediff("date", "after")
    return days.select(
        "date",
        F.when((since >= 0) & (until > -early_days), until).otherwise(since).alias("dafm"),
    )


def add_dafm(df: DataFrame, moons: DataFrame, date: str = "date", early_days: int = EARLY_DAYS) -> DataFrame:
    """Adds ``dafm`` by an equi-join of the date with the calendar.

    Past the last moon it counts on from that moon; ``early_days`` or more
    before the first one it is null.
    """
    cal = dafm_calendar(moons, early_days).withColumnRenamed("date", "__day")
    last_moon = _moon_dates(moons).select(F.try_element_at("moons", F.lit(-1))).scalar()
    joined = df.join(cal, F.col(date) == F.col("__day"), "left").drop("__day").withColumn("__last", last_moon)
    beyond = F.when(F.col(date) > F.col("__last"), F.datediff(F.col(date), F.col("__last")))
    return joined.withColumn("dafm", F.coalesce("dafm", beyond)).drop("__last")


def add_moon_cycle(df: DataFrame) -> DataFrame:
    """Adds the date of the full moon a row counts from."""
    return df.withColumn("moondate", F.date_sub(F.col("date"), F.col("dafm")))


def arrive_depart(df: DataFrame) -> DataFrame:
    """First and last DAFM of each tag in each moon cycle.

    Minimum and maximum do not change with repeated days, so no distinct is needed.
    """
    return (
        add_moon_cycle(df)
        .groupBy("transmitter", "moondate")
        .agg(F.min("dafm").alias("arrival"), F.max("dafm").alias("departure"))
    )


def arrive_depart_summary(ranges: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return ranges.groupBy("moondate").agg(
        F.avg("arrival").alias("meanarrive"),
        F.avg("departure").alias("meandepart"),
        n.alias("n"),
        F.stddev_samp("arrival").alias("sdarrive"),
        F.stddev_samp("departure").alias("sddepart"),
        (F.stddev_samp("arrival") / F.sqrt(n)).alias("semarrive"),
        (F.stddev_samp("departure") / F.sqrt(n)).alias("semdepart"),
    )


def detections_by_dafm(df: DataFrame, *by: str) -> DataFrame:
    """Detections per tag, year, month and DAFM; needs ``month_parts`` columns."""
    keys = by or ("transmitter", "year", "monthint", "monthname", "dafm")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("detfreq"))


def individuals_by_dafm(by_dafm: DataFrame, after_year: int | None = None) -> DataFrame:
    """Tags present and detections per year, month and DAFM.

    ``detections_by_dafm`` has one row per tag here, so a row count is the
    number of distinct tags (a null tag included).
    """
    rows = by_dafm if after_year is None else by_dafm.filter(F.col("year") > after_year)
    return rows.groupBy("year", "monthint", "monthname", "dafm").agg(
        F.count(F.lit(1)).alias("no_inds"), F.sum("detfreq").alias("no_dets")
    )


def month_peak(by_dafm: DataFrame) -> DataFrame:
    return by_dafm.groupBy("monthint").agg(F.sum("detfreq").alias("dets"))


def late_stayers(by_dafm: DataFrame, late_dafm: int = 14) -> DataFrame:
    return by_dafm.filter(F.col("dafm") > late_dafm)


def late_month_tags(by_dafm: DataFrame, month: int = 8) -> DataFrame:
    return by_dafm.filter(F.col("monthint") > month).select("transmitter").distinct()
