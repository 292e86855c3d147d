"""Counts and shares of tags, detections, depth readings, reports and currents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from reefpulse.functions.nulls import share
from reefpulse.operators.joining import join_null_safe


def tag_count(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count(F.lit(1)).alias("n"))


def tag_freq(tags: DataFrame, allow: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Tags, and analysed tags, per level of each attribute, in one pass."""
    used = allow.select("transmitter").distinct().withColumn("used", F.lit(True))
    levels = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("level")) for a in attributes]
    )
    return (
        tags.join(used, "transmitter", "left")
        .select("used", F.inline(levels))
        .groupBy("attribute", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("used")).alias("n_used"))
    )


def rows_per_tag(det: DataFrame) -> DataFrame:
    return det.groupBy("transmitter").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def detected_fish(det: DataFrame) -> DataFrame:
    """Tags with detections, and the first and last date over all of them."""
    return rows_per_tag(det).agg(
        F.count("transmitter").alias("fish"),
        F.sum("n").alias("detections"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def depth_events(depth: DataFrame) -> DataFrame:
    return (
        depth.filter(F.col("depthcat").isNotNull())
        .groupBy("halfhour", "long_nad83", "depthcat")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def depth_share(depth: DataFrame, shallow: float = -10.0, deep: float = -30.0) -> DataFrame:
    n = F.count(F.lit(1))
    return depth.agg(
        share(F.count_if(F.col("z") < deep), n).alias("deep"),
        share(F.count_if(F.col("z") > shallow), n).alias("shallow"),
    )


def status_share(reports: DataFrame, known: Sequence[str] | int = 4) -> DataFrame:
    """Reports per status, as percent of all and of the known statuses.

    ``known`` lists the known statuses, or says how many of the first in order
    of name count as known (missing sorts last). Every status gets both shares.
    """
    counts = reports.groupBy("current_status").agg(F.count(F.lit(1)).alias("freq"))
    total = counts.agg(F.sum("freq")).scalar()
    if isinstance(known, int):
        first = counts.orderBy(F.asc_nulls_last("current_status")).limit(known)
    else:
        first = counts.filter(F.col("current_status").isin(list(known)))
    known_total = first.agg(F.sum("freq")).scalar()
    return counts.select(
        "current_status",
        "freq",
        F.round(share(F.col("freq"), total) * 100, 1).alias("proptot"),
        F.round(share(F.col("freq"), known_total) * 100, 1).alias("propknown"),
    )


def report_counts(reports: DataFrame) -> DataFrame:
    """Rows and distinct ids.

    Ids are made distinct by shuffle first, so no task holds them all.
    """
    per_id = reports.groupBy("spawning_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.sum("n").alias("reports"), F.count(F.lit(1)).alias("ids"))


def current_means(currents: DataFrame, bins: int = 9) -> DataFrame:
    """Mean direction and speed over the depth bins, two decimals; null if any bin is.

    Directions are averaged as plain numbers, not on the circle.
    """

    def mean(prefix: str):
        total = F.col(f"{prefix}_1")
        for i in range(2, bins + 1):
            total = total + F.col(f"{prefix}_{i}")
        return F.round(total / F.lit(float(bins)), 2)

    return currents.select(
        "ts_local",
        mean("direction").alias(f"direction_1_{bins}"),
        mean("speed").alias(f"speed_1_{bins}"),
    )


def current_by_hour(currents: DataFrame, value: str = "direction_1_9_s") -> DataFrame:
    """Mean and standard error of the east component per hour of day."""
    n = F.count(value)
    mean, se = F.avg(value), F.stddev_samp(value) / F.sqrt(n)
    return currents.groupBy(F.hour("ts_local").alias("hour")).agg(
        n.alias("n"),
        mean.alias("mean"),
        se.alias("se"),
        (mean - se).alias("ymin"),
        (mean + se).alias("ymax"),
    )


def join_availability(counts: DataFrame, availability: DataFrame, key: str = "mssca") -> DataFrame:
    return join_null_safe(counts, availability, [key])
