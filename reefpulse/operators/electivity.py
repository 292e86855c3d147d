"""Chesson electivity: S = (r/P) / sum(r/P), 0 avoided to 1 exclusive.

Sums over all categories come in two ways. Where the calendar or a listed set
bounds the categories (zones, half-hours, months, DAFM, presence) they are a
window over the counted rows, at most a few hundred. Otherwise (stations) they
are scalar subqueries that reuse the counting shuffle, so the categories are
never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reefpulse.functions.nulls import share
from reefpulse.operators.joining import join_null_safe

# Month abbreviations in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _whole(df: DataFrame, agg: Column, bounded: bool) -> Column:
    """An aggregate over all categories, beside each of them."""
    return agg.over(Window.partitionBy()) if bounded else df.agg(agg).scalar()


def chesson(
    counts: DataFrame,
    used: str = "tot_freq",
    available: str = "chesson_p",
    total: str | None = None,
    suffix: str = "",
    bounded: bool = False,
) -> DataFrame:
    """Adds prop (share of the used total), rdivp and chesson_s.

    ``total`` names the column whose sum divides ``used``; by default ``used``
    itself. ``bounded`` says that the number of categories is bounded.
    """
    prop, rdivp, s = f"prop{suffix}", f"rdivp{suffix}", f"chesson_s{suffix}"
    out = counts.withColumn(prop, share(F.col(used), _whole(counts, F.sum(total or used), bounded)))
    out = out.withColumn(rdivp, F.try_divide(F.col(prop), F.col(available)))
    return out.withColumn(s, share(F.col(rdivp), _whole(out, F.sum(rdivp), bounded)))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` x ``col`` as one column per value, zero where unseen.

    Counted per row with one conditional count per value: a single shuffle of
    at most one partial row per task and ``row``.
    """
    counts = [F.count_if(F.col(col) == v).alias(v) for v in values]
    return df.filter(F.col(row).isNotNull()).groupBy(row).agg(*counts)


def pivot_zone(counts: DataFrame, value: str = "tot_freq", zones: Sequence[str] = ("in", "out")) -> DataFrame:
    """Half-hour x zone matrix of a counted table; null where unseen."""
    cells = [F.sum(F.when(F.col("mssca") == z, F.col(value))).alias(z) for z in zones]
    return counts.groupBy("halfhour").agg(*cells)


def chesson_presence(by_dafm: DataFrame) -> DataFrame:
    """Presence against absence at equal availability, from a DAFM x presence table."""
    counts = (
        by_dafm.agg(F.sum("A").alias("A"), F.sum("P").alias("P"))
        .unpivot([], ["A", "P"], "pa", "tot_freq")
        .withColumn("chesson_p", F.lit(0.5))
    )
    return chesson(counts, bounded=True)


def availability_zone(stations: DataFrame, slots: int = 1) -> DataFrame:
    """Share of station-years per zone, divided over ``slots`` half-hours."""
    zones = stations.groupBy("mssca").agg(F.sum("years_deployed").alias("__y"))
    total = _whole(zones, F.sum("__y"), bounded=True)
    return zones.select("mssca", (share(F.col("__y"), total) / F.lit(float(slots))).alias("chesson_p"))


def chesson_zone(bins: DataFrame, stations: DataFrame) -> DataFrame:
    """In against out, from bin counts; bins without a zone are left out."""
    counts = (
        bins.filter(F.col("mssca").isNotNull()).groupBy("mssca").agg(F.count(F.lit(1)).alias("tot_freq"))
    )
    return chesson(join_null_safe(counts, availability_zone(stations), ["mssca"]), bounded=True)


def chesson_halfhour(by_halfhour_zone: DataFrame, stations: DataFrame) -> DataFrame:
    """Per half-hour and zone; ``expected`` is one over the number of rows."""
    counts = join_null_safe(by_halfhour_zone, availability_zone(stations, 48), ["mssca"])
    rows = _whole(counts, F.count(F.lit(1)), bounded=True)
    return chesson(counts, bounded=True).withColumn("expected", share(F.lit(1), rows))


def _presence_index(table: DataFrame) -> DataFrame:
    out = table.withColumn("tot_freq", F.col("A") + F.col("P"))
    return out.withColumn("chesson_p", share(F.col("tot_freq"), _whole(out, F.sum("tot_freq"), bounded=True)))


def chesson_month(tag_months: DataFrame) -> DataFrame:
    """Presence index per month over all tags and years, with the calendar order."""
    table = _presence_index(crosstab(tag_months, "month", "pa", ["A", "P"]))
    order = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.col("month")).cast("int")
    return chesson(table, "P", total="tot_freq", bounded=True).withColumn("month_no", order)


def chesson_dafm(by_dafm: DataFrame) -> DataFrame:
    """Presence and absence index per DAFM beside the expected share, from a DAFM x
    presence table (``crosstab`` of filled bins, or ``binning.presence_by_dafm``)."""
    present = chesson(_presence_index(by_dafm), "P", total="tot_freq", bounded=True)
    both = chesson(present, "A", total="tot_freq", suffix="_abs", bounded=True)
    return both.select("dafm", "chesson_p", "chesson_s", "chesson_s_abs")


def chesson_station(det: DataFrame, stations: DataFrame) -> DataFrame:
    """Per station, unvisited ones included with zero.

    Availability is the table's own ``chesson_p`` where it has that column and a
    value, and the share of years deployed otherwise.
    """
    total = stations.agg(F.sum("years_deployed")).scalar()
    by_years = share(F.col("years_deployed"), total)
    given = F.coalesce("chesson_p", by_years) if "chesson_p" in stations.columns else by_years
    counts = det.groupBy("station").agg(F.count(F.lit(1)).alias("__n"))
    listed = stations.select(
        "station", "mssca", given.alias("chesson_p")
    )
    joined = join_null_safe(listed, counts, ["station"]).select(
        "station", "mssca", "chesson_p", F.coalesce("__n", F.lit(0).cast("long")).alias("tot_freq")
    )
    return chesson(joined)


def unpivot_index(index: DataFrame, row: str = "dafm") -> DataFrame:
    """Index columns to (type, value) rows."""
    return index.unpivot([row], ["chesson_s", "chesson_s_abs", "chesson_p"], "type", "value")


def mosaic_share(counts: DataFrame, row: str, col: str, value: str = "tot_freq") -> DataFrame:
    """Share of each column within its row."""
    in_row = F.sum(value).over(Window.partitionBy(row))
    return counts.select(row, col, value, share(F.col(value), in_row).alias("share"))
