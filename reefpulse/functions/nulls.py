"""Aggregates in which a single missing value makes the result missing, and
distinct counts in which missing is a value of its own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict(agg: Column, c: str) -> Column:
    """``agg`` if ``c`` is never null in the group, else null."""
    return F.when(F.count(c) == F.count(F.lit(1)), agg)


def strict_avg(c: str) -> Column:
    return strict(F.avg(c), c)


def strict_sem(c: str) -> Column:
    return strict(sem(c), c)


def sem(c: str) -> Column:
    """Standard error of the mean over non-null values; null below two."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def distinct_with_null(c: str) -> Column:
    return F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0).cast("long"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
