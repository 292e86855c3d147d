"""As-of lookups: the marks next to a time, by equality alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def around(rows: DataFrame, marks: DataFrame, at: str, mark: str, width: float) -> DataFrame:
    """Adds ``before`` and ``after``: the last mark up to each row's time and the first from it on.

    Times are numbers. The distinct times of both sides are ordered together in buckets
    of ``width``; what lies beyond a bucket's edge comes from one row per bucket with its first and
    last mark. So neither side meets the other by inequality, marks may be of any number, and
    rows that share a time are looked up once. A row without a time has neither mark.
    """
    times = rows.select(F.col(at).cast("double").alias("t")).filter("t IS NOT NULL").distinct()
    known = marks.select(F.col(mark).cast("double").alias("t")).filter("t IS NOT NULL").distinct()
    both = times.withColumn("m", F.lit(None).cast("double")).unionByName(known.withColumn("m", F.col("t")))
    both = both.withColumn("k", F.floor(F.col("t") / width))
    buckets = both.groupBy("k").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    # One row per bucket: as many as the time covered has.
    edges = buckets.select(
        "k",
        F.last("hi", True).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"),
        F.last("lo", True).over(W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, -1)).alias("later"),
    )
    up = W.partitionBy("k").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("k").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, 0)
    found = both.select("k", "t", "m", F.max("m").over(up).alias("up"), F.min("m").over(down).alias("down"))
    found = found.filter("m IS NULL").join(edges, "k").select(
        F.col("t").alias("__t"), F.coalesce("up", "earlier").alias("before"), F.coalesce("down", "later").alias("after")
    )
    return rows.join(found, F.col(at).cast("double") == F.col("__t"), "left").drop("__t")


def nearest(at: Column) -> Column:
    """The nearer of the columns ``before`` and ``after``; the earlier one where both are as near."""
    before, after = F.col("before"), F.col("after")
    return F.when(before.isNull() | (after - at < at - before), after).otherwise(before)
