"""Joins in which null keys match each other, as in the study's lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` with null = null; keeps the left side's keys once.

    Null-safe equality is still an equi-join key for Spark, so the physical
    strategy (and AQE's size and skew handling) is the same as for ``=``.
    """
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns]
    )
    cond = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys))
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


# A group with more than one part in SHARES of all rows, and LEAST_HOT at least, is split.
SHARES, LEAST_HOT = 256, 10_000


def hot_groups(rows: DataFrame, keys: Sequence[str], least: int = LEAST_HOT) -> Column:
    """A map, as a scalar subquery, from the hash of a hot group's keys to its number of salts.

    Salts follow from counts, pre-aggregated before their shuffle: as many as the
    group holds shares of all rows. By that bound the map has less than ``SHARES``
    entries, whatever the data. Groups whose hash is that of a hot one are salted
    like it, which costs copies and changes no result.
    """
    counts = rows.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    share = F.greatest(F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0)) / SHARES, F.lit(float(least)))
    hot = counts.withColumn("share", share).filter(F.col("n") > F.col("share"))
    salts = F.struct("h", F.ceil(F.col("n") / F.col("share")).cast("int"))
    return hot.agg(F.map_from_entries(F.collect_list(salts))).scalar()


def salted(rows: DataFrame, hot: Column, keys: Sequence[str], spread_on: Sequence[str], out: str = "__salt") -> DataFrame:
    """Adds a salt from ``spread_on`` to the rows of hot groups; all others have salt 0."""
    n = F.coalesce(F.try_element_at("__hot", F.xxhash64(*keys)), F.lit(1))
    return rows.withColumn("__hot", hot).withColumn(out, F.pmod(F.hash(*spread_on), n)).drop("__hot")


def repeated(stats: DataFrame, hot: Column, keys: Sequence[str], out: str = "__salt") -> DataFrame:
    """One copy of each row for every salt of its group."""
    n = F.coalesce(F.try_element_at("__hot", F.xxhash64(*keys)), F.lit(1))
    return stats.withColumn("__hot", hot).withColumn(out, F.explode(F.sequence(F.lit(0), n - 1))).drop("__hot")


def join_group_row(rows: DataFrame, stats: DataFrame, keys: Sequence[str], spread_on: str, least: int = LEAST_HOT) -> DataFrame:
    """Puts each group's one row of ``stats`` beside that group's ``rows``.

    A group may hold much of the data, so hot groups are joined on a salt taken
    from ``spread_on`` as well: should the join be by shuffle, they go to many
    tasks. Only their rows of ``stats`` are repeated.
    """
    hot = hot_groups(rows, keys, least)
    left, right = salted(rows, hot, keys, [spread_on]), repeated(stats, hot, keys)
    return join_null_safe(left, right, [*keys, "__salt"], "inner").drop("__salt")
