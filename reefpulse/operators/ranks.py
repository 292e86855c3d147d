"""Exact order statistics without gathering a group in one task.

Values are first counted (one row per distinct value and group, pre-aggregated
before the shuffle). The counted values are cut into cells at quantiles of a mergeable
sketch of the group's distinct values, and each cell is cut again by a sketch of its
own. A sketch goes by rank, so outliers, long tails, infinity and NaN widen no cell: two
levels leave about one in ``CUTS`` squared of a group's distinct values in a cell, and
``levels`` adds more. Sketches only place the cuts; exact running totals over the cells
give the number of observations ahead of each, and only the values of one cell
are ordered together. A value that makes up much of the data is a single counted row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reefpulse.operators.joining import join_group_row, join_null_safe

# Cuts of a cell, levels of cells, and the sketch's accuracy.
CUTS, LEVELS = 64, 2
ACCURACY = 2000


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), **sums: Column) -> DataFrame:
    """One row per group and distinct value: ``value``, its count ``n``, and the
    named sums. Missing values are one row with ``n`` zero and their number in
    ``nulls``, so a group of missing values only is kept."""
    return df.groupBy(*by, F.col(value).cast("double").alias("value")).agg(
        F.count(value).alias("n"),
        F.count_if(F.col(value).isNull()).alias("nulls"),
        *[F.sum(c).alias(k) for k, c in sums.items()],
    )


def _cell_names(levels: int) -> list[str]:
    return [f"__b{k}" for k in range(1, levels + 1)]


def _grid(counted: DataFrame, by: Sequence[str], levels: int) -> tuple[DataFrame, DataFrame]:
    """The counted rows with their cell (a number for each level) and their group's
    ``total``, and one row per occupied cell with the observations in it and ahead of it."""
    marks = F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)])
    rows, names = counted, _cell_names(levels)
    for k, name in enumerate(names):
        cut = F.percentile_approx("value", marks, ACCURACY).alias("cuts")
        within = [*by, *names[:k]]
        if k:
            ranged = join_null_safe(rows, rows.groupBy(*within).agg(F.struct(cut).alias("__b")), within, "inner")
        else:
            ends = F.struct(cut, F.sum("n").alias("total"))
            if by:
                ranged = join_group_row(rows, rows.groupBy(*by).agg(ends.alias("__b")), by, "value")
            else:
                ranged = rows.withColumn("__b", rows.agg(ends.alias("b")).scalar())
            ranged = ranged.withColumn("total", F.col("__b.total"))
        # The interval of a value is the number of cuts up to it; missing values have none.
        below = F.size(F.filter("__b.cuts", lambda c: c <= F.col("value"))).cast("long")
        rows = ranged.withColumn(name, F.coalesce(below, F.lit(0).cast("long"))).drop("__b")
    zero = F.lit(0).cast("long")
    cells = rows.groupBy(*by, *names).agg(F.sum("n").alias("__m"), F.max("total").alias("total"))
    # What is ahead: for each level the cells before it within the same cell of the level above,
    # at most CUTS + 2 of them.
    fine, ahead = cells, zero
    for k in range(levels, 0, -1):
        outer, name = [*by, *names[: k - 1]], names[k - 1]
        level = cells if k == levels else cells.groupBy(*outer, name).agg(F.sum("__m").alias("__m"))
        before = W.partitionBy(*outer).orderBy(name).rowsBetween(W.unboundedPreceding, -1)
        level = level.withColumn(f"__c{k}", F.coalesce(F.sum("__m").over(before), zero))
        fine = level if k == levels else join_null_safe(fine, level.drop("__m"), [*outer, name], "inner")
        ahead = ahead + F.col(f"__c{k}")
    fine = fine.withColumn("__ahead", ahead).drop(*[f"__c{k}" for k in range(1, levels + 1)])
    return rows, fine


def _count_within(placed: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Orders the values of each cell and adds ``before``."""
    in_cell = W.partitionBy(*by, *names).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("__ahead") + F.coalesce(F.sum("n").over(in_cell), F.lit(0).cast("long"))
    return placed.withColumn("before", before).drop(*names, "__ahead")


def running_counts(counted: DataFrame, by: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """Adds ``before``, the number of observations in the group with a smaller value,
    and ``total``, the group's number of observations.

    ``counted`` is the output of ``value_counts``.
    """
    rows, cells = _grid(counted, by, levels)
    names = _cell_names(levels)
    offsets = cells.select(*by, *names, "__ahead")
    return _count_within(join_null_safe(rows, offsets, [*by, *names], "inner"), by, names)


def _asked(cells: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The cells that hold the ranks asked for: at most two per probability and group."""
    asked = [r for p in probs for r in _ranks(F.col("total"), p)]
    return cells.filter(F.exists(F.array(*asked), lambda r: (r >= F.col("__ahead")) & (r < F.col("__ahead") + F.col("__m"))))


def _counts_at(counted: DataFrame, probs: Sequence[float], by: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """``running_counts`` for the values near ``probs`` only.

    All other values are dropped before any further shuffle: without groups the
    wanted cells travel as one short array, otherwise as rows of a small join side.
    """
    rows, cells = _grid(counted, by, levels)
    names = _cell_names(levels)
    wanted = _asked(cells, probs).select(*by, *names, "__ahead")
    if by:
        return _count_within(join_null_safe(rows, wanted, [*by, *names], "inner"), by, names)
    listed = wanted.agg(F.collect_list(F.struct(*names, "__ahead"))).scalar()
    here = F.filter("__w", lambda w: reduce(lambda a, b: a & b, (w[c] == F.col(c) for c in names)))
    kept = rows.withColumn("__w", listed).withColumn("__w", here).filter(F.size("__w") > 0)
    return _count_within(kept.withColumn("__ahead", F.col("__w")[0]["__ahead"]).drop("__w"), (), names)


def _position(total: Column, p: float) -> Column:
    return (total - 1).cast("double") * F.lit(float(p))


def _ranks(total: Column, p: float) -> tuple[Column, Column]:
    return F.floor(_position(total, p)), F.ceil(_position(total, p))


def counted_quantiles(
    counted: DataFrame, probs: Sequence[float], by: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Linearly interpolated (type 7) quantiles of a ``value_counts`` table, one row
    per group."""
    picks, finals = [F.max("total").alias("__total")], []
    for name, p in zip(names, probs):
        for end, rank in zip(("lo", "hi"), _ranks(F.col("total"), p)):
            here = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"__{name}_{end}"))
        position = _position(F.col("__total"), p)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        finals.append((lo + (position - F.floor(position)) * (hi - lo)).alias(name))
    ranked = _counts_at(counted, probs, by)
    return ranked.groupBy(*by).agg(*picks).select(*by, *finals)


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles (type 7) per group, one column each."""
    names = list(names or [f"q{p:g}".replace(".", "_") for p in probs])
    return counted_quantiles(value_counts(df, value, by), probs, by, names)
