"""Tests on a two-way table given wide: one row per row level, one count column
per column level, zero where a combination was not seen.

Row totals are then sums of columns and column totals one aggregate, so a test
takes two passes over the counted table and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reefpulse.functions.pvalues import p_chi_square


def contingency_table(counts: DataFrame, row: str, col: str, value: str, levels: Sequence[str]) -> DataFrame:
    """The wide table of a counted (row, col, value) table."""
    cells = [
        F.coalesce(F.sum(F.when(F.col(col) == v, F.col(value))), F.lit(0)).cast("double").alias(v) for v in levels
    ]
    return counts.groupBy(row).agg(*cells)


def _total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def expected_counts(table: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per cell with its observed and expected count."""
    sums = table.agg(F.struct(*[F.sum(v).alias(v) for v in levels]).alias("t")).scalar()
    wide = table.withColumn("__t", sums)
    row_total = _total([F.col(v) for v in levels])
    all_total = _total([F.col(f"__t.{v}") for v in levels])
    cells = F.array(
        *[
            F.struct(
                F.col(v).alias("observed"),
                F.try_divide(row_total * F.col(f"__t.{v}"), all_total).alias("expected"),
            )
            for v in levels
        ]
    )
    return wide.select(F.inline(cells))


def _degrees(levels: Sequence[str]) -> Column:
    """(rows - 1) x (columns - 1), from the number of cells."""
    rows = F.count(F.lit(1)) / len(levels)
    return ((rows - 1) * (len(levels) - 1)).cast("long")


def chi_square(table: DataFrame, levels: Sequence[str], *, correct: bool = True) -> DataFrame:
    """Pearson statistic and degrees of freedom; a 2 x 2 table is continuity
    corrected unless ``correct`` is off."""
    gap = F.abs(F.col("observed") - F.col("expected"))
    sums = expected_counts(table, levels).agg(
        F.sum(F.try_divide(gap * gap, F.col("expected"))).alias("plain"),
        F.least(F.lit(0.5), F.min(gap)).alias("step"),
        F.sum(F.try_divide(gap, F.col("expected"))).alias("first"),
        F.sum(F.try_divide(F.lit(1.0), F.col("expected"))).alias("second"),
        F.count(F.lit(1)).alias("cells"),
        _degrees(levels).alias("df"),
    )
    # sum (gap - step)^2 / E, expanded so that one pass is enough
    step = F.col("step")
    yates = F.col("plain") - 2 * step * F.col("first") + step * step * F.col("second")
    small = (F.col("df") == 1) & (F.col("cells") == 4) & F.lit(correct)
    return sums.select(F.when(small, yates).otherwise(F.col("plain")).alias("statistic"), "df")


def g_statistic(table: DataFrame, levels: Sequence[str]) -> DataFrame:
    """2 sum O ln(O/E); an empty cell adds nothing."""
    o = F.col("observed")
    term = F.when(o > 0, o * F.ln(F.try_divide(o, F.col("expected")))).otherwise(F.lit(0.0))
    return expected_counts(table, levels).agg(
        (F.lit(2.0) * F.sum(term)).alias("statistic"), _degrees(levels).alias("df")
    )


def with_p(test: DataFrame) -> DataFrame:
    """Adds the upper-tail probability to a one-row chi-square or G result."""
    return test.withColumn("p_value", p_chi_square(F.col("statistic"), F.col("df").cast("double")))
