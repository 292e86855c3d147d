"""Distribution summaries, rank and variance tests, and fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from reefpulse.functions.nulls import strict_sem
from reefpulse.functions.nulls import sem as sem_of
from reefpulse.functions.pvalues import p_f, p_normal
from reefpulse.operators.joining import join_group_row, join_null_safe
from reefpulse.operators.ranks import counted_quantiles, running_counts, value_counts

QUARTILES = ("q1", "median", "q3")
# Bins of a histogram that one row lists.
BLOCK = 4096


def six_number(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, median, mean, maximum and number of nulls.

    Everything comes from the counted values, whose shuffle is read several times
    while the data is read once.
    """
    counted = value_counts(df, value, by)
    mean = F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n"))
    moments = counted.groupBy(*by).agg(
        F.min("value").alias("min"), mean.alias("mean"), F.max("value").alias("max"), F.sum("nulls").alias("nulls")
    )
    quarts = counted_quantiles(counted, (0.25, 0.5, 0.75), by, QUARTILES)
    if by:
        both = join_null_safe(moments, quarts, by)
    else:
        row = quarts.select(F.struct(*QUARTILES).alias("q")).scalar()
        both = moments.withColumn("q", row).select("*", "q.*")
    return both.select(*by, "min", "q1", "median", "mean", "q3", "max", "nulls")


def six_number_dates(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """As ``six_number`` on day numbers since 1970-01-01."""
    return six_number(df.withColumn("__day", F.unix_date(date)), "__day", by)


def sem(df: DataFrame, value: str, by: Sequence[str] = (), skip_null: bool = False) -> DataFrame:
    """n, sd and standard error; null when any value is, unless ``skip_null``."""
    x = value
    sd = F.stddev_samp(x)
    whole = F.count(x) == F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.count(x if skip_null else F.lit(1)).alias("n"),
        (sd if skip_null else F.when(whole, sd)).alias("sd"),
        (sem_of(x) if skip_null else strict_sem(x)).alias("sem"),
    )


def histogram(
    df: DataFrame, value: str, by: Sequence[str] = (), *, width: float | None = None, bins: int = 30, empty: bool = True
) -> DataFrame:
    """Counts in bins centred on multiples of the width and closed on the right.

    With ``bins`` the width is range / (bins - 1). The lowest value always
    belongs to the first bin. Every group gets every bin between the overall
    first and last one, zero where empty; with ``empty`` off only bins that hold
    something, so that a narrow width over a wide range costs nothing.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    lo, hi = F.min("x"), F.max("x")
    step = F.lit(float(width)) if width else F.nullif(hi - lo, F.lit(0.0)) / (bins - 1)
    span = rows.agg(F.struct(lo.alias("lo"), hi.alias("hi"), step.alias("w")).alias("s")).scalar()

    def cell(x):
        return F.ceil((x - F.col("s.w") / 2) / F.col("s.w") - F.lit(1e-8))

    first = F.floor((F.col("s.lo") - F.col("s.w") / 2) / F.col("s.w")) + 1
    last = F.greatest(cell(F.col("s.hi")), first)
    counted = (
        rows.withColumn("s", span)
        .withColumn("bin", F.greatest(cell(F.col("x")), first))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if empty:
        groups = counted.select(*by).distinct() if by else counted.agg(F.count(F.lit(1)).alias("__cells"))
        # Blocks of bins first, so that no row holds all of them.
        blocks = F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("__block")
        start, stop = F.greatest(first, F.col("__block") * BLOCK), F.least(last, F.col("__block") * BLOCK + BLOCK - 1)
        grid = groups.withColumn("s", span).select(*by, "s", blocks).select(*by, "s", F.explode(F.sequence(start, stop)).alias("bin"))
        full = join_null_safe(grid, counted, [*by, "bin"])
    else:
        full = counted.withColumn("s", span)
    return full.select(
        *by,
        (F.col("bin") * F.col("s.w")).alias("center"),
        ((F.col("bin") - 0.5) * F.col("s.w")).alias("xmin"),
        ((F.col("bin") + 0.5) * F.col("s.w")).alias("xmax"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def _counted_with_fences(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Counted values beside their group's quartiles, with ``inner`` for those
    within 1.5 quartile ranges of the box."""
    counted = value_counts(df.filter(F.col(value).isNotNull()), value, by)
    box = counted_quantiles(counted, (0.25, 0.5, 0.75), by, QUARTILES)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inner = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return join_group_row(counted, box, by, "value").withColumn("inner", inner)


def boxplot_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (extremes within 1.5 quartile ranges) and outlier count."""
    whisker = F.when(F.col("inner"), F.col("value"))
    return (
        _counted_with_fences(df, value, by)
        .groupBy(*by)
        .agg(
            F.min(whisker).alias("ymin"),
            F.min("q1").alias("lower"),
            F.min("median").alias("middle"),
            F.min("q3").alias("upper"),
            F.max(whisker).alias("ymax"),
            F.sum(F.when(F.col("inner"), 0).otherwise(F.col("n"))).alias("outliers"),
        )
    )


def boxplot_outliers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """One row per outlying value, with how often it occurs as ``n``."""
    return _counted_with_fences(df, value, by).filter(~F.col("inner")).select(*by, F.col("value").alias(value), "n")


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Homogeneity of variance: one-way F of absolute deviations from group medians.

    Works on the counted values, weighted by their counts.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    counted = value_counts(rows, value, [group])
    medians = counted_quantiles(counted, (0.5,), [group], ["__med"])
    dev = join_group_row(counted, medians, [group], "value").withColumn("d", F.abs(F.col("value") - F.col("__med")))
    weighted = F.col("n") * F.col("d")
    groups = dev.groupBy(group).agg(
        F.sum("n").alias("n"), F.sum(weighted).alias("s"), F.sum(weighted * F.col("d")).alias("q")
    )
    within = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    sums = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("between"),
        F.sum(within).alias("within"),
    )
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("between"), df1), F.try_divide(F.col("within"), df2))
    return sums.select(df1.alias("df1"), df2.alias("df2"), f.alias("f"))


def levene_p(test: DataFrame) -> DataFrame:
    return test.withColumn("p_value", p_f(F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double")))


def rank_sum(df: DataFrame, value: str, group: str, first: object) -> DataFrame:
    """Two-sample rank sum of group ``first`` against the rest.

    Ties share their average rank. ``w`` is the first sample's rank sum less its
    minimum; ``z`` has the tie and continuity corrections of the normal
    approximation.
    """
    is_first = (F.col(group) == F.lit(first)).cast("long")
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = running_counts(value_counts(rows, value, n1=is_first))
    n = F.col("n").cast("double")
    rank = F.col("before") + (n + 1.0) / 2.0
    sums = ranked.agg(
        F.sum(F.col("n1") * rank).alias("r1"),
        F.sum("n1").cast("double").alias("n1"),
        F.sum(n).alias("all"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n1, total = F.col("n1"), F.col("all")
    n2 = total - n1
    w = F.col("r1") - n1 * (n1 + 1.0) / 2.0
    off = w - n1 * n2 / 2.0
    var = n1 * n2 / 12.0 * ((total + 1.0) - F.try_divide(F.col("ties"), total * (total - 1.0)))
    z = F.try_divide(off - F.signum(off) * 0.5, F.sqrt(var))
    return sums.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), w.alias("w"), z.alias("z"))


def rank_sum_p(test: DataFrame) -> DataFrame:
    return test.withColumn("p_value", p_normal(F.col("z")))


def linear_fit(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line with its standard errors, t values, R2 and F.

    Rows with a null y or x are left out. A fit without spread in x has no
    slope; one without residual freedom has no errors.
    """
    Y, X = F.col(y).cast("double"), F.col(x).cast("double")
    sums = (
        df.filter(Y.isNotNull() & X.isNotNull())
        .groupBy(*by)
        .agg(
            F.regr_count(Y, X).alias("n"),
            F.regr_avgx(Y, X).alias("mx"),
            F.regr_avgy(Y, X).alias("my"),
            F.regr_sxx(Y, X).alias("sxx"),
            F.regr_syy(Y, X).alias("syy"),
            F.regr_sxy(Y, X).alias("sxy"),
        )
    )
    spread = F.when(F.col("sxx") > 0, F.col("sxx"))
    dfree = F.col("n") - 2
    fit = sums.withColumn("slope", F.col("sxy") / spread).withColumns(
        {
            "intercept": F.col("my") - F.col("slope") * F.col("mx"),
            "__rss": F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)),
        }
    )
    fit = fit.withColumn("__s2", F.when(dfree > 0, F.col("__rss") / dfree)).withColumns(
        {
            "se_slope": F.sqrt(F.col("__s2") / spread),
            "se_intercept": F.sqrt(F.col("__s2") * (1.0 / F.col("n") + F.col("mx") * F.col("mx") / spread)),
            "r2": F.lit(1.0) - F.try_divide(F.col("__rss"), F.col("syy")),
        }
    )
    t = F.try_divide(F.col("slope"), F.col("se_slope"))
    return fit.select(
        *by,
        "n",
        "slope",
        "intercept",
        "se_slope",
        "se_intercept",
        t.alias("t_slope"),
        F.try_divide(F.col("intercept"), F.col("se_intercept")).alias("t_intercept"),
        "r2",
        (t * t).alias("f"),
    )


def linear_fit_p(fit: DataFrame) -> DataFrame:
    return fit.withColumn("p_value", p_f(F.col("f"), F.lit(1.0), (F.col("n") - 2).cast("double")))


def local_regression(
    df: DataFrame,
    y: str,
    x: str,
    by: Sequence[str] = (),
    *,
    span: float = 0.75,
    step: float = 0.5,
    slots: int = 48,
) -> DataFrame:
    """Local quadratic with tricube weights, evaluated at each x that occurs.

    x lies on a grid of ``slots`` values 0, step, 2 step, ... (the half-hours of a
    day); anything else is an error. Rows are first reduced to one (n, sum y) per
    group and grid value, so a group carries at most ``slots`` points. The
    neighbourhood is the floor(span * n) nearest observations, with repeats.
    """
    Y, raw = F.col(y).cast("double"), F.col(x).cast("double")
    at_slot = raw / F.lit(float(step))
    on_grid = (at_slot == F.floor(at_slot)) & at_slot.between(0, slots - 1)
    off_grid = F.raise_error(F.concat(F.lit(f"{x} is not on the grid: "), raw.cast("string"))).cast("double")
    X = F.when(on_grid | raw.isNull(), raw).otherwise(off_grid)
    pts = (
        df.filter(Y.isNotNull() & X.isNotNull())
        .groupBy(*by, X.alias("x"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(Y).alias("sy"))
    )
    grid = pts.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("x", "n", "sy"))).alias("pts"), F.sum("n").alias("__n")
    )
    at = grid.withColumn("p0", F.explode("pts")).withColumn("x", F.col("p0.x"))
    near = F.array_sort(
        F.transform("pts", lambda p: F.struct(F.abs(p["x"] - F.col("x")).alias("d"), p["n"].alias("n")))
    )
    want = F.floor(F.col("__n") * span + 1e-5)
    reach = F.aggregate(
        near,
        F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("h")),
        lambda a, p: F.struct(
            (a["seen"] + p["n"]).alias("seen"),
            F.when(a["seen"] < want, p["d"]).otherwise(a["h"]).alias("h"),
        ),
    )["h"]
    at = at.withColumn("__h", reach)

    def weigh(p):
        u = p["x"] - F.col("x")
        r = F.abs(u) / F.col("__h")
        k = F.when(r < 1, F.pow(F.lit(1.0) - F.pow(r, F.lit(3.0)), F.lit(3.0))).otherwise(F.lit(0.0))
        return F.struct(u.alias("u"), (k * p["n"]).alias("w"), (k * p["sy"]).alias("wy"))

    zeros = F.struct(*[F.lit(0.0).alias(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")])

    def add(a, p):
        u, w, wy = p["u"], p["w"], p["wy"]
        terms = {
            "s0": w, "s1": w * u, "s2": w * u * u, "s3": w * u * u * u, "s4": w * u * u * u * u,
            "t0": wy, "t1": wy * u, "t2": wy * u * u,
        }
        return F.struct(*[(a[k] + v).alias(k) for k, v in terms.items()])

    sums = F.when(F.col("__h") > 0, F.aggregate(F.transform("pts", weigh), zeros, add))
    fit = at.withColumn("m", sums)
    s0, s1, s2, s3, s4 = (F.col(f"m.s{i}") for i in range(5))
    t0, t1, t2 = (F.col(f"m.t{i}") for i in range(3))
    c0 = s2 * s4 - s3 * s3
    c1 = s1 * s4 - s2 * s3
    c2 = s1 * s3 - s2 * s2
    det = s0 * c0 - s1 * c1 + s2 * c2
    # A fit needs three distinct x of positive weight; otherwise det vanishes.
    solid = F.abs(det) > F.abs(s0 * c0) * 1e-12
    fitted = F.when(solid, (t0 * c0 - t1 * c1 + t2 * c2) / det)
    return fit.select(*by, "x", F.col("p0.n").cast("long").alias("n"), fitted.alias("fitted"))
