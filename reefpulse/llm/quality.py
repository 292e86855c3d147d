"""Quality rules with robust multivariate outliers: minimum covariance determinant.

Counts of every text give a vector of transformed statistics. Per language and source
a location and scatter are fitted to the central half of all rows by C-steps: from
medians and median deviations on, rows are ranked by Mahalanobis distance, and the next
estimate comes from the central half of them, until no determinant falls any more. So
outliers may be nearly half of a group. Where three quarters of the rows lie within the
cutoff of that estimate, further C-steps with these, which vary less, give the final one.
A document goes if it fails a base rule or lies too far from its group's estimate.

Each step is two aggregations over the stored statistics with map-side combining, so
a hot source is no heavier than its number of map tasks. Statistics are whole
thousandths and distances are ranked in bins, so all sums and quantiles are exact and
reruns agree; at most a few thousand bins a group are held.

Groups of fewer than ``least`` rows that pass the base rules are pooled by language,
and pools that are still too small with one another; if that is too small as well, no
row of it is an outlier.

Defined results: an empty table gives an empty result; null or empty text has counts of 0 and fails the base rules; null
language and source are groups of their own; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from reefpulse.llm.store import bounded_batches, stored
from reefpulse.llm.wordhash import Words, chunks, mixed, span_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
D = 4
# Least scale of each statistic in thousandths: a spread below it is not told from none.
LEAST_SCALE = (100.0, 100.0, 400.0, 400.0)
# Chi-square with D degrees of freedom: its median, and about its 1 - 5e-7 quantile.
MEDIAN = 3.3567
CUTOFF = 35.0
# A step that lowers the log of a determinant by less has settled.
SETTLED = 1e-3


def _within(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many marks lie between consecutive edges."""
    return np.diff(np.concatenate(([0], np.cumsum(marks)))[edges])


def _count(texts: pa.Array) -> np.ndarray:
    w = Words(texts)
    n, b, edges = len(texts), w.bytes, w.byte_offsets
    out = np.zeros((len(COUNTS), n), np.int64)
    inside = np.concatenate(([0], np.cumsum(_inside := ~np.isin(b, (9, 10, 11, 12, 13, 32)))))
    out[0] = w.counts
    out[1] = _within(_inside & ((b & 0xC0) != 0x80), edges)
    out[2] = _within(_SYMBOL[b], edges)
    newline = np.flatnonzero(b == 10)
    starts, ends = np.sort(np.concatenate((edges[:-1], newline + 1))), np.sort(np.concatenate((edges[1:], newline)))
    real = inside[ends] > inside[starts]
    starts, ends = starts[real], ends[real]
    owner = np.searchsorted(edges, starts, side="right") - 1
    out[3] = np.bincount(owner, minlength=n)[:n]
    line = mixed(w.spans(starts, ends) ^ mixed(owner.astype(np.uint64)))
    _, kept = np.unique(line, return_index=True)
    out[4] = out[3] - np.bincount(owner[kept], minlength=n)[:n]
    at = w.gram_starts(3)
    if len(at):
        owner = w.text_of(at)
        gram = span_hashes(w.hashes, at, at + 3) ^ mixed(owner.astype(np.uint64))
        order = np.argsort(gram, kind="stable")
        same = np.zeros(len(at), bool)
        equal = gram[order][1:] == gram[order][:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
        hit = np.zeros(len(w.starts) + 2, bool)
        for k in range(3):
            hit[at[same] + k] = True
        out[5] = _within(hit[: len(w.starts)], w.offsets)
    return out


def _count_all(texts: pa.Array) -> pa.Array:
    parts = [_count(texts.slice(lo, hi - lo)) for lo, hi in chunks(texts)]
    columns = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], COUNTS)


def text_counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each text."""
    return arrow_udf(_count_all, ", ".join(f"{c} long" for c in COUNTS))(text)


def base_failed(q: str = "quality") -> Column:
    """Too short, or more than half of it in repeated windows of three words."""
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def vector(q: str = "quality") -> Column:
    """Whole thousandths: log of the mean word length, and logs of symbol, repeated-line and repeated-word shares."""
    def c(name: str) -> Column:
        return F.col(f"{q}.{name}").cast("double")

    def share(part: Column, whole: Column) -> Column:
        return F.log1p(10 * part / F.greatest(whole, F.lit(1.0)))

    parts = [
        F.log(F.greatest(c("word_chars"), F.lit(1.0)) / F.greatest(c("n_words"), F.lit(1.0))),
        share(c("n_symbols"), c("word_chars")), share(c("n_dup_lines"), c("n_lines")), share(c("n_repeat_words"), c("n_words")),
    ]
    return F.array(*[F.round(1000 * p).cast("long") for p in parts])


def distance(x: Column, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance."""
    off = [F.get(x, F.lit(i)) - F.get(centre, F.lit(i)) for i in range(D)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            term = off[i] * off[j] * F.get(inverse, F.lit(D * i + j))
            total = total + (term if i == j else 2 * term)
    return total


def _inverses(scatter: pd.Series) -> pd.Series:
    least = np.diag(np.square(LEAST_SCALE))
    return pd.Series([np.linalg.inv(np.reshape(s, (D, D)) + least).ravel() for s in scatter])


def _inverse(scatter: Column) -> Column:
    """The inverse of each scatter matrix, the least scales added to its diagonal."""
    return pandas_udf(_inverses, "array<double>")(scatter)


def _sizes(scatter: pd.Series) -> pd.Series:
    least = np.diag(np.square(LEAST_SCALE))
    return pd.Series([np.linalg.slogdet(np.reshape(s, (D, D)) + least)[1] for s in scatter], dtype="float64")


def _size(scatter: Column) -> Column:
    """The log determinant of each scatter matrix, the least scales added to its diagonal."""
    return pandas_udf(_sizes, "double")(scatter)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet."""
    renamed = b.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return a.join(renamed, cond).drop(*[f"__k_{k}" for k in keys])


def units(stats: DataFrame, least: int) -> DataFrame:
    """lang, source, unit: which rows are fitted together; -1 where too few are."""
    n = stats.groupBy("lang", "source").count()
    small = F.col("count") < least
    n = n.withColumn("of_lang", F.sum(F.when(small, F.col("count"))).over(W.partitionBy("lang")))
    n = n.withColumn("level", F.when(~small, 0).when(F.col("of_lang") >= least, 1).otherwise(2))
    rest = F.sum(F.when(F.col("level") == 2, F.col("count"))).over(W.partitionBy("level"))
    name = F.concat_ws("\x01", F.col("level").cast("string"), *[
        F.when(F.col("level") <= k, F.concat(F.lit("="), F.coalesce(F.col(c), F.lit("\x02")))) for k, c in ((1, "lang"), (0, "source"))
    ])
    return n.select("lang", "source", F.when((F.col("level") == 2) & (rest < least), F.lit("-")).otherwise(name).alias("unit"))


def _estimate(rows: DataFrame) -> DataFrame:
    """unit, centre and scatter from all rows given: exact integer moments."""
    x = [F.get("x", F.lit(i)) for i in range(D)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]
    squares = [F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i in range(D) for j in range(i, D)]
    m = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), *sums, *squares)

    def cov(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.col(f"p{i}{j}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n"))

    return m.select(
        "unit", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(D)]).alias("centre"),
        F.array(*[cov(i, j) for i in range(D) for j in range(D)]).alias("scatter"),
    )


def _ranked(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """unit, x and bin of the distance, for the units of ``estimates``."""
    known = stored(estimates.select("unit", "centre", _inverse(F.col("scatter")).alias("inverse")), "estimate")
    far = distance(F.col("x"), F.col("centre"), F.col("inverse"))
    return rows.join(known, "unit").select("unit", "x", F.floor(200 * F.log1p(far)).alias("bin"))


def _settled(rows: DataFrame, start: DataFrame, share: float) -> DataFrame:
    """unit, centre and scatter after C-steps with the central ``share`` of rows, until no determinant falls any more.

    Only units that still move are ranked again. Each step lowers a moving unit's
    determinant, which the least scales bound, so the steps end.
    """
    now = stored(start.select("unit", "centre", "scatter", F.lit(float("inf")).alias("size"), F.lit(True).alias("moves")), "start")
    while not now.where("moves").isEmpty():
        binned = _ranked(rows, now.where("moves"))
        limit = stored(binned.groupBy("unit").agg(F.percentile("bin", F.lit(share)).alias("limit")), "limit")
        step = _estimate(binned.join(limit, "unit").where("bin <= limit").select("unit", "x"))
        step = stored(step.select("unit", F.col("centre").alias("c"), F.col("scatter").alias("s"), _size(F.col("scatter")).alias("d")), "step")
        falls = F.coalesce(F.col("d") < F.col("size") - SETTLED, F.lit(False))
        now = stored(now.join(step, "unit", "left").select(
            "unit", *[F.when(falls, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("c", "centre"), ("s", "scatter"), ("d", "size"))],
            falls.alias("moves"),
        ), "settled")
    return now.select("unit", "centre", "scatter")


def _scaled(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``estimates`` with the scatter scaled up so that the median distance is the chi-square's."""
    middle = _ranked(rows, estimates).groupBy("unit").agg(F.percentile("bin", F.lit(0.5)).alias("middle"))
    grow = F.greatest(F.expm1((F.col("middle") + 0.5) / 200) / MEDIAN, F.lit(1.0))
    return stored(estimates.join(middle, "unit").select("unit", "centre", F.transform("scatter", lambda s: s * grow).alias("scatter")), "scaled")


def fit(stats: DataFrame, least: int = 50, central: float = 0.75) -> DataFrame:
    """Robust estimates from ``stats`` (lang, source, x): lang, source, centre, inverse, one row per group.

    The central half gives the estimate, and the share ``central`` where it has no
    outlier by the half's. The scatter of the central rows is scaled up so that the
    median distance is the chi-square's.
    """
    groups = stored(units(stats, least).where("unit <> '-'"), "units")
    rows = stored(_same(stats, groups, ("lang", "source")).select("unit", "x"), "statistics")

    def medians(x: list[Column]) -> list[Column]:
        return [F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(x)]

    x = [F.get("x", F.lit(i)) for i in range(D)]
    centres = rows.groupBy("unit").agg(*medians(x)).select("unit", F.array(*[f"m{i}" for i in range(D)]).alias("centre"))
    centres = stored(centres, "centres")
    off = [F.abs(c - F.get("centre", F.lit(i))) for i, c in enumerate(x)]
    spread = rows.join(centres, "unit").groupBy("unit").agg(*medians(off)).join(centres, "unit")
    scale = [F.pow(1.4826 * F.col(f"m{i}"), F.lit(2.0)) for i in range(D)]
    start = spread.select("unit", "centre", F.array(*[scale[i] if i == j else F.lit(0.0) for i in range(D) for j in range(D)]).alias("scatter"))
    half = _settled(rows, start, 0.5)
    scaled = _scaled(rows, half)
    reach = _ranked(rows, scaled).groupBy("unit").agg(F.percentile("bin", F.lit(central)).alias("reach"))
    clean = stored(reach.where(F.expm1(F.col("reach") / 200) <= CUTOFF).select("unit"), "clean")
    wide = _scaled(rows, _settled(rows, half.join(clean, "unit"), central))
    final = wide.unionByName(scaled.join(clean, "unit", "left_anti")).select("unit", "centre", _inverse(F.col("scatter")).alias("inverse"))
    return stored(groups.join(final, "unit").select("lang", "source", "centre", "inverse"), "estimates")


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with a struct ``quality`` of counts, and __lang and __source as text."""
    bounded_batches(docs.sparkSession)
    return docs.withColumns(
        {"quality": text_counts(F.col(text)), "__lang": F.col(lang).cast("string"), "__source": F.col(source).cast("string")}
    )


def statistics(known: DataFrame) -> DataFrame:
    """What ``fit`` takes, from rows of ``measured`` that pass the base rules."""
    return known.where(~base_failed()).select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), vector().alias("x"))


def judged(known: DataFrame, estimates: DataFrame, cutoff: float) -> DataFrame:
    """Rows of ``measured`` with base_failed, distance (null where nothing was fitted) and kept."""
    named = estimates.select(
        F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("centre").alias("__centre"), F.col("inverse").alias("__inverse")
    )
    both = known.join(
        named, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left"
    )
    far = distance(vector(), F.col("__centre"), F.col("__inverse"))
    out = both.withColumns({"base_failed": base_failed(), "distance": far})
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).drop(
        "__l", "__s", "__centre", "__inverse", "__lang", "__source"
    )


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, **names: str) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Texts are counted twice, never shuffled whole."""
    columns = docs.columns
    known = measured(docs, **names)
    return judged(known, fit(statistics(known)), cutoff).where("kept").select(*[f"`{c}`" for c in columns])
