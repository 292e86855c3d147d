from __future__ import annotations

import math
import random

import numpy as np
import pytest

from reefpulse.functions import pvalues
from reefpulse.operators import contingency, distribution, ranks


def _values(spark, pairs):
    return spark.createDataFrame(pairs, "g string, v double")


CASES = {
    "single": [3.0],
    "two": [1.0, 2.0],
    "constant": [5.0] * 9,
    "outlier": [1e12] + [i / 7 for i in range(50)],
    "hot value": [2.5] * 400 + [random.Random(1).uniform(-5, 5) for _ in range(200)],
    "negative": [-3.0, -2.0, -2.0, -1.0, -0.0, 0.0],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("levels", [1, 2, 3])
def test_quantiles_and_ranks(spark, name, levels):
    xs = CASES[name]
    df = _values(spark, [("a", x) for x in xs] + [("a", None)])
    ranked = ranks.running_counts(ranks.value_counts(df, "v"), levels=levels).filter("n > 0").collect()
    assert {r.value: (r.before, r.n) for r in ranked} == {
        x: (sum(y < x for y in xs), sum(y == x for y in xs)) for x in xs
    }
    got = ranks.exact_quantiles(df, "v", (0.0, 0.1, 0.25, 0.5, 0.9, 1.0), ["g"]).first()
    assert list(got)[1:] == pytest.approx(list(np.quantile(xs, (0.0, 0.1, 0.25, 0.5, 0.9, 1.0))))


def test_six_number_counts_nulls_and_keeps_empty_groups(spark):
    df = _values(spark, [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", None), (None, 7.0)])
    got = {r.g: tuple(r)[1:] for r in distribution.six_number(df, "v", ["g"]).collect()}
    assert got["a"] == (1.0, 1.5, 2.0, pytest.approx(7 / 3), 3.0, 4.0, 1)
    assert got["b"] == (None, None, None, None, None, None, 1)
    assert got[None] == (7.0, 7.0, 7.0, 7.0, 7.0, 7.0, 0)


def test_sem_is_missing_with_missing_values(spark):
    df = _values(spark, [("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", 3.0), ("b", None), ("c", 1.0)])
    strict = {r.g: (r.n, r.sem) for r in distribution.sem(df, "v", ["g"]).collect()}
    assert strict == {"a": (2, pytest.approx(1.0)), "b": (3, None), "c": (1, None)}
    loose = {r.g: (r.n, r.sem) for r in distribution.sem(df, "v", ["g"], skip_null=True).collect()}
    assert loose["b"] == (2, pytest.approx(1.0))


def test_histogram_edges(spark):
    df = _values(spark, [("a", x) for x in (39.0, 41.0, 41.1, 43.0, 47.5)])
    got = {r.center: r.n for r in distribution.histogram(df, "v", width=2.0).collect()}
    # 39 sits on the left edge of the first bin and is counted there
    assert got == {40.0: 2, 42.0: 2, 44.0: 0, 46.0: 0, 48.0: 1}
    grouped = _values(spark, [("a", 0.0), ("b", 2.0)])
    assert distribution.histogram(grouped, "v", ["g"], width=1.0).count() == 6


def test_histogram_of_thirty_bins_holds_everything(spark):
    rng = random.Random(2)
    df = _values(spark, [("a", rng.gauss(0, 3)) for _ in range(500)])
    h = distribution.histogram(df, "v").collect()
    assert sum(r.n for r in h) == 500 and 30 <= len(h) <= 31


def test_boxplot(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 30.0, 30.0]
    df = _values(spark, [("a", x) for x in xs])
    r = distribution.boxplot_stats(df, "v", ["g"]).first()
    q1, q3 = np.quantile(xs, (0.25, 0.75))
    keep = [x for x in xs if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    assert (r.lower, r.middle, r.upper, r.ymin, r.ymax) == (q1, 4.0, q3, min(keep), max(keep))
    assert r.outliers == len(xs) - len(keep)


def test_levene(spark):
    rng = random.Random(4)
    data = {g: [round(rng.gauss(0, s), 1) for _ in range(60)] for g, s in (("a", 1), ("b", 2), ("c", 1.5))}
    df = _values(spark, [(g, x) for g, xs in data.items() for x in xs] + [("a", None)])
    z = {g: np.abs(np.array(xs) - np.median(xs)) for g, xs in data.items()}
    every = np.concatenate(list(z.values()))
    between = sum(len(v) * (v.mean() - every.mean()) ** 2 for v in z.values()) / 2
    within = sum(((v - v.mean()) ** 2).sum() for v in z.values()) / (len(every) - 3)
    r = distribution.levene_p(distribution.levene(df, "v", "g")).first()
    assert (r.df1, r.df2) == (2, 177) and r.f == pytest.approx(between / within)
    assert 0 < r.p_value < 1


def test_rank_sum_with_ties(spark):
    rng = random.Random(6)
    a = [float(rng.randrange(8)) for _ in range(70)]
    b = [float(rng.randrange(1, 9)) for _ in range(90)]
    df = _values(spark, [("a", x) for x in a] + [("b", x) for x in b] + [("b", None)])
    w = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n1, n2, n = len(a), len(b), len(a) + len(b)
    ties = sum(t**3 - t for t in ((a + b).count(v) for v in set(a + b)))
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    off = w - n1 * n2 / 2
    r = distribution.rank_sum(df, "v", "g", "a").first()
    assert (r.n1, r.n2, r.w) == (n1, n2, w)
    assert r.z == pytest.approx((off - math.copysign(0.5, off)) / sigma)


def test_linear_fit(spark):
    rng = random.Random(8)
    xs = [rng.randrange(1, 13) for _ in range(80)]
    ys = [3 + 0.4 * x + rng.gauss(0, 1) for x in xs]
    df = spark.createDataFrame([("a", float(x), y) for x, y in zip(xs, ys)] + [("b", 1.0, 2.0), ("b", 1.0, 3.0), ("a", None, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in distribution.linear_fit(df, "y", "x", ["g"]).collect()}
    X = np.column_stack([np.ones(80), xs])
    beta, rss, *_ = np.linalg.lstsq(X, np.array(ys), rcond=None)
    cov = rss[0] / 78 * np.linalg.inv(X.T @ X)
    r = got["a"]
    assert [r.intercept, r.slope] == pytest.approx(list(beta))
    assert [r.se_intercept, r.se_slope] == pytest.approx(list(np.sqrt(np.diag(cov))))
    assert r.f == pytest.approx(r.t_slope**2)
    assert got["b"].n == 2 and got["b"].slope is None and got["b"].se_slope is None


def test_local_regression_matches_weighted_least_squares(spark):
    rng = random.Random(9)
    pts = [(rng.randrange(48) / 2, rng.gauss(0, 1)) for _ in range(300)]
    df = spark.createDataFrame([("a", x, y) for x, y in pts] + [("one", 1.0, 1.0)], "g string, x double, y double")
    got = {(r.g, r.x): r.fitted for r in distribution.local_regression(df, "y", "x", ["g"]).collect()}
    assert got[("one", 1.0)] is None
    x, y = np.array(pts).T
    q = int(0.75 * len(pts))
    for x0 in (0.0, 7.5, 23.5):
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        A = np.column_stack([np.ones_like(x), x - x0, (x - x0) ** 2])
        beta = np.linalg.solve(A.T @ (A * w[:, None]), A.T @ (w * y))
        assert got[("a", x0)] == pytest.approx(beta[0])


def test_local_regression_refuses_values_off_the_grid(spark):
    for bad in (0.25, 24.0, -0.5):
        df = spark.createDataFrame([(bad, 1.0)], "x double, y double")
        with pytest.raises(Exception, match="not on the grid"):
            distribution.local_regression(df, "y", "x").collect()


def _counts(spark, cells):
    return spark.createDataFrame(cells, "r string, c string, n long")


def test_chi_square_with_a_zero_cell(spark):
    t = contingency.contingency_table(_counts(spark, [("x", "in", 10), ("x", "out", 20), ("y", "in", 30), ("z", "out", 5)]), "r", "c", "n", ["in", "out"])
    obs = np.array([[10, 20], [30, 0], [0, 5]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0) / obs.sum()
    r = contingency.with_p(contingency.chi_square(t, ["in", "out"])).first()
    assert r.df == 2 and r.statistic == pytest.approx(((obs - exp) ** 2 / exp).sum())
    g = contingency.g_statistic(t, ["in", "out"]).first()
    with np.errstate(divide="ignore", invalid="ignore"):
        want = 2 * np.nansum(np.where(obs > 0, obs * np.log(obs / exp), 0))
    assert g.statistic == pytest.approx(want)


def test_two_by_two_is_corrected(spark):
    t = contingency.contingency_table(_counts(spark, [("x", "in", 12), ("x", "out", 5), ("y", "in", 7), ("y", "out", 9)]), "r", "c", "n", ["in", "out"])
    obs = np.array([[12, 5], [7, 9]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0) / obs.sum()
    gap = np.abs(obs - exp)
    step = min(0.5, gap.min())
    assert contingency.chi_square(t, ["in", "out"]).first().statistic == pytest.approx(((gap - step) ** 2 / exp).sum())
    plain = contingency.chi_square(t, ["in", "out"], correct=False).first().statistic
    assert plain == pytest.approx((gap**2 / exp).sum())


@pytest.mark.parametrize(
    "got, want",
    [
        (pvalues.chi_square_tail(3.841458820694124, 1), 0.05),
        (pvalues.chi_square_tail(64.00110, 47), 0.05),
        (pvalues.chi_square_tail(9.487729036781154, 4), 0.05),
        (pvalues.normal_two_sided(1.959963984540054), 0.05),
        (pvalues.f_tail(4.964602743730711, 1, 10), 0.05),
        (pvalues.f_tail(2.866081402015993, 4, 20), 0.05),
        (pvalues.chi_square_tail(0.0, 5), 1.0),
    ],
)
def test_tail_probabilities(got, want):
    assert got == pytest.approx(want, rel=1e-5)


def test_missing_statistic_has_no_p(spark):
    df = spark.createDataFrame([(None, 1), (3.841458820694124, 1)], "statistic double, df long")
    got = sorted((r.p_value for r in contingency.with_p(df).collect()), key=repr)
    assert got[0] == pytest.approx(0.05) and (got[1] is None or math.isnan(got[1]))
