"""Published or hand-made results from outside, for rules that SQL and Spark would otherwise share."""

from __future__ import annotations

import pytest

from reefpulse.operators import distribution
from tests.frames import tuples

# Speeds and stopping distances of 50 cars (Ezekiel 1930), and the published
# local regression of distance on speed at speeds 7 to 25 by the R manual's own example.
SPEED = [4, 4, 7, 7, 8, 9, 10, 10, 10, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14, 15, 15, 15, 16, 16, 17, 17, 17, 18, 18, 18, 18,
         19, 19, 19, 20, 20, 20, 20, 20, 22, 23, 24, 24, 24, 24, 25]
DIST = [2, 10, 4, 22, 16, 10, 18, 26, 34, 17, 28, 14, 20, 24, 28, 26, 34, 34, 46, 26, 36, 60, 80, 20, 26, 54, 32, 40, 32, 40, 50, 42, 56, 76, 84,
        36, 46, 68, 32, 48, 52, 56, 64, 66, 54, 70, 92, 93, 120, 85]
FITTED = {7: 12.50, 8: 15.28, 9: 18.45, 10: 21.87, 11: 25.52, 12: 29.35, 13: 33.23, 14: 37.17, 15: 41.21, 16: 45.06, 17: 48.36, 18: 49.82,
          19: 51.99, 20: 56.46, 22: 68.57, 23: 76.32, 24: 85.21, 25: 95.32}


def test_local_regression_of_the_cars(spark):
    """The published fit interpolates between vertices, this one does not: hence the tolerance."""
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(SPEED, DIST)], "x double, y double")
    rows = distribution.local_regression(df, "y", "x", slots=64).collect()
    fit = {int(r["x"]): [v for k, v in r.asDict().items() if k not in ("x", "n")][0] for r in rows}
    for x, y in FITTED.items():
        assert fit[x] == pytest.approx(y, abs=0.8)


def test_histogram_by_hand(spark):
    """Values 0, 1, ... 29 and both edges of a bin: width 1, bins closed on the right."""
    df = spark.createDataFrame([(float(i),) for i in range(30)] + [(3.5,), (3.4999,), (3.5001,)], "v double")
    got = {c: n for c, n in tuples(distribution.histogram(df, "v"), "center", "n")}
    assert len(got) == 30 and got[3.0] == 3 and got[4.0] == 2 and sum(got.values()) == 33
