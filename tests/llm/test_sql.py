"""The numbered queries that SQL can express, whole tables on both engines."""

from __future__ import annotations

import pytest

from reefpulse.llm.queries import ORACLES, QUERIES
from tests.compare import difference, duck
from tests.conftest import SF_CHECK, SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, name):
    assert difference(QUERIES[name](spark, SF_CHECK), duck(SF_CHECK), ORACLES[name]) is None


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_queries_run_twice_alike(spark):
    runs = [sorted(map(tuple, QUERIES["op9_source_mix"](spark, SF_SMALL).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
