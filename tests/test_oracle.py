"""Every registered query with SQL, run on both engines over whole tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry
from __spark_entry__ import oracle_sql as all_sql, queries as all_queries
from reefpulse.plans.catalog import ORACLES, QUERIES
from tests.compare import difference, duck
from tests.conftest import SF_CHECK, SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, con, name):
    assert difference(QUERIES[name](spark, SF_CHECK), con, ORACLES[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(all_sql()) <= set(all_queries()) and set(QUERIES) <= set(all_queries())


def test_the_rest_imports_without_the_text_package():
    code = (
        "import sys; sys.modules['reefpulse.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
        "from reefpulse.plans.catalog import QUERIES, ORACLES; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0


def test_p_values_are_probabilities(spark):
    rows = QUERIES["test_p_values"](spark, SF_SMALL).collect()
    assert {r.test for r in rows} == {"chi_square", "g", "levene", "rank_sum", "linear_fit"}
    assert all(0 <= r.p_value <= 1 for r in rows)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["year", "monthint", "monthname", "dafm", "no_inds", "no_dets"]
    assert df.count() > 0
