"""Named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from reefpulse.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LATER: dict[str, Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Registers a query; ``sql`` may name any of the oracle views.

    A function gives SQL that holds other queries' SQL in full, views and all. It is
    called once every catalog is imported.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if callable(sql):
            LATER[name] = sql
        elif sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 9, **own: int) -> DataFrame:
    """Rounds every double column, so that summation order does not show."""
    return df.select(
        *[
            F.round(F.col(f.name), own.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
