"""Registration of queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.catalog.sqlviews import with_views
from rasterlake.catalog.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The SQL as written, before the views are put in front of it: a second form of an operator has the same.
ORACLE_BODIES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its SQL where there is one."""

    def wrap(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_BODIES[name] = sql
            ORACLES[name] = with_views(sql)
        return build

    return wrap


def r6(column, name: str | None = None):
    column = F.col(column) if isinstance(column, str) else column
    out = F.round(column, 6)
    return out.alias(name) if name else out
