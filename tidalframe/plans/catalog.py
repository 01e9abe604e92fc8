"""Registered queries of the engine and the SQL that each is held against.

A query reads whole tables. Floats are rounded to 6 digits on both sides. Queries without SQL
are random, iterative or fitted by a kernel; tests hold them against numpy or brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGSHIP = "backtest_expanding"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0 becomes 0."""
    return df.select(*[(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_graphs, queries_models, queries_series  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)


# Views of the driver tables in SQL, as table e (series_id, t, ts, value).
USERS = "e AS (SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, ts, value FROM events)"
TYPES = "e AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS t, d AS ts, v AS value FROM (SELECT event_type, date_trunc('day', ts) AS d, avg(value) AS v FROM events GROUP BY 1, 2))"
DAYS = "e AS (SELECT '0' AS series_id, row_number() OVER (ORDER BY d) - 1 AS t, d AS ts, v AS value FROM (SELECT o_orderdate AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1))"
MONTHS = "e AS (SELECT o_orderpriority AS series_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS t, m AS ts, v AS value FROM (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2))"
