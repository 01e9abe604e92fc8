"""Every query with SQL against DuckDB on the smallest tables, and plans of the main ones."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def key(row):
    return tuple((v is None, round(float(v), 4) if isinstance(v, (int, float)) else str(v)) for v in row)


def close(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(float(a) - float(b)) <= 2e-4 * max(1, abs(float(a)))
    return str(a) == str(b)


def number(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if v.__class__.__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = entry.catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(number(r[c]) for c in names) for r in df.collect()), key=key)
    cursor = duck.execute(SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    want = sorted((tuple(number(r[k]) for k in at) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_entry(spark):
    rows = entry.entry(spark)
    assert set(rows.columns) >= {"series_id", "fold_id", "mae", "rmse"} and not rows.isEmpty()


def test_features_need_one_sort(spark):
    from tidalframe import frame
    from tidalframe.functions import columns

    made = columns.lags([1, 2]) | columns.rollings([7, 14], ["mean", "std", "min"])
    df = frame.events_by_user(spark, DATA).select("series_id", "t", *[c.alias(n) for n, c in made.items()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(series_id") == 1


def test_scan_reads_needed_columns(spark):
    from tidalframe import frame

    plan = frame.orders_by_day(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan
