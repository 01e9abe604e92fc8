"""The canonical panel: rows (series_id STRING, t LONG, ts TIMESTAMP, value DOUBLE).

A panel holds any number of series; a single series is a panel with one id. ``t`` is the
0-based position in (ts, tie) order and is made once, at ingestion; all operators use it as a
total order. NaN becomes NULL on ingestion, so that aggregates skip it.

Windows are partitioned by series. A series is one partition of a window; its rows spill to
disk when they outgrow memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.window import WindowSpec

from .errors import ValidationError

ID, POS, TIME, VALUE = "series_id", "t", "ts", "value"


class LazyWindow(WindowSpec):
    """A window made on first use: modules are also imported by Python workers, without a session."""

    def __new__(cls, *order: str):
        return object.__new__(cls)

    def __init__(self, *order: str):
        self._order = order

    @property
    def _jspec(self):
        w = Window.partitionBy(ID)
        return (w.orderBy(*self._order) if self._order else w)._jspec

    def rowsBetween(self, start: int, end: int) -> WindowSpec:
        return Window.partitionBy(ID).orderBy(*self._order).rowsBetween(start, end)


W, WHOLE = LazyWindow(POS), LazyWindow()
NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)


def trailing(n: int):
    return W.rowsBetween(-(n - 1), 0)


def clean_number(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def panel(df: DataFrame, value: str, ts: str | None = None, series: str | Column | None = None, tie: list[str] | None = None, dedupe: bool = False) -> DataFrame:
    """A canonical panel from any table. ``dedupe`` keeps one row of each (series, ts)."""
    key = F.lit("0") if series is None else (F.col(series) if isinstance(series, str) else series).cast("string")
    order = [F.col(c) for c in ([ts] if ts else []) + (tie or [])]
    out = df.select(key.alias(ID), (F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")).alias(TIME), clean_number(F.col(value)).alias(VALUE), *[c.alias(f"__o{k}") for k, c in enumerate(order)])
    if dedupe:
        out = out.dropDuplicates([ID, TIME])
    position = F.row_number().over(Window.partitionBy(ID).orderBy(*[f"__o{k}" for k in range(len(order))])) - 1
    return out.select(ID, position.cast("long").alias(POS), TIME, VALUE)


def renumber(df: DataFrame) -> DataFrame:
    """Positions made dense again after a filter."""
    return df.withColumn(POS, (F.row_number().over(W) - 1).cast("long"))


def is_series(df: DataFrame) -> bool:
    f = {x.name: x.dataType for x in df.schema}
    return isinstance(f.get(VALUE), NUMERIC) and (POS in f or TIME in f)


def is_panel(df: DataFrame) -> bool:
    return is_series(df) and ID in df.columns


def is_table(df: DataFrame) -> bool:
    return TIME in df.columns or POS in df.columns


def assert_series(df: DataFrame, name: str = "data") -> None:
    if not is_series(df):
        raise ValidationError(f"{name} is no series", {"columns": df.columns})


def assert_panel(df: DataFrame, name: str = "data") -> None:
    if not is_panel(df):
        raise ValidationError(f"{name} is no panel", {"columns": df.columns})


def assert_table(df: DataFrame, name: str = "data") -> None:
    if not is_table(df):
        raise ValidationError(f"{name} is no table", {"columns": df.columns})


def validate_input(df: DataFrame | None, scitype: str, name: str = "data", allow_none: bool = False) -> None:
    checks = {"series": assert_series, "panel": assert_panel, "table": assert_table}
    if df is None:
        if not allow_none:
            raise ValidationError(f"{name} is missing")
        return
    if scitype not in checks:
        raise ValidationError("unknown kind of data", {"scitype": scitype})
    checks[scitype](df, name)


def to_series(df: DataFrame) -> DataFrame:
    """The one value column of a table, as a panel column."""
    own = [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in (POS,)]
    if VALUE in df.columns:
        return df.select(*[c for c in (ID, POS, TIME) if c in df.columns], VALUE)
    if len(own) != 1:
        raise ValidationError("one value column is needed", {"columns": own})
    return df.select(*[c for c in (ID, POS, TIME) if c in df.columns], F.col(own[0]).cast("double").alias(VALUE))


def to_dataframe(df: DataFrame) -> DataFrame:
    return df


def ensure_series_like(df: DataFrame) -> DataFrame:
    out = to_series(df)
    assert_series(out)
    return out


def ensure_panel_like(df: DataFrame) -> DataFrame:
    assert_panel(df)
    return df


def ensure_datetime_index(df: DataFrame, ts: str = TIME) -> DataFrame:
    """``ts`` read as a timestamp where possible; unchanged if no row can be read."""
    if isinstance(df.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType)):
        return df
    cast = df.withColumn(ts, F.try_to_timestamp(F.col(ts).cast("string")).cast("timestamp_ntz"))
    return df if cast.filter(F.col(ts).isNotNull()).isEmpty() else cast


def validate_data_quality(df: DataFrame, min_length: int = 1, allow_all_nan: bool = False, allow_all_zero: bool = True, name: str = "data") -> None:
    from .errors import DataError

    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(VALUE).alias("valid"), F.bool_and(F.col(VALUE) == 0).alias("zero")).first()
    if row["n"] < min_length:
        raise DataError(f"{name} is too short", {"rows": row["n"], "needed": min_length})
    if not allow_all_nan and row["valid"] == 0:
        raise DataError(f"{name} has no values")
    if not allow_all_zero and row["zero"]:
        raise DataError(f"{name} is all zero")


def validate_forecast_horizon(fh, max_horizon: int | None = None, name: str = "forecast_horizon") -> list[int]:
    steps = [fh] if isinstance(fh, int) else list(fh)
    if not steps or any(not isinstance(h, int) or isinstance(h, bool) or h <= 0 for h in steps):
        raise ValidationError(f"{name} must be positive integers", {"value": fh})
    if max_horizon is not None and max(steps) > max_horizon:
        raise ValidationError(f"{name} exceeds {max_horizon}", {"value": fh})
    return steps


def check_data_alignment(y: DataFrame, x: DataFrame, name_y: str = "y", name_x: str = "X") -> None:
    a, b = y.select(ID, POS), x.select(ID, POS)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValidationError(f"{name_y} and {name_x} have different positions")


# Views of the driver tables.


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "ts", "user_id", ["event_id"])


def events_by_type_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = e.groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.avg("value").alias("v"))
    return panel(daily, "v", "day", "event_type")


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return panel(o.groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("v")), "v", "o_orderdate")


def orders_by_priority_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("m")
    return panel(o.groupBy("o_orderpriority", month).agg(F.sum("o_totalprice").alias("v")), "v", "m", "o_orderpriority")
