"""Sources of series: CSV files, Parquet tables, and named remote series through a data source.

The remote connectors need a network and a fetch function; ``register_fetcher`` supplies one.
Without it they read ``{root}/{name}.csv`` from a folder, which keeps them usable off line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import DataError
from ..frame import panel

_FETCHERS: dict[str, Callable] = {}


def load_ts_data(spark: SparkSession, path: str, date_col: str = "date", value_col: str = "value") -> DataFrame:
    """A CSV file with a header as one series."""
    rows = spark.read.csv(path, header=True)
    rows = rows.select(F.try_to_timestamp(F.col(date_col)).cast("timestamp_ntz").alias("ts"), F.col(value_col).try_cast("double").alias("v"))
    return panel(rows, "v", "ts")


def register_fetcher(kind: str, fetch: Callable[[str, str | None, str | None], list[tuple[str, float]]]) -> None:
    """``fetch(name, start, end)`` gives (ISO date, value) rows."""
    _FETCHERS[kind] = fetch


class _Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, fetch: Callable, options: dict):
        self.fetch, self.options = fetch, options

    def partitions(self):
        return [_Part(n) for n in self.options["names"].split(",")]

    def read(self, partition):
        for day, value in self.fetch(partition.name, self.options.get("start"), self.options.get("end")):
            yield partition.name, day, float(value)


def remote_source(kind: str, fetch: Callable) -> type[DataSource]:
    """A data source bound to ``fetch``, which travels with it; one input partition a named series."""

    class RemoteSeries(DataSource):
        @classmethod
        def name(cls):
            return f"remote_{kind}"

        def schema(self):
            return "series string, day string, value double"

        def reader(self, schema):
            return _Reader(fetch, dict(self.options))

    return RemoteSeries


def _remote(spark: SparkSession, kind: str, name: str, start: str | None, end: str | None, root: str | None) -> DataFrame:
    if kind in _FETCHERS:
        spark.dataSource.register(remote_source(kind, _FETCHERS[kind]))
        reader = spark.read.format(f"remote_{kind}").option("names", name)
        reader = reader.option("start", start) if start else reader
        rows = (reader.option("end", end) if end else reader).load().select(F.to_timestamp("day").cast("timestamp_ntz").alias("ts"), F.col("value").alias("v"))
    elif root:
        rows = load_ts_data(spark, f"{root}/{name}.csv").select("ts", F.col("value").alias("v"))
    else:
        raise DataError("no network source: register a fetcher or name a folder", {"kind": kind, "name": name})
    for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound:
            rows = rows.filter(keep(F.col("ts"), F.lit(bound).cast("timestamp_ntz")))
    return panel(rows, "v", "ts", F.lit(name))


def load_fred(spark: SparkSession, series_id: str, start: str | None = None, end: str | None = None, root: str | None = None) -> DataFrame:
    return _remote(spark, "fred", series_id, start, end, root)


def load_yahoo(spark: SparkSession, symbol: str, start: str | None = None, end: str | None = None, column: str = "Close", root: str | None = None) -> DataFrame:
    return _remote(spark, "yahoo", f"{symbol}_{column}" if root else symbol, start, end, root)
