"""What plots show, as small tables; drawing needs matplotlib and is left to ``draw``.

Each table is bounded by an argument (points, bins, paths), so that a plot never collects a series
of unbounded length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ID, POS, TIME, VALUE


def plot_timeseries_data(df: DataFrame, points: int = 1000) -> DataFrame:
    """At most ``points`` averaged points of each series."""
    n = F.count(F.lit(1)).over(Window.partitionBy(ID))
    bucket = F.floor(F.col(POS) * F.lit(points) / F.greatest(n, F.lit(points)))
    return df.withColumn("__b", bucket).groupBy(ID, "__b").agg(F.min(POS).alias(POS), F.min(TIME).alias(TIME), F.avg(VALUE).alias(VALUE)).drop("__b")


def plot_forecast_data(history: DataFrame, forecast: DataFrame, points: int = 1000) -> DataFrame:
    """History and forecast in one table; ``part`` says which."""
    past = plot_timeseries_data(history, points).select(ID, POS, F.lit("history").alias("part"), F.col(VALUE).alias("y"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    band = [F.col(c) if c in forecast.columns else F.lit(None).cast("double").alias(c) for c in ("lower", "upper")]
    return past.unionByName(forecast.select(ID, POS, F.lit("forecast").alias("part"), F.col("y_pred").alias("y"), *band))


def plot_residuals_data(pairs: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of truth less prediction."""
    rows = pairs.select((F.col("y_true") - F.col("y_pred")).alias("r")).filter(F.col("r").isNotNull())
    ends = rows.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("r") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))))
    return rows.join(F.broadcast(ends)).select(F.coalesce(at, F.lit(0)).cast("int").alias("bin"), "lo", "hi").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def plot_multiple_series_data(df: DataFrame, names: list[str]) -> DataFrame:
    """Named series side by side, aligned on time."""
    return df.filter(F.col(ID).isin(names)).groupBy(TIME).pivot(ID, names).agg(F.first(VALUE))


def plot_autocorrelation_data(df: DataFrame, max_lag: int = 40) -> DataFrame:
    from ..operators.stats import autocorrelation_plot_data

    return autocorrelation_plot_data(df, max_lag)


def plot_monte_carlo_data(paths: DataFrame, most: int = 100) -> DataFrame:
    """The first paths, and mean and quantiles of all."""
    from ..operators.simulate import bands

    shown = paths.filter(F.col("sim") < most).select("step", F.concat(F.lit("path "), F.col("sim").cast("string")).alias("line"), F.col("price").alias("y"))
    all_ = bands(paths, ["step"]).select("step", F.explode(F.create_map(*[x for n in ("mean", "p05", "p50", "p95") for x in (F.lit(n), F.col(n))])).alias("line", "y"))
    return shown.unionByName(all_)


def draw(table: DataFrame, x: str, y: str, by: str | None = None, title: str | None = None, path: str | None = None):
    """Lines of a bounded table with matplotlib."""
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("drawing needs matplotlib") from e
    rows, (figure, axis) = table.toPandas().sort_values(x), plt.subplots()
    for name, part in rows.groupby(by) if by else [(y, rows)]:
        axis.plot(part[x], part[y], label=str(name))
    axis.set_title(title or "")
    axis.legend()
    if path:
        figure.savefig(path)
    return figure
