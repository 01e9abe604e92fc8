"""Simulated paths. Noise is a function of (seed, simulation, step), so that repartitioning or a
recomputed task gives the same paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import ID, POS, VALUE, W


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box-Muller from two hashes of the keys."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * math.pi * unit(1))


def geometric_paths(spark: SparkSession, initial: float, mu: float, sigma: float, days: int, simulations: int = 1000, seed: int = 0) -> DataFrame:
    """(sim, step, price): step 0 is the initial price; every path is one window."""
    grid = spark.range(simulations).withColumnRenamed("id", "sim").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    shock = F.when(F.col("step") > 0, F.lit(mu) + F.lit(sigma) * normal(seed, F.col("sim"), F.col("step"))).otherwise(0.0)
    total = F.sum(shock).over(Window.partitionBy("sim").orderBy("step"))
    return grid.withColumn("price", F.lit(initial) * F.exp(total))


def return_statistics(df: DataFrame) -> DataFrame:
    """(series_id, spot, drift, volatility) from log returns."""
    before = F.lag(VALUE).over(W)
    rows = df.withColumn("__r", F.when((before > 0) & (F.col(VALUE) > 0), F.log(F.col(VALUE) / F.nullif(before, F.lit(0.0)))))
    g = rows.groupBy(ID).agg(F.max_by(VALUE, POS).alias("spot"), F.avg("__r").alias("m"), F.var_samp("__r").alias("v"), F.count("__r").alias("n")).filter(F.col("n") >= 2)
    return g.select(ID, "spot", (F.col("m") - 0.5 * F.col("v")).alias("drift"), F.sqrt("v").alias("volatility"))


def black_scholes(df: DataFrame, fh: int, simulations: int = 1000, seed: int = 0) -> DataFrame:
    """(series_id, sim, h, price): h = 1 is the spot price."""
    grid = return_statistics(df).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(fh))))
    shock = F.when(F.col("h") > 1, F.col("drift") + F.col("volatility") * normal(seed, F.col(ID), F.col("sim"), F.col("h"))).otherwise(0.0)
    return grid.withColumn("price", F.col("spot") * F.exp(F.sum(shock).over(Window.partitionBy(ID, "sim").orderBy("h")))).select(ID, "sim", "h", "price")


def bands(paths: DataFrame, by: list[str], value: str = "price") -> DataFrame:
    """Mean, spread and the 5, 25, 50, 75, 95 % quantiles of the simulations of each step."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = paths.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q"))
    return out.select(*by, "mean", "std", *[F.col("q")[k].alias(n) for k, n in enumerate(("p05", "p25", "p50", "p75", "p95"))])


def interval(paths: DataFrame, by: list[str], coverage: float, value: str = "price") -> DataFrame:
    """Mean of the simulations of each step, and the quantiles between which ``coverage`` of them lie."""
    q = F.percentile(value, F.array(F.lit((1 - coverage) / 2), F.lit((1 + coverage) / 2)))
    out = paths.groupBy(*by).agg(F.avg(value).alias("y_pred"), q.alias("q"))
    return out.select(*by, "y_pred", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def monte_carlo(df: DataFrame, forecasts: DataFrame, n_samples: int = 1000, noise_level: float | None = None, seed: int = 0) -> DataFrame:
    """Quantiles of ``noisy`` forecasts; all equal without noise."""
    return bands(noisy(df, forecasts, n_samples, noise_level, seed), [ID, "h"])


def noisy(df: DataFrame, forecasts: DataFrame, n_samples: int = 1000, noise_level: float | None = None, seed: int = 0) -> DataFrame:
    """Forecasts with noise of ``noise_level`` population deviations of the series, one row (price) a sample."""
    spread = df.groupBy(ID).agg(F.stddev_pop(VALUE).alias("__sd"))
    many = forecasts.join(spread, ID).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    noise = F.lit(noise_level or 0.0) * F.col("__sd") * normal(seed, F.col(ID), F.col("sim"), F.col("h"))
    return many.withColumn("price", F.col("y_pred") + noise)
