"""Detectors: each adds ``score`` and ``flag`` to the rows of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import ID, POS, TIME, VALUE, WHOLE, W

def value() -> Column:
    return F.col(VALUE)


def position() -> Column:
    return F.col(POS)


def seasonal_key(seasonality: str) -> Column:
    keys = {"week": F.weekofyear(TIME), "month": F.month(TIME), "day": F.dayofyear(TIME), "dayofyear": F.dayofyear(TIME), "hour": F.hour(TIME)}
    if seasonality not in keys:
        raise ValidationError("unknown seasonality", {"seasonality": seasonality})
    return keys[seasonality]


def seasonal_baseline(df: DataFrame, seasonality: str = "week", threshold_sigma: float = 2.5, fitted: DataFrame | None = None) -> DataFrame:
    """abs(value - mean) / std of the seasonal key; std 0 or of one row counts as 1, an unseen key scores 0."""
    base = df if fitted is None else fitted
    spread = F.stddev_samp(value())
    stats = base.groupBy(ID, seasonal_key(seasonality).alias("__k")).agg(F.avg(value()).alias("__mean"), F.when(spread > 0, spread).otherwise(1.0).alias("__std"))
    rows = df.withColumn("__k", seasonal_key(seasonality)).join(stats, [ID, "__k"], "left")
    score = F.coalesce(F.abs(value() - F.col("__mean")) / F.col("__std"), F.lit(0.0))
    return rows.withColumn("score", score).withColumn("flag", F.col("score") > threshold_sigma).drop("__k", "__mean", "__std")


def mean_shift(df: DataFrame, window: int = 10, threshold: float = 3.0) -> DataFrame:
    """Two-window mean shift: z of the means before and after each row, then a greedy skip.

    A row in [window, n - window) above the threshold is flagged and the next ``window`` rows
    are skipped; the skip is a fold over the sorted candidates of a series.
    """
    before, after = W.rowsBetween(-window, -1), W.rowsBetween(0, window - 1)
    n = F.count(F.lit(1)).over(WHOLE)
    spread = F.sqrt((F.pow(F.stddev_pop(value()).over(before), 2) + F.pow(F.stddev_pop(value()).over(after), 2)) / 2 + 1e-10)
    z = F.abs(F.avg(value()).over(before) - F.avg(value()).over(after)) / spread
    rows = df.withColumn("score", F.when((position() >= window) & (position() < n - window), z))
    hits = rows.filter(F.col("score") > threshold).groupBy(ID).agg(F.array_sort(F.collect_list(POS)).alias("__h"))
    fold = F.aggregate("__h", F.array().cast("array<bigint>"), lambda a, p: F.when((F.size(a) == 0) | (p >= F.element_at(a, -1) + window), F.concat(a, F.array(p))).otherwise(a))
    kept = hits.select(ID, F.explode(fold).alias(POS)).withColumn("flag", F.lit(True))
    return rows.join(kept, [ID, POS], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def cusum(df: DataFrame, drift: float = 0.5, threshold: float = 5.0) -> DataFrame:
    """Cumulative sums of standardised deviations above and below the drift.

    max(0, s + x) unrolled: a running sum less its running minimum, so two windows do.
    """
    sd = F.stddev_pop(value()).over(WHOLE)
    z = (value() - F.avg(value()).over(WHOLE)) / F.when(sd > 0, sd).otherwise(1.0)
    run = W.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__z", z).withColumn("__up", F.sum(F.col("__z") - drift).over(run)).withColumn("__dn", F.sum(-F.col("__z") - drift).over(run))
    up, down = F.col("__up") - F.least(F.lit(0.0), F.min("__up").over(run)), F.col("__dn") - F.least(F.lit(0.0), F.min("__dn").over(run))
    return rows.withColumn("score", F.greatest(up, down)).withColumn("flag", F.col("score") > threshold).drop("__z", "__up", "__dn")


def vote(df: DataFrame, flags: list[str], threshold: int = 2) -> DataFrame:
    """score: how many flag columns are true; flag: at least ``threshold``."""
    score = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in flags[1:]), F.coalesce(F.col(flags[0]), F.lit(False)).cast("int"))
    return df.withColumn("score", score).withColumn("flag", F.col("score") >= threshold)


def median_filter(df: DataFrame, size: int) -> DataFrame:
    """Centred running median (even sizes reach one further back), the ends reflected."""
    before, after = size // 2, size - 1 - size // 2
    window = F.collect_list(value()).over(W.rowsBetween(-before, after))
    n = F.count(F.lit(1)).over(WHOLE)
    rows = df.withColumn("__w", window).withColumn("__n", n)
    edge = df.withColumn("__n", n).filter((position() < size) | (position() >= F.col("__n") - size)).groupBy(ID).agg(F.map_from_entries(F.collect_list(F.struct(position().alias("k"), value().alias("v")))).alias("__edge"))
    rows = rows.join(edge, ID)
    low = F.when(position() < before, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (before - position()).cast("int"))), lambda k: F.try_element_at("__edge", (k - 1).cast("long")))).otherwise(F.array().cast("array<double>"))
    over = (position() + after - F.col("__n") + 1).cast("int")
    high = F.when(over > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), over)), lambda k: F.try_element_at("__edge", (F.col("__n") - k).cast("long")))).otherwise(F.array().cast("array<double>"))
    whole = F.array_sort(F.concat("__w", low, high))
    return rows.withColumn(VALUE, F.element_at(whole, size // 2 + 1)).drop("__w", "__n", "__edge")


def preprocess_for_changepoint(df: DataFrame, median_window: int = 5, detrend_window: int = 100) -> DataFrame:
    """Median filter, then, for series longer than the window, less a long median plus the global one."""
    smooth = median_filter(df, median_window)
    long = median_filter(smooth, detrend_window).select(ID, POS, F.col(VALUE).alias("__long"))
    n, middle = F.count(F.lit(1)).over(WHOLE), F.percentile(value(), F.lit(0.5)).over(WHOLE)
    rows = smooth.withColumn("__n", n).withColumn("__m", middle).join(long, [ID, POS])
    return rows.withColumn(VALUE, F.when(F.col("__n") > detrend_window, value() - F.col("__long") + F.col("__m")).otherwise(value())).drop("__n", "__m", "__long")
