"""Cleaning, filling and resampling of panels. All are stateless: bounds come from a table that
may be another one than the filtered (``fitted``), and both sides join on the series id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import ID, POS, TIME, VALUE, WHOLE, W, renumber, trailing

MAD_TO_SIGMA, TINY = 1.4826, 1e-10


def log_transform(df: DataFrame, offset: float = 1.0) -> DataFrame:
    """ln(value + offset); -inf at 0 and NaN below, as floating point has it."""
    x = F.col(VALUE) + offset
    return df.withColumn(VALUE, F.when(x > 0, F.log(x)).when(x == 0, float("-inf")).when(x < 0, float("nan")))


def log_inverse(df: DataFrame, offset: float = 1.0) -> DataFrame:
    return df.withColumn(VALUE, F.exp(VALUE) - offset)


def iqr_bounds(df: DataFrame, factor: float = 1.5) -> DataFrame:
    """(series_id, lower, upper) from interpolated quartiles."""
    q = df.groupBy(ID).agg(F.percentile(VALUE, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.col("q")[1] - F.col("q")[0]
    return q.select(ID, (F.col("q")[0] - factor * spread).alias("lower"), (F.col("q")[1] + factor * spread).alias("upper"))


def remove_outliers_iqr(df: DataFrame, factor: float = 1.5, fitted: DataFrame | None = None) -> DataFrame:
    bounds = iqr_bounds(df if fitted is None else fitted, factor)
    return df.join(bounds, ID).filter(F.col(VALUE).between(F.col("lower"), F.col("upper"))).drop("lower", "upper")


def rolling_baseline(df: DataFrame, window: int) -> DataFrame:
    """Adds ``__base``: trailing median of full windows, the median of the series before that."""
    finite = renumber(df.filter(F.col(VALUE).isNotNull() & (F.abs(VALUE) != float("inf"))))
    return finite.withColumn("__base", F.when(F.row_number().over(W) >= window, F.percentile(VALUE, F.lit(0.5)).over(trailing(window))).otherwise(F.percentile(VALUE, F.lit(0.5)).over(WHOLE)))


def hampel_scores(df: DataFrame, window: int = 10, n_sigma: float = 3.0) -> DataFrame:
    """Adds ``residual`` and ``limit``; values beyond the limit are outliers."""
    rows = rolling_baseline(df, window).withColumn("residual", F.col(VALUE) - F.col("__base"))
    median = rows.groupBy(ID).agg(F.median("residual").alias("__m"), F.median(F.abs(VALUE)).alias("__s"))
    rows = rows.join(median, ID)
    mad = rows.groupBy(ID).agg(F.median(F.abs(F.col("residual") - F.col("__m"))).alias("__mad"))
    limit = F.when(F.col("__mad") < TINY, n_sigma * 0.01 * F.col("__s")).otherwise(n_sigma * MAD_TO_SIGMA * F.col("__mad"))
    return rows.join(mad, ID).withColumn("limit", limit).drop("__m", "__s", "__mad", "__base")


def remove_outliers_hampel(df: DataFrame, window: int = 10, n_sigma: float = 3.0) -> DataFrame:
    return hampel_scores(df, window, n_sigma).filter(F.abs("residual") <= F.col("limit")).drop("residual", "limit")


def zscore_scores(df: DataFrame, window: int = 10, use_log: bool = True) -> DataFrame:
    """Adds ``zscore`` of the residual to the rolling baseline, on the log scale by default."""
    rows = rolling_baseline(df, window)
    if use_log:
        least = F.coalesce(F.min(F.when(F.col(VALUE) > 0, F.col(VALUE))).over(WHOLE), F.lit(1.0))
        residual = F.log(F.greatest(F.col(VALUE), least)) - F.log(F.greatest(F.col("__base"), F.lit(1.0)))
    else:
        residual = F.col(VALUE) - F.col("__base")
    rows = rows.withColumn("__r", residual)
    sd = F.stddev_pop("__r").over(WHOLE)
    return rows.withColumn("zscore", F.when(sd > 0, F.abs((F.col("__r") - F.avg("__r").over(WHOLE)) / F.nullif(sd, F.lit(0.0)))).otherwise(0.0)).drop("__r", "__base")


def remove_outliers_zscore(df: DataFrame, window: int = 10, z_threshold: float = 3.0, use_log: bool = True) -> DataFrame:
    return zscore_scores(df, window, use_log).filter(F.col("zscore") <= z_threshold).drop("zscore")


def detect_anomalies_mad(df: DataFrame, threshold_std: float = 3.0, window: int = 3) -> DataFrame:
    """Adds ``anomaly``: modified z against the window's own median and MAD; false before a full window.

    The deviations of a window are taken from its array, since their centre is the window's.
    """
    full = F.row_number().over(W) >= window
    rows = df.withColumn("__w", F.collect_list(VALUE).over(trailing(window))).withColumn("__m", F.percentile(VALUE, F.lit(0.5)).over(trailing(window))).withColumn("__full", full)
    deviations = F.array_sort(F.transform("__w", lambda x: F.abs(x - F.col("__m"))))
    n = F.size("__w")
    mad = (F.try_element_at(deviations, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(deviations, F.floor(n / 2).cast("int") + 1)) / 2
    z = 0.6745 * F.abs(F.col(VALUE) - F.col("__m")) / F.when(mad == 0, TINY).otherwise(mad)
    return rows.withColumn("anomaly", F.coalesce(F.col("__full") & (n == window) & (z > threshold_std), F.lit(False))).drop("__w", "__m", "__full")


def fill_missing(df: DataFrame, method: str = "forward") -> DataFrame:
    """forward, backward or interpolate (linear by position; the last value holds after the end)."""
    v, valid = F.col(VALUE), F.when(F.col(VALUE).isNotNull(), F.col(POS))
    upto, onward = W.rowsBetween(Window.unboundedPreceding, 0), W.rowsBetween(0, Window.unboundedFollowing)
    before, after = F.last(v, ignorenulls=True).over(upto), F.first(v, ignorenulls=True).over(onward)
    if method == "backward":
        return df.withColumn(VALUE, after)
    if method in ("interpolate", "linear"):
        tb, ta = F.max(valid).over(upto), F.min(valid).over(onward)
        inner = before + (after - before) * (F.col(POS) - tb) / F.nullif(ta - tb, F.lit(0))
        return df.withColumn(VALUE, F.when(v.isNotNull(), v).when(after.isNull(), before).otherwise(inner))
    return df.withColumn(VALUE, before)


UNITS = {"H": ("hour", "interval 1 hour"), "D": ("day", "interval 1 day"), "W": ("week", "interval 7 days"), "M": ("month", "interval 1 month"), "Q": ("quarter", "interval 3 months"), "Y": ("year", "interval 1 year")}


def detect_frequency(df: DataFrame) -> DataFrame:
    """(series_id, freq): the code in H D W M Q Y nearest to the median step; D without two rows."""
    step = (F.unix_micros(F.col(TIME).cast("timestamp")) - F.unix_micros(F.lag(TIME).over(W).cast("timestamp"))) / 3.6e9
    hours = df.withColumn("__h", step).groupBy(ID).agg(F.percentile("__h", F.lit(0.5)).alias("h"))
    h = F.col("h")
    return hours.select(ID, F.when(h.isNull(), "D").when(h < 12, "H").when(h < 96, "D").when(h < 24 * 18, "W").when(h < 24 * 60, "M").when(h < 24 * 200, "Q").otherwise("Y").alias("freq"))


def _unit(freq: str) -> tuple[str, str]:
    if freq not in UNITS:
        raise ValidationError("unknown frequency", {"freq": freq})
    return UNITS[freq]


def calendar(df: DataFrame, freq: str) -> DataFrame:
    """Every period between a series' first and last one."""
    unit, step = _unit(freq)
    ends = df.groupBy(ID).agg(F.date_trunc(unit, F.min(F.col(TIME).cast("timestamp"))).alias("a"), F.date_trunc(unit, F.max(F.col(TIME).cast("timestamp"))).alias("b"))
    return ends.select(ID, F.explode(F.sequence("a", "b", F.expr(step))).alias("__p"))


def fill_missing_dates(df: DataFrame, method: str = "forward", freq: str = "D") -> DataFrame:
    """Rows for missing periods, then ``fill_missing``; a period keeps its last row."""
    unit, _ = _unit(freq)
    rows = df.select(ID, F.date_trunc(unit, F.col(TIME).cast("timestamp")).alias("__p"), POS, VALUE).groupBy(ID, "__p").agg(F.max_by(VALUE, POS).alias(VALUE))
    whole = calendar(df, freq).join(rows, [ID, "__p"], "left").withColumn(TIME, F.col("__p").cast("timestamp_ntz"))
    position = (F.row_number().over(Window.partitionBy(ID).orderBy("__p")) - 1).cast("long")
    return fill_missing(whole.select(ID, position.alias(POS), TIME, VALUE), method)


def resample(df: DataFrame, freq: str = "D", method: str = "mean") -> DataFrame:
    """One row per period, labelled by its start; empty periods are 0 for sums, else null."""
    unit, _ = _unit(freq)
    agg = {"sum": F.sum(VALUE), "last": F.max_by(VALUE, F.when(F.col(VALUE).isNotNull(), F.col(POS))), "first": F.min_by(VALUE, F.when(F.col(VALUE).isNotNull(), F.col(POS)))}.get(method, F.avg(VALUE))
    rows = df.withColumn("__p", F.date_trunc(unit, F.col(TIME).cast("timestamp"))).groupBy(ID, "__p").agg(agg.alias(VALUE))
    whole = calendar(df, freq).join(rows, [ID, "__p"], "left")
    value = F.coalesce(VALUE, F.lit(0.0)) if method == "sum" else F.col(VALUE)
    position = (F.row_number().over(Window.partitionBy(ID).orderBy("__p")) - 1).cast("long")
    return whole.select(ID, position.alias(POS), F.col("__p").cast("timestamp_ntz").alias(TIME), value.alias(VALUE))


def split(df: DataFrame, train_size: float | int | None = None, test_size: float | int | None = None, date_split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) of each series by date, else by test size, else by train size (0.8)."""
    if date_split is not None:
        at = F.lit(date_split).cast("timestamp_ntz")
        return df.filter(F.col(TIME) < at), df.filter(F.col(TIME) >= at)
    n = F.count(F.lit(1)).over(WHOLE)
    if test_size is not None:
        cut = n - (F.floor(n * test_size) if isinstance(test_size, float) else F.lit(test_size))
    else:
        size = 0.8 if train_size is None else train_size
        cut = F.floor(n * size) if isinstance(size, float) else F.lit(size)
    rows = df.withColumn("__cut", cut)
    return rows.filter(F.col(POS) < F.col("__cut")).drop("__cut"), rows.filter(F.col(POS) >= F.col("__cut")).drop("__cut")


def train_test_split(df: DataFrame, test_size: float | int = 0.2, train_size: float | int | None = None, method: str = "time") -> tuple[DataFrame, DataFrame]:
    if method != "time":
        raise ValidationError("only splits by time are known", {"method": method})
    return split(df, train_size=train_size, test_size=test_size)


def coarse_grain(df: DataFrame, scale: int, method: str = "mean") -> DataFrame:
    """Aggregates of full blocks of ``scale`` rows; the tail is dropped."""
    agg = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "std": F.stddev_samp}.get(method)
    if agg is None or scale < 1:
        raise ValidationError("unknown coarse graining", {"method": method, "scale": scale})
    out = df.groupBy(ID, F.floor(F.col(POS) / scale).alias("__b")).agg(F.count(F.lit(1)).alias("__n"), agg(VALUE).alias(VALUE)).filter(F.col("__n") == scale)
    return out.select(ID, F.col("__b").cast("long").alias(POS), VALUE)


def sequences(df: DataFrame, lookback: int = 5, forecast_horizon: int = 1, exogenous: list[str] | None = None) -> DataFrame:
    """Supervised windows: ``x`` (the rows before) and ``y`` (the next rows) at each position."""
    past, ahead = W.rowsBetween(-lookback, -1), W.rowsBetween(0, forecast_horizon - 1)
    out = df.withColumn("x", F.collect_list(VALUE).over(past)).withColumn("y", F.collect_list(VALUE).over(ahead))
    for c in exogenous or []:
        out = out.withColumn(f"x_{c}", F.collect_list(c).over(past))
    return out.filter((F.size("x") == lookback) & (F.size("y") == forecast_horizon)).select(ID, POS, "x", "y", *[f"x_{c}" for c in exogenous or []])


def sliding_windows(df: DataFrame, width: int, by: int = 1, start: int = 0, end: int | None = None) -> DataFrame:
    """(series_id, window, values): full windows of ``width`` rows every ``by`` rows."""
    if width < 1 or by < 1 or start < 0:
        raise ValidationError("bad window", {"width": width, "by": by, "start": start})
    rows = df if end is None else df.filter(F.col(POS) < end)
    out = rows.withColumn("values", F.collect_list(VALUE).over(W.rowsBetween(0, width - 1)))
    out = out.filter((F.col(POS) >= start) & ((F.col(POS) - start) % by == 0) & (F.size("values") == width))
    return out.select(ID, ((F.col(POS) - start) / by).cast("long").alias("window"), "values")
