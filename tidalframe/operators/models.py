"""Sequential models: one numpy kernel a series, run as a grouped map.

A group is one series in one task; series that outgrow a task belong to the closed-form
operators. Rows are sorted by position inside the group, and results keep the panel's keys.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ID, POS, VALUE, WHOLE
from ..kernels import series
from ..kernels.special import normal_two_sided, t_two_sided
from .communities import modularity  # noqa: F401
from .moments import stationarity
from .networks import motifs4, path_lengths  # noqa: F401
from .roles import roles  # noqa: F401

BAND = f"{ID} string, h int, {POS} long, y_pred double, lower double, upper double"


def forecast(df: DataFrame, kernel: Callable[[np.ndarray, int], np.ndarray], fh: int) -> DataFrame:
    """(series_id, h, t, y_pred, lower, upper); a kernel may give forecasts alone."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = series.finite(rows)
        if own.empty:
            return pd.DataFrame(columns=[ID, "h", POS, "y_pred", "lower", "upper"]).astype({"h": int, POS: int})
        out = np.asarray(kernel(own[VALUE].to_numpy(float), fh), float)
        out = np.column_stack([out, np.full((fh, 2), np.nan)]) if out.ndim == 1 else out
        h = np.arange(1, fh + 1)
        return pd.DataFrame({ID: own[ID].iloc[0], "h": h, POS: rows[POS].max() + h, "y_pred": out[:, 0], "lower": out[:, 1], "upper": out[:, 2]})

    return df.select(ID, POS, VALUE).groupBy(ID).applyInPandas(run, BAND)


def kalman(df: DataFrame, fh: int, coverage: float = 0.9, **params: float) -> DataFrame:
    return forecast(df, lambda y, h: series.kalman_trend(y, h, coverage=coverage, **params), fh)


def exponential_smoothing(df: DataFrame, fh: int, trend: str | None = "add", seasonal: str | None = "add", seasonal_periods: int | None = None, coverage: float = 0.9) -> DataFrame:
    return forecast(df, lambda y, h: series.holt_winters(y, h, trend, seasonal, seasonal_periods, coverage), fh)


def arima(df: DataFrame, fh: int, max_p: int = 3, max_d: int = 1, max_q: int = 2, coverage: float = 0.95) -> DataFrame:
    return forecast(df, lambda y, h: series.arima(y, h, max_p, max_d, max_q, coverage)[0], fh)


def bayesian(df: DataFrame, fh: int, model: str = "linear_trend", samples: int = 2000, seed: int = 0, coverage: float = 0.9) -> DataFrame:
    return forecast(df, lambda y, h: series.bayes_forecast(y, h, model, samples, seed, coverage)[0], fh)


def posterior_summary(df: DataFrame, model: str = "linear_trend", samples: int = 2000, seed: int = 0) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = series.finite(rows)
        found = series.bayes_forecast(own[VALUE].to_numpy(float), 1, model, samples, seed)[1]
        return pd.DataFrame({ID: own[ID].iloc[0], "parameter": list(found), "mean": list(found.values())})

    return df.select(ID, POS, VALUE).groupBy(ID).applyInPandas(run, f"{ID} string, parameter string, mean double")


def recurrent(df: DataFrame, fh: int, lookback: int = 12, hidden: int = 64, seed: int = 0) -> DataFrame:
    return forecast(df, lambda y, h: series.reservoir_forecast(y, h, lookback, hidden, seed), fh)


def along(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], out: str = VALUE) -> DataFrame:
    """A column with one number a row from a kernel over the finite values of the series."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = series.finite(rows)
        made = np.asarray(kernel(own[VALUE].to_numpy(float)), float) if len(own) else np.empty(0)
        return pd.DataFrame({ID: own[ID].to_numpy(), POS: own[POS].to_numpy(), "__out": made})

    made = df.select(ID, POS, VALUE).groupBy(ID).applyInPandas(run, f"{ID} string, {POS} long, __out double")
    joined = (df.drop(out) if out == VALUE else df).join(made, [ID, POS], "left" if out != VALUE else "inner")
    return joined.withColumnRenamed("__out", out)


def butterworth(df: DataFrame, cutoff: float = 0.1, order: int = 4, kind: str = "low") -> DataFrame:
    return along(df, lambda y: series.butterworth(y, cutoff, order, kind))


def savitzky_golay(df: DataFrame, window_length: int = 5, polyorder: int = 2) -> DataFrame:
    return along(df, lambda y: series.savgol(y, window_length, polyorder))


def wavelet_denoise(df: DataFrame, level: int = 5, mode: str = "soft") -> DataFrame:
    return along(df, lambda y: series.wavelet_denoise(y, level, mode))


def wavelet_detector(df: DataFrame, level: int = 5, threshold_factor: float = 3.0, threshold: float | None = None) -> DataFrame:
    """Adds score and flag; the default threshold is the 95th percentile of the series' positive scores."""
    rows = along(df, lambda y: series.wavelet_scores(y, level, threshold_factor), "score")
    cut = F.percentile(F.when(F.col("score") > 0, F.col("score")), F.lit(0.95)).over(WHOLE) if threshold is None else F.lit(threshold)
    return rows.withColumn("__c", cut).withColumn("flag", F.coalesce(F.col("score") > F.col("__c"), F.lit(False))).drop("__c")


def pelt_detector(df: DataFrame, penalty: float | None = None, model: str = "l2", min_size: int = 3, jump: int = 1) -> DataFrame:
    """Adds flag at change positions."""

    def flags(y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y))
        out[series.pelt(y, penalty, min_size, jump, model)] = 1
        return out

    rows = along(df, flags, "score")
    return rows.withColumn("flag", F.coalesce(F.col("score") > 0, F.lit(False)))


def bayesian_changepoint(df: DataFrame, expected_segment_length: float = 100.0, threshold: float = 0.5) -> DataFrame:
    rows = along(df, lambda y: series.run_length_changes(y, 1 / expected_segment_length, max(float(y.var()), 1e-6)), "score")
    return rows.withColumn("flag", F.coalesce(F.col("score") > threshold, F.lit(False)))


def remove_outliers_isolation(df: DataFrame, contamination: float = 0.1, window: int = 10, seed: int = 0) -> DataFrame:
    """Drops the most isolated share of rows by value, step and distance to the rolling median."""

    def scores(y: np.ndarray) -> np.ndarray:
        s = pd.Series(y)
        base = s.rolling(window).median().fillna(s.median())
        x = np.column_stack([y, np.diff(y, prepend=y[0]), y - base])
        return series.isolation_scores((x - x.mean(0)) / (x.std(0) + 1e-10), seed=seed)

    rows = along(df, scores, "__s").withColumn("__cut", F.percentile("__s", F.lit(1 - contamination)).over(WHOLE))
    return rows.filter(F.col("__s") <= F.col("__cut")).drop("__s", "__cut")


def is_stationary(df: DataFrame, test: str = "adf", significance: float = 0.05) -> DataFrame:
    rows = stationarity(df, significance)
    if test not in ("adf", "kpss"):
        raise ValueError(f"unknown test {test}")
    return rows.select(ID, (F.col("adf_p") < significance if test == "adf" else F.col("kpss_p") > significance).alias("is_stationary"), F.col(f"{test}_p").alias("p_value"))


def split_half_p(df: DataFrame, significance: float = 0.05) -> DataFrame:
    """The split-half statistics with p-value and verdict."""
    from .stats import split_half_stationarity

    @F.pandas_udf("double")
    def p_value(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(float(x), float(k)) if x == x else float("nan") for x, k in zip(t.astype(float), d.astype(float), strict=True)])

    rows = split_half_stationarity(df).withColumn("p_value", p_value("t_stat", "df"))
    return rows.withColumn("is_stationary", (F.col("p_value") > significance) & F.col("variance_ratio").between(0.5, 2.0))


def surrogates(df: DataFrame, method: str = "shuffle", count: int = 1, seed: int = 0) -> DataFrame:
    """(series_id, surrogate, t, value)"""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, s = series.finite(rows), int(rows["surrogate"].iloc[0])
        return pd.DataFrame({ID: own[ID].to_numpy(), "surrogate": s, POS: own[POS].to_numpy(), VALUE: series.surrogate(own[VALUE].to_numpy(float), method, seed * 1_000_003 + s)})

    many = df.select(ID, POS, VALUE).withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return many.groupBy(ID, "surrogate").applyInPandas(run, f"{ID} string, surrogate int, {POS} long, {VALUE} double")


def metric_significance(df: DataFrame, metric: Callable[[np.ndarray], float], method: str = "shuffle", count: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Observed metric of each series against surrogates, which are spread over tasks."""

    def value(rows: pd.DataFrame) -> pd.DataFrame:
        own, s = series.finite(rows), int(rows["surrogate"].iloc[0])
        y = own[VALUE].to_numpy(float)
        y = y if s < 0 else series.surrogate(y, method, seed * 1_000_003 + s)
        try:
            m = float(metric(y))
        except Exception:  # a surrogate that the metric cannot take is skipped
            m = float("nan")
        return pd.DataFrame({ID: [own[ID].iloc[0]], "surrogate": [s], "m": [m]})

    many = df.select(ID, POS, VALUE).withColumn("surrogate", F.explode(F.sequence(F.lit(-1), F.lit(count - 1))))
    rows = many.groupBy(ID, "surrogate").applyInPandas(value, f"{ID} string, surrogate int, m double")
    null = F.when((F.col("surrogate") >= 0) & ~F.isnan("m"), F.col("m"))
    out = rows.groupBy(ID).agg(F.max(F.when(F.col("surrogate") < 0, F.col("m"))).alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_std"), F.percentile(null, F.lit(0.025)).alias("ci_low"), F.percentile(null, F.lit(0.975)).alias("ci_high"), F.count(null).alias("n_surrogates"))

    @F.pandas_udf("double")
    def p_value(z: pd.Series) -> pd.Series:
        return z.astype(float).map(lambda v: normal_two_sided(v) if v == v else float("nan"))

    out = out.withColumn("z_score", (F.col("observed") - F.col("null_mean")) / F.nullif("null_std", F.lit(0.0))).withColumn("p_value", p_value("z_score"))
    return out.withColumn("significant", F.col("p_value") < alpha)


def bootstrap_intervals(df: DataFrame, kernel: Callable[[np.ndarray, int], np.ndarray], fh: int, count: int = 100, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(series_id, h, y_pred, lower, upper) over refits on rows drawn with replacement, kept in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, b = series.finite(rows), int(rows["b"].iloc[0])
        y = own[VALUE].to_numpy(float)
        drawn = np.sort(np.random.default_rng([seed, b]).integers(0, len(y), len(y)))
        made = np.asarray(kernel(y[drawn], fh), float)
        made = made[:, 0] if made.ndim > 1 else made
        return pd.DataFrame({ID: own[ID].iloc[0], "b": b, "h": range(1, fh + 1), "y": made})

    many = df.select(ID, POS, VALUE).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    rows = many.groupBy(ID, "b").applyInPandas(run, f"{ID} string, b int, h int, y double").filter(~F.isnan("y"))
    side = (1 - confidence) / 2
    return rows.groupBy(ID, "h").agg(F.avg("y").alias("y_pred"), F.percentile("y", F.lit(side)).alias("lower"), F.percentile("y", F.lit(1 - side)).alias("upper"))
