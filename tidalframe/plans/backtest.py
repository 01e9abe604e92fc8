"""Backtests by running states: a fold is the row that ends its training set, metrics are one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..frame import ID, POS, VALUE, WHOLE, W
from ..functions import metrics
from ..operators.forecast import ClosedForm


@dataclass
class ExpandingWindowSplit:
    initial_window: int
    step_size: int = 1
    fh: int = 1

    def folds(self, df: DataFrame) -> DataFrame:
        """(series_id, fold_id, start, cutoff): train [start, cutoff), test [cutoff, cutoff + fh)."""
        return _folds(df, self.initial_window, self.step_size, self.fh).withColumn("start", F.lit(0).cast("long"))


@dataclass
class SlidingWindowSplit:
    window_size: int
    step_size: int = 1
    fh: int = 1

    def folds(self, df: DataFrame) -> DataFrame:
        return _folds(df, self.window_size, self.step_size, self.fh).withColumn("start", F.col("cutoff") - self.window_size)


def _folds(df: DataFrame, first: int, step: int, fh: int) -> DataFrame:
    """Series too short for one fold have none."""
    n = df.groupBy(ID).agg((F.max(POS) + 1).alias("n")).filter(F.col("n") >= first + fh)
    cutoffs = n.select(ID, F.posexplode(F.sequence(F.lit(first).cast("long"), F.col("n") - fh, F.lit(step).cast("long"))).alias("fold_id", "cutoff"))
    return cutoffs


def backtest(df: DataFrame, forecaster: ClosedForm, splitter: ExpandingWindowSplit | SlidingWindowSplit) -> DataFrame:
    """(series_id, fold_id, cutoff, h, y_true, y_pred) of all folds of all series.

    Each row carries the forecaster's state for the training set that ends with it and the values
    that follow it, so that folds are rows of one window pass and nothing is copied per fold. A
    forecaster without running states is fitted on a join of the folds with their rows.
    """
    first, width, by = (splitter.initial_window, None, splitter.step_size) if isinstance(splitter, ExpandingWindowSplit) else (splitter.window_size, splitter.window_size, splitter.step_size)
    if forecaster.running is None:
        return _backtest_joined(df, forecaster, splitter)
    start = F.lit(0).cast("long") if width is None else F.greatest(F.col(POS) - (width - 1), F.lit(0)).cast("long")
    rows = df.select(ID, POS, VALUE, F.col(POS).alias("last"), start.alias("first"))
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.lead(VALUE, h).over(W).alias("y_true")) for h in range(1, splitter.fh + 1)])
    rows = forecaster.running(rows, width).withColumn("__ahead", ahead).withColumn("__n", F.max(POS).over(WHOLE) + 1)
    cutoff = F.col(POS) + 1
    folds = rows.filter((cutoff >= first) & ((cutoff - first) % by == 0) & (cutoff + splitter.fh <= F.col("__n")))
    folds = folds.withColumn("fold_id", ((cutoff - first) / by).cast("int")).withColumn("cutoff", cutoff).withColumn("__x", F.explode("__ahead"))
    return folds.select(ID, "fold_id", "cutoff", F.col("__x.h").alias("h"), F.col("__x.y_true").alias("y_true"), forecaster.forecast(F.col("__x.h")).alias("y_pred"))


def _backtest_joined(df: DataFrame, forecaster: ClosedForm, splitter: ExpandingWindowSplit | SlidingWindowSplit) -> DataFrame:
    folds, fh = splitter.folds(df), splitter.fh
    train = df.join(folds, ID).filter((F.col(POS) >= F.col("start")) & (F.col(POS) < F.col("cutoff")))
    by = [ID, "fold_id", "cutoff"]
    state = forecaster.fit(train.select(*by, POS, VALUE), by)
    made = forecaster.predict(state, fh, by)
    return made.join(df.select(ID, POS, F.col(VALUE).alias("y_true")), [ID, POS]).select(*by, "h", "y_true", "y_pred")


def backtest_grouped(df: DataFrame, kernel, splitter: ExpandingWindowSplit | SlidingWindowSplit) -> DataFrame:
    """A backtest of a numpy kernel (values, fh) -> forecasts, one fold a group."""
    import pandas as pd

    folds, fh = splitter.folds(df), splitter.fh
    train = df.join(folds, ID).filter((F.col(POS) >= F.col("start")) & (F.col(POS) < F.col("cutoff"))).select(ID, "fold_id", "cutoff", POS, VALUE)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(POS)
        made = kernel(rows[VALUE].to_numpy(float), fh)
        return pd.DataFrame({ID: rows[ID].iloc[0], "fold_id": rows["fold_id"].iloc[0], "cutoff": rows["cutoff"].iloc[0], "h": range(1, fh + 1), "y_pred": made})

    made = train.groupBy(ID, "fold_id").applyInPandas(run, f"{ID} string, fold_id int, cutoff long, h int, y_pred double")
    made = made.withColumn(POS, F.col("cutoff") + F.col("h") - 1)
    return made.join(df.select(ID, POS, F.col(VALUE).alias("y_true")), [ID, POS]).select(ID, "fold_id", "cutoff", "h", "y_true", "y_pred")


def nested(results: DataFrame) -> DataFrame:
    """One row a fold with arrays of truths and predictions."""
    pairs = F.array_sort(F.collect_list(F.struct("h", "y_true", "y_pred")))
    rows = results.groupBy(ID, "fold_id", "cutoff").agg(pairs.alias("p"))
    return rows.select(ID, "fold_id", "cutoff", F.col("p.h").alias("fh"), F.col("p.y_true").alias("y_true"), F.col("p.y_pred").alias("y_pred"))


def per_fold(results: DataFrame, names: list[str] | None = None) -> DataFrame:
    return metrics.evaluate(results, [ID, "fold_id"], names=names or ["mae", "rmse", "mape"])


def summary(folds: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean and standard deviation of each metric over a series' folds."""
    names = names or ["mae", "rmse", "mape"]
    return folds.groupBy(ID).agg(F.count(F.lit(1)).alias("n_folds"), *[F.avg(m).alias(f"{m}_mean") for m in names], *[F.stddev_samp(m).alias(f"{m}_std") for m in names])


def summarize_backtest(results: DataFrame) -> dict:
    folds = per_fold(results)
    return {"aggregate_metrics": summary(folds), "n_folds": folds.groupBy(ID).count(), "per_fold_metrics": folds}


def default_splitter(df: DataFrame, fh: int) -> ExpandingWindowSplit:
    """Expanding folds that start at 80 % of the shortest series."""
    n = df.groupBy(ID).count().agg(F.min("count")).first()[0]
    if not n:
        raise DataError("no rows to split")
    return ExpandingWindowSplit(max(1, int(n * 0.8)), 1, fh)
