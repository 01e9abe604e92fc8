"""Accuracy metrics as aggregate expressions over two columns (truth, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(*cs: Column) -> Column:
    ok = F.lit(True)
    for c in cs:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok


def mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p))


def rmse(t: Column, p: Column) -> Column:
    return F.sqrt(F.avg((t - p) * (t - p)))


def mape(t: Column, p: Column) -> Column:
    """Rows with truth 0 are left out; null when none is left."""
    return F.avg(F.when(t != 0, F.abs((t - p) / F.nullif(t, F.lit(0.0))))) * 100


def bias(t: Column, p: Column) -> Column:
    return F.avg(F.when(_finite(t, p), p - t))


def ubrmse(t: Column, p: Column) -> Column:
    return F.stddev_pop(F.when(_finite(t, p), p - t))


def smape(t: Column, p: Column) -> Column:
    size = (F.abs(t) + F.abs(p)) / 2
    return F.avg(F.when(size > 0, F.abs(p - t) / F.nullif(size, F.lit(0.0)))) * 100


def r2_score(t: Column, p: Column) -> Column:
    residual, total = F.sum((t - p) * (t - p)), F.count(t) * F.var_pop(t)
    return F.when(total > 0, 1 - residual / F.nullif(total, F.lit(0.0))).when(residual == 0, 1.0).otherwise(0.0)


ALL = {"mae": mae, "rmse": rmse, "mape": mape, "bias": bias, "ubrmse": ubrmse, "smape": smape, "r2": r2_score}


def evaluate(df: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred", names: list[str] | None = None) -> DataFrame:
    """All metrics of each group in one aggregation; rows without truth or prediction are left out."""
    pairs = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    aggs = [ALL[m](F.col(truth), F.col(pred)).alias(m) for m in names or ALL]
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)


def compare_models(actual: DataFrame, forecasts: DataFrame, on: list[str], model: str = "model") -> DataFrame:
    """Forecasts (model, keys, y_pred) against truths (keys, y_true), best RMSE first."""
    joined = forecasts.join(actual, on)
    return evaluate(joined, [model], names=["mae", "rmse", "mape", "r2"]).orderBy("rmse", model)


def best_model(metrics: DataFrame, by: str = "rmse", model: str = "model") -> DataFrame:
    """The row of the best model: largest r2, smallest of any other metric."""
    return metrics.orderBy(F.desc(by) if by == "r2" else F.asc(by), model).limit(1)
