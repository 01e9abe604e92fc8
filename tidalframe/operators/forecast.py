"""Forecasters in closed form: each is an aggregate of a training table.

``state`` aggregates make one row per group (a series, or a series and a fold), and ``predict``
expands it over the horizon, so that a backtest of any number of folds is one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..errors import ValidationError
from ..frame import ID, POS, VALUE, W

def value() -> Column:
    return F.col(VALUE)


def position() -> Column:
    return F.col(POS)


class ClosedForm:
    """``aggregates(last, count)``: the state columns; ``forecast(h)``: the value h steps ahead.

    ``last`` is the last position of the group and ``count`` its rows, as columns of each row.
    ``running(df, width)`` adds the same state to every row of a panel, for the training set that
    ends with it: the whole past, or the last ``width`` rows.
    """

    def __init__(self, name: str, aggregates: Callable[[Column, Column], dict[str, Column]], forecast: Callable[[Column], Column], running: Callable[[DataFrame, int | None], DataFrame] | None = None):
        self.name, self.aggregates, self.forecast, self.running = name, aggregates, forecast, running

    def fit(self, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
        """State of each group of ``by``; one exchange on ``by`` serves both aggregations."""
        by = by or [ID]
        ends = rows.groupBy(*by).agg(F.max(POS).alias("__last"), F.min(POS).alias("__first"))
        joined = rows.join(ends, by)
        aggs = self.aggregates(F.col("__last"), F.col("__last") - F.col("__first") + 1)
        return joined.groupBy(*by).agg(F.max("__last").alias("last"), F.max("__first").alias("first"), *[c.alias(k) for k, c in aggs.items()])

    def predict(self, state: DataFrame, fh: int | list[int], by: list[str] | None = None) -> DataFrame:
        """(by, h, t, y_pred)"""
        steps = list(range(1, fh + 1)) if isinstance(fh, int) else list(fh)
        out = state.withColumn("h", F.explode(F.array(*[F.lit(h) for h in steps])))
        return out.select(*(by or [ID]), "h", (F.col("last") + F.col("h")).alias(POS), self.forecast(F.col("h")).alias("y_pred"))


def trailing(width: int | None) -> WindowSpec:
    """The training set that ends with a row."""
    return W.rowsBetween(Window.unboundedPreceding if width is None else 1 - width, 0)


def naive() -> ClosedForm:
    return ClosedForm("naive", lambda last, n: {"s": F.max_by(value(), position())}, lambda h: F.col("s"), lambda df, width: df.withColumn("s", value()))


def moving_average(window: int = 7) -> ClosedForm:
    """Mean of the last rows; of all valid rows if those have no value."""
    if window < 1:
        raise ValidationError("window must be positive", {"window": window})

    def running(df: DataFrame, width: int | None) -> DataFrame:
        near = F.avg(value()).over(trailing(window if width is None else min(window, width)))
        return df.withColumn("s", F.coalesce(near, F.avg(value()).over(trailing(width))))

    return ClosedForm(f"sma_{window}", lambda last, n: {"s": F.coalesce(F.avg(F.when(position() > last - window, value())), F.avg(value()))}, lambda h: F.col("s"), running)


def exponential_average(alpha: float = 0.3) -> ClosedForm:
    """Exponentially weighted mean started at the first value, as a weighted sum.

    Over gaps the weights of earlier values decay further and are renormalised.
    """
    if not 0 < alpha <= 1:
        raise ValidationError("alpha must lie in (0, 1]", {"alpha": alpha})
    decay = 1 - alpha

    def aggregates(last: Column, n: Column) -> dict[str, Column]:
        age = (last - position()).cast("double")
        w = F.when(value().isNotNull(), F.pow(F.lit(decay), age) * F.when(position() == F.col("__first"), 1.0).otherwise(alpha))
        return {"s": F.sum(w * value()) / F.nullif(F.sum(w), F.lit(0.0))}

    # Weights fall below rounding within a block, so a row needs the sums of its own block up to
    # it and those of the block before; within a block the powers of the decay stay in range.
    block = max(1, math.ceil(18 / -math.log10(decay))) if decay else 1
    power = lambda k: F.pow(F.lit(decay), k)

    def folded(df: DataFrame, x: Column, out: str, width: int | None) -> DataFrame:
        """Adds at each row the weighted sum of x over its training set."""
        at = F.pmod(position(), F.lit(block)).cast("double")
        same = Window.partitionBy(ID, F.floor(position() / block)).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
        rows = df.withColumn("__x", x).withColumn("__here", F.sum(F.coalesce("__x", F.lit(0.0)) * alpha / power(at)).over(same))
        rows = rows.withColumn("__past", F.last(F.when(at == block - 1, F.col("__here")), True).over(W.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn(out, power(at) * F.col("__here") + power(at + block) * F.coalesce("__past", F.lit(0.0)))
        first, age = F.first("__x").over(trailing(width)), position().cast("double")
        if width is not None:
            age = F.least(age, F.lit(width - 1.0))
            rows = rows.withColumn("__gone", F.lag(out, width).over(W)).withColumn(out, F.col(out) - decay**width * F.coalesce("__gone", F.lit(0.0))).drop("__gone")
        return rows.withColumn(out, F.col(out) + (1 - alpha) * power(age) * F.coalesce(first, F.lit(0.0))).drop("__x", "__here", "__past")

    def running(df: DataFrame, width: int | None) -> DataFrame:
        if not decay:
            return df.withColumn("s", value())
        rows = folded(folded(df, value(), "__a", width), F.when(value().isNotNull(), 1.0), "__b", width)
        # What is left of values that have gone is rounding.
        return rows.withColumn("s", F.when(F.count(value()).over(trailing(width)) > 0, F.col("__a") / F.nullif("__b", F.lit(0.0)))).drop("__a", "__b")

    return ClosedForm("ema", aggregates, lambda h: F.col("s"), running)


def weighted_average(weights: list[float]) -> ClosedForm:
    """Dot product of the last rows with weights, oldest first; weights of gaps are passed on."""
    k, total = len(weights), float(sum(weights))

    def aggregates(last: Column, n: Column) -> dict[str, Column]:
        w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.greatest(F.lit(1), (position() - last + k).cast("int")))
        own = F.when((position() > last - k) & value().isNotNull(), w)
        return {"s": F.sum(own * value()) / F.nullif(F.sum(own), F.lit(0.0)) * total}

    def running(df: DataFrame, width: int | None) -> DataFrame:
        lagged = [(float(weights[k - 1 - j]), F.lag(value(), j).over(W)) for j in range(min(k, width or k))]
        rows = df.select("*", *[c.alias(f"__l{j}") for j, (_, c) in enumerate(lagged)])
        valid = lambda f: sum((F.when(F.col(f"__l{j}").isNotNull(), f(w, F.col(f"__l{j}"))).otherwise(0.0) for j, (w, _) in enumerate(lagged)), F.lit(0.0))
        return rows.withColumn("s", valid(lambda w, x: w * x) / F.nullif(valid(lambda w, x: F.lit(w)), F.lit(0.0)) * total).drop(*[f"__l{j}" for j in range(len(lagged))])

    return ClosedForm("wma", aggregates, lambda h: F.col("s"), running)


def linear_trend(clamp: bool = True) -> ClosedForm:
    """Least squares line over positions from the group's first row, not below 0 if clamped."""

    def aggregates(last: Column, n: Column) -> dict[str, Column]:
        at = (position() - F.col("__first")).cast("double")
        return {"slope": F.regr_slope(value(), at), "intercept": F.regr_intercept(value(), at)}

    def forecast(h: Column) -> Column:
        line = F.col("intercept") + F.col("slope") * (F.col("last") - F.col("first") + h)
        return F.greatest(F.lit(0.0), line) if clamp else line

    def running(df: DataFrame, width: int | None) -> DataFrame:
        at, over = position().cast("double"), trailing(width)
        rows = df.withColumn("slope", F.regr_slope(value(), at).over(over)).withColumn("__c", F.regr_intercept(value(), at).over(over))
        return rows.withColumn("intercept", F.col("__c") + F.col("slope") * F.col("first")).drop("__c")

    return ClosedForm("linear", aggregates, forecast, running)


def synthetic_control_grams(df: DataFrame, treated: str, before: int) -> DataFrame:
    """Products of all control pairs and of each control with the treated series, before treatment."""
    rows = df.filter(F.col(POS) < before)
    controls = rows.filter(F.col(ID) != treated)
    a, b = controls.select(F.col(ID).alias("i"), POS, value().alias("x")), rows.select(F.col(ID).alias("j"), POS, value().alias("z"))
    return a.join(b, POS).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("dot"))


def synthetic_control(df: DataFrame, treated: str, treatment_start: int, pre_period_min: int = 5, iterations: int = 4000) -> tuple[DataFrame, dict[str, float]]:
    """Weights on the simplex that fit the treated series before treatment, applied after it.

    Only the Gram matrix of the controls reaches the driver. Returns (t, y_true, y_pred) after
    the start, and the weights.
    """
    import numpy as np

    if treatment_start < pre_period_min:
        raise ValidationError("too few rows before treatment", {"rows": treatment_start})
    dots = synthetic_control_grams(df, treated, treatment_start).toPandas()
    names = sorted(dots["i"].unique())
    g = dots.pivot(index="i", columns="j", values="dot").loc[names]
    q, c = g[names].to_numpy(float), g[treated].to_numpy(float)
    w, step = np.full(len(names), 1 / len(names)), 1 / max(np.linalg.norm(q, 2), 1e-12)
    y, momentum = w.copy(), 1.0
    for _ in range(iterations):
        z = y - step * (q @ y - c)
        u = np.sort(z)[::-1]
        k = np.flatnonzero(u * np.arange(1, len(u) + 1) > np.cumsum(u) - 1)[-1]
        new = np.maximum(z - (np.cumsum(u)[k] - 1) / (k + 1), 0)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        y, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    weights = dict(zip(names, map(float, w), strict=True))
    table = df.sparkSession.createDataFrame(list(weights.items()), f"{ID} string, w double")
    post = df.filter(F.col(POS) >= treatment_start)
    made = post.join(F.broadcast(table), ID).groupBy(POS).agg(F.sum(F.col("w") * value()).alias("y_pred"))
    return post.filter(F.col(ID) == treated).select(POS, value().alias("y_true")).join(made, POS), weights


def top_controls(weights: dict[str, float], k: int = 5, least: float = 0.01) -> list[tuple[str, float]]:
    return sorted(((n, w) for n, w in weights.items() if w > least), key=lambda x: (-x[1], x[0]))[:k]
