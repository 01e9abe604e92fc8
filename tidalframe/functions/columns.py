"""Column builders over one (series, t) order; columns that share it need one sort.

Each returns ``{name: Column}``, so featurizers are joined by merging dictionaries and the
whole feature table is one ``select`` with one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..frame import POS, TIME, VALUE, W, trailing

def value() -> Column:
    return F.col(VALUE)

INF = float("inf")


def lag_column(k: int, c: Column | None = None) -> Column:
    c = value() if c is None else c
    return F.lag(c, k).over(W) if k > 0 else F.lead(c, -k).over(W) if k < 0 else c


def lags(ks: list[int], diff: bool = False, pct: bool = False, seasonal: list[int] | None = None, prevent_leads: bool = True) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for k in ks:
        if prevent_leads and k <= 0:
            continue
        before = lag_column(k)
        out[f"lag_{k}"] = before
        if diff:
            out[f"diff_{k}"] = value() - before
        if pct:
            out[f"pct_change_{k}"] = F.when(before != 0, (value() - before) / F.nullif(before, F.lit(0.0)))
    for k in seasonal or []:
        out[f"seasonal_lag_{k}"] = lag_column(k)
    return out


def full(n: int) -> Column:
    """The trailing window of n rows is full."""
    return F.row_number().over(W) >= n


def rolling(func: str, n: int, min_periods: int = 1) -> Column:
    """Trailing statistics. Mean and std honour ``min_periods``; the others need a full window."""
    w = trailing(n)
    if func == "mean":
        return F.when(full(min_periods), F.avg(value()).over(w)) if min_periods > 1 else F.avg(value()).over(w)
    if func == "std":
        return F.coalesce(F.stddev_samp(value()).over(w), F.lit(0.0))
    inner = {"min": F.min(value()), "max": F.max(value()), "median": F.percentile(value(), F.lit(0.5)), "sum": F.sum(value())}[func]
    return F.when(full(n), inner.over(w))


def rollings(windows: list[int], functions: list[str]) -> dict[str, Column]:
    known = ("mean", "std", "min", "max", "median")
    return {f"rolling_{f}_{n}": rolling(f, n) for n in windows for f in functions if f in known}


def calendar() -> dict[str, Column]:
    ts = F.col(TIME)
    weekday = F.weekday(ts)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "dayofweek": weekday,
        "dayofyear": F.dayofyear(ts),
        "week": F.weekofyear(ts),
        "quarter": F.quarter(ts),
        "hour": F.hour(ts),
        "is_weekend": weekday >= 5,
        "is_month_start": F.dayofmonth(ts) == 1,
        "is_month_end": F.to_date(ts) == F.last_day(ts),
    }


def differences(orders: list[int]) -> dict[str, Column]:
    """k-th order differences: binomial sums of lags, all over the same window."""
    out = {}
    for k in orders:
        terms = [(-1) ** j * math.comb(k, j) * lag_column(j) for j in range(k + 1)]
        out[f"diff_{k}"] = sum(terms[1:], terms[0])
    return out


def fourier(periods: list[float]) -> dict[str, Column]:
    out = {}
    for p in periods:
        angle = 2 * math.pi * F.col(POS) / p
        out[f"seasonal_sin_{p}"], out[f"seasonal_cos_{p}"] = F.sin(angle), F.cos(angle)
    return out


def filled_forward() -> Column:
    return F.last(value(), ignorenulls=True).over(W.rowsBetween(Window.unboundedPreceding, 0))


def degradation(periods: list[int], filled: str = "__filled") -> dict[str, Column]:
    """Relative change over k rows of the forward-filled column; a previous 0 gives infinity."""
    out = {}
    for k in periods:
        now, before = F.col(filled), F.lag(filled, k).over(W)
        zero = F.when(now > 0, INF).when(now < 0, -INF)
        out[f"degradation_rate_{k}"] = F.when(before == 0, zero).otherwise(now / F.nullif(before, F.lit(0.0)) - 1)
    return out


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation as an aggregate; null if one side is constant, where ``corr`` divides by zero under ANSI rules."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
