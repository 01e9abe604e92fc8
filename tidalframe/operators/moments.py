"""Models fitted from sums of products: unit-root tests and vector autoregression.

A row of a design is an array; tasks add up the products of its entries, and the sums are shuffled
cell by cell, so no task sees a whole series or panel. What is solved afterwards has the size of
the regressors alone: at most ``MAX_TERMS``, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import ID, POS, VALUE, WHOLE, W
from ..kernels.special import between, normal_quantile
from ..stages import stored

#: Entries of a design's row.
MAX_TERMS = 2000
#: Cells that a task holds before it sends them.
HELD = 4_000_000
# Points of the Dickey-Fuller distribution with a constant, and of the KPSS one for levels.
ADF_POINTS = [(-5.0, 0.0005), (-3.43, 0.01), (-2.862, 0.05), (-2.567, 0.10), (-1.57, 0.50), (-0.44, 0.90), (0.23, 0.975), (2.0, 0.999)]
KPSS_POINTS = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
BAND = f"{ID} string, h int, {POS} long, y_pred double, lower double, upper double"


def products(rows: DataFrame) -> DataFrame:
    """(g, i, j, s, n) of (g, x): sums over rows of x[i] * x[j], i <= j, and how many had both; null entries count in none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> pd.DataFrame:
            out = []
            for g, (s, n) in held.items():
                i, j = np.triu_indices(len(s))
                some = n[i, j] > 0
                out.append(pd.DataFrame({"g": g, "i": i[some], "j": j[some], "s": s[i, j][some], "n": n[i, j][some]}))
            held.clear()
            return pd.concat(out) if out else pd.DataFrame({"g": [], "i": [], "j": [], "s": [], "n": []})

        for part in parts:
            for g, own in part.groupby("g", sort=False)["x"]:
                x = np.array(own.tolist(), float)
                there = ~np.isnan(x)
                x, there = np.where(there, x, 0.0), there.astype(float)
                s, n = x.T @ x, there.T @ there
                if g in held:
                    s, n = s + held[g][0], n + held[g][1]
                held[g] = (s, n)
            if sum(s.size for s, _ in held.values()) > HELD:
                yield sent()
        yield sent()

    cells = rows.select("g", "x").mapInPandas(run, "g string, i int, j int, s double, n double")
    return cells.groupBy("g", "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def square(cells: pd.DataFrame, width: int, what: str = "s") -> np.ndarray:
    out = np.zeros((width, width))
    out[cells["i"], cells["j"]] = out[cells["j"], cells["i"]] = cells[what]
    return out


def _finite(df: DataFrame) -> DataFrame:
    """(g, t, n, y): finite values about their mean, positions dense."""
    v = F.col(VALUE)
    rows = df.filter(v.isNotNull() & (F.abs(v) != float("inf"))).withColumn(POS, (F.row_number().over(W) - 1).cast("long"))
    return rows.select(F.col(ID).alias("g"), F.col(POS).alias("t"), F.count(F.lit(1)).over(WHOLE).alias("n"), (v - F.avg(VALUE).over(WHOLE)).alias("y"))


def unit_roots(df: DataFrame) -> DataFrame:
    """(series_id, adf, adf_p): augmented Dickey-Fuller with a constant, at the lag of the least AIC up to 12 (n / 100) ** 0.25."""
    rows = _finite(df)
    most = F.greatest(F.lit(0), F.least(F.floor(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor((F.col("n") - 1) / 2) - 2)).cast("int")
    width = rows.agg(F.max(most)).first()[0] or 0
    own = Window.partitionBy("g").orderBy("t")
    rows = rows.withColumn("k", most).withColumn("d", F.col("y") - F.lag("y").over(own))
    x = F.array(F.lit(1.0), F.lag("y").over(own), F.col("d"), *[F.lag("d", k).over(own) for k in range(1, width + 1)])
    design = rows.withColumn("x", F.slice(x, F.lit(1), F.col("k") + 3)).filter(F.col("t") > F.col("k")).select("g", "x")

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        m = int(cells["j"].max()) + 1
        g, n, best = square(cells, m), float(cells["n"].max()), None
        for lag in range(m - 2):
            at = [0, 1, *range(3, 3 + lag)]
            size = np.sqrt(np.maximum(np.diag(g)[at], 1e-300))
            inverse = np.linalg.pinv(g[np.ix_(at, at)] / np.outer(size, size)) / np.outer(size, size)
            coef = inverse @ g[at, 2]
            rss = max(g[2, 2] - coef @ g[at, 2], 0.0)
            se = np.sqrt(max(rss / max(1.0, n - len(at)) * inverse[1, 1], 1e-300))
            aic = n * np.log(max(rss / n, 1e-300)) + 2 * len(at)
            if best is None or aic < best[0]:
                best = (aic, coef[1] / se)
        return pd.DataFrame({ID: [cells["g"].iloc[0]], "adf": [best[1]], "adf_p": [between(best[1], ADF_POINTS)]})

    return products(design).groupBy("g").applyInPandas(run, f"{ID} string, adf double, adf_p double")


def level_tests(df: DataFrame) -> DataFrame:
    """(series_id, n, kpss, kpss_p): level stationarity, Bartlett weights over int(4 (n / 100) ** 0.25) lags."""
    rows = _finite(df).withColumn("k", F.floor(4 * F.pow(F.col("n") / 100, F.lit(0.25))).cast("int"))
    width = rows.agg(F.max("k")).first()[0] or 0
    own = Window.partitionBy("g").orderBy("t")
    rows = rows.withColumn("c", F.sum("y").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    lags = [F.lag("y", j).over(own).alias(f"l{j}") for j in range(1, width + 1)]
    weight = lambda j: F.greatest(F.lit(0.0), 1 - j / (F.col("k") + 1))
    spread = F.sum(F.col("y") * F.col("y") + sum((2 * weight(j) * F.coalesce(F.col("y") * F.col(f"l{j}"), F.lit(0.0)) for j in range(1, width + 1)), F.lit(0.0))) / F.max("n")
    stat = F.sum(F.col("c") * F.col("c")) / (F.max("n") * F.max("n") * F.greatest(spread, F.lit(1e-300)))
    out = rows.select("*", *lags).groupBy("g").agg(F.max("n").alias("n"), stat.alias("kpss"))
    p = F.lit(KPSS_POINTS[-1][1])
    for (x0, p0), (x1, p1) in zip(KPSS_POINTS[-2::-1], KPSS_POINTS[:0:-1], strict=True):
        p = F.when(F.col("kpss") <= x1, p0 + (F.col("kpss") - x0) * ((p1 - p0) / (x1 - x0))).otherwise(p)
    return out.select(F.col("g").alias(ID), "n", "kpss", F.when(F.col("kpss") <= KPSS_POINTS[0][0], KPSS_POINTS[0][1]).otherwise(p).alias("kpss_p"))


def stationarity(df: DataFrame, significance: float = 0.05) -> DataFrame:
    """ADF and KPSS of each series and what both say together; series of fewer than 10 values have none."""
    rows = df.select(ID).distinct().join(level_tests(df), ID, "left").join(unit_roots(df), ID, "left")
    enough = F.coalesce(F.col("n") >= 10, F.lit(False))
    one, two = F.col("adf_p") < significance, F.col("kpss_p") > significance
    word = F.when(~enough, "insufficient_data").when(one & two, "stationary").when(~one & ~two, "non_stationary").otherwise("inconclusive")
    return rows.select(ID, *[F.when(enough, F.col(c)).alias(c) for c in ("adf", "adf_p", "kpss", "kpss_p")], word.alias("conclusion"))


def _design(rows: DataFrame) -> DataFrame:
    """(g, x): at each position of a system a constant, the values of its series, and those of 1 to ``top`` positions before."""
    lagged = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("top")))).withColumn("t", F.col("t") + F.col("a"))
    lagged = lagged.filter((F.col("t") >= F.col("first") + F.col("top")) & (F.col("t") <= F.col("last")))
    cells = lagged.groupBy("g", "t").agg(F.max("k").alias("k"), F.max("top").alias("top"), F.map_from_entries(F.collect_list(F.struct((1 + F.col("a") * F.col("k") + F.col("i")).cast("int").alias("c"), F.col("y")))).alias("m"))
    at = F.sequence(F.lit(0), (F.col("k") * (F.col("top") + 1)).cast("int"))
    return cells.select("g", F.transform(at, lambda c: F.when(c == 0, F.lit(1.0)).otherwise(F.try_element_at("m", c))).alias("x"))


def _fit(criterion: str, lag: int | None):
    """The coefficients (constant, then series by lag) and residual spreads of the lag of the least criterion, or of a given one."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        k, top = int(cells["k"].iloc[0]), int(cells["top"].iloc[0])
        width = 1 + k * (top + 1)
        s, n = square(cells, width), square(cells, width, "n")
        m = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        rows, y, best = n[0, 0], list(range(1, k + 1)), None
        for p in [lag] if lag else range(1, top + 1):
            at = [0, *range(k + 1, 1 + k * (p + 1))]
            coef = np.linalg.lstsq(m[np.ix_(at, at)], m[np.ix_(at, y)], rcond=None)[0]
            cov = m[np.ix_(y, y)] - coef.T @ m[np.ix_(at, y)]
            terms, det = k * (k * p + 1), np.linalg.slogdet(cov + 1e-12 * np.eye(k))[1]
            value = {"aic": det + 2 * terms / rows, "bic": det + np.log(rows) * terms / rows, "hqic": det + 2 * np.log(np.log(rows)) * terms / rows, "fpe": det + k * np.log((rows + k * p + 1) / max(1, rows - k * p - 1))}[criterion]
            if best is None or value < best[0]:
                best = (value, p, coef, np.sqrt(np.maximum(np.diag(cov), 0)))
        return pd.DataFrame({"g": [cells["g"].iloc[0]], "lag": [best[1]], "coef": [best[2].ravel()], "spread": [best[3]]})

    return run


def _ahead(fh: int, half: float):
    """Forecasts from the last values of a system's series, newest first; what is missing there counts as the mean."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        lag, k = int(rows["lag"].iloc[0]), len(rows)
        coef, spread = np.array(rows["coef"].iloc[0]).reshape(-1, k), np.array(rows["spread"].iloc[0])
        newest = np.nan_to_num(np.array(rows["newest"].tolist(), float))
        recent, made = [newest[:, a] for a in range(newest.shape[1])], []
        for _ in range(fh):
            made.append(np.concatenate([[1.0], *recent[:lag]]) @ coef)
            recent.insert(0, made[-1])
        out = np.array(made) + rows["mean"].to_numpy()
        differenced = rows["differenced"].iloc[0]
        out = rows["level"].to_numpy() + out.cumsum(axis=0) if differenced else out
        h = np.repeat(np.arange(1, fh + 1), k)
        return pd.DataFrame({ID: np.tile(rows[ID].to_numpy(), fh), "h": h, POS: int(rows["last"].iloc[0]) + h, "y_pred": out.ravel(), "lower": (out - half * spread).ravel(), "upper": (out + half * spread).ravel()})

    return run


def vector_autoregression(df: DataFrame, fh: int, max_lags: int = 10, criterion: str = "aic", coverage: float = 0.9, system: str | None = None, difference: bool | None = None, lag: int | None = None) -> DataFrame:
    """(series_id, h, t, y_pred, lower, upper): the series of a system (all, or equal values of ``system``) as one vector model.

    Series are aligned by position. A gap takes away the products it is part of and nothing else:
    moments are means over the positions where both values exist. The lag has the least
    criterion unless it is given. A system is differenced if a unit root of one of its series is
    not rejected at 0.05, or by ``difference``.
    """
    if criterion not in ("aic", "bic", "hqic", "fpe"):
        raise ValidationError("unknown criterion", {"criterion": criterion})
    rows = df.select((F.col(system) if system else F.lit("all")).cast("string").alias("g"), ID, POS, VALUE)
    ids = rows.select("g", ID).distinct()
    names = Window.partitionBy("g")
    ids = ids.withColumn("i", F.row_number().over(names.orderBy(ID)) - 1).withColumn("k", F.count(F.lit(1)).over(names))
    widest = ids.agg(F.max("k")).first()[0] or 0
    if 1 + widest * ((lag or 1) + 1) > MAX_TERMS:
        raise ValidationError("too many series for one system", {"series": widest, "terms": MAX_TERMS})
    if difference is None:
        roots = ids.join(unit_roots(df), ID).groupBy("g").agg(F.coalesce(F.bool_or(F.col("adf_p") > 0.05), F.lit(False)).alias("differenced"))
    else:
        roots = ids.select("g").distinct().withColumn("differenced", F.lit(difference))
    level = rows.groupBy("g", ID).agg(F.max_by(VALUE, F.when(F.col(VALUE).isNotNull(), F.col(POS))).alias("level"))
    rows = rows.join(ids, ["g", ID]).join(roots, "g")
    step = F.col(VALUE) - F.lag(VALUE).over(Window.partitionBy("g", ID).orderBy(POS))
    rows = rows.withColumn("y", F.when(F.col("differenced"), step).otherwise(F.col(VALUE))).filter(F.col("y").isNotNull())
    about = rows.groupBy("g", ID).agg(F.avg("y").alias("mean"))
    spans = rows.groupBy("g").agg(F.min(POS).alias("first"), F.max(POS).alias("last"), F.max("k").alias("sk"))
    most = F.lit(lag) if lag else F.least(F.lit(max_lags), F.floor((F.col("last") - F.col("first") - 1) / (F.col("sk") + 1)) - 1, F.floor((MAX_TERMS - 1) / F.col("sk")) - 1)
    spans = spans.withColumn("top", F.greatest(F.lit(1), most).cast("int")).drop("sk")
    rows = stored(rows.join(about, ["g", ID]).join(spans, "g").select("g", ID, F.col(POS).alias("t"), "i", "k", (F.col("y") - F.col("mean")).alias("y"), "mean", "first", "last", "top", "differenced"))
    fitted = products(_design(rows)).join(rows.select("g", "k", "top").distinct(), "g").groupBy("g").applyInPandas(_fit(criterion, lag), "g string, lag int, coef array<double>, spread array<double>")
    recent = rows.filter(F.col("t") > F.col("last") - F.col("top")).groupBy("g", ID).agg(F.map_from_entries(F.collect_list(F.struct((F.col("last") - F.col("t")).cast("int").alias("a"), "y"))).alias("m"))
    state = rows.select("g", ID, "i", "mean", "last", "top", "differenced").distinct().join(recent, ["g", ID], "left").join(level, ["g", ID])
    newest = F.transform(F.sequence(F.lit(0), F.col("top") - 1), lambda a: F.try_element_at(F.coalesce("m", F.create_map().cast("map<int,double>")), a))
    state = state.withColumn("newest", newest).drop("m", "top").join(fitted, "g")
    return state.groupBy("g").applyInPandas(_ahead(fh, normal_quantile(0.5 + coverage / 2)), BAND)
