"""Autocorrelation, trend, seasonality, decomposition, climatology and stationarity of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import ID, POS, TIME, VALUE, WHOLE, W
from ..functions.columns import correlation
from . import slopes


def value() -> Column:
    return F.col(VALUE)


def position() -> Column:
    return F.col(POS)


def autocorrelation(df: DataFrame, max_lag: int) -> DataFrame:
    """(series_id, lag, acf): lags 0..max_lag with n * var_pop below; a constant series gives 1, 0, 0, ...

    All lagged products are sums of window columns over one sort, so that no pair is joined.
    """
    rows = df.withColumn("__d", value() - F.avg(value()).over(WHOLE))
    lagged = rows.select(ID, "__d", *[F.lag("__d", k).over(W).alias(f"__l{k}") for k in range(1, max_lag + 1)])
    sums = lagged.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("__s0"), *[F.coalesce(F.sum(F.col("__d") * F.col(f"__l{k}")), F.lit(0.0)).alias(f"__s{k}") for k in range(1, max_lag + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__s{k}").alias("s")) for k in range(max_lag + 1)]))
    out = sums.select(ID, "n", F.col("__s0").alias("base"), pairs.alias("p")).filter(F.col("p.lag") < F.col("n"))
    return out.select(ID, F.col("p.lag").alias("lag"), F.when(F.col("base") > 0, F.col("p.s") / F.nullif("base", F.lit(0.0))).when(F.col("p.lag") == 0, 1.0).otherwise(0.0).alias("acf"))


def partial_autocorrelation(df: DataFrame, max_lag: int, textbook: bool = False) -> DataFrame:
    """(series_id, lag, pacf) by a fold over the autocorrelations.

    The simple recursion reuses earlier partial values in place of the Durbin-Levinson
    coefficients; ``textbook`` keeps those coefficients.
    """
    acf = autocorrelation(df, max_lag).groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda p: p["acf"]).alias("r"))
    dot = lambda coefs, values: f"aggregate(zip_with({coefs}, {values}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    old = "a.c" if textbook else "a.p"
    up, down = dot(old, f"reverse(slice(r, 2, size({old})))"), dot(old, f"slice(r, 2, size({old}))")
    value = f"CASE WHEN abs(1 - {down}) < 1e-10 THEN 0D ELSE (element_at(r, k + 1) - {up}) / (1 - {down}) END"
    new_c = "concat(zip_with(a.c, reverse(a.c), (x, y) -> x - v * y), array(v))" if textbook else "a.c"
    step = f"aggregate(array({value}), a, (z, v) -> named_struct('p', concat(a.p, array(v)), 'c', {new_c}))"
    fold = f"aggregate(sequence(1, size(r) - 1), named_struct('p', cast(array() AS array<double>), 'c', cast(array() AS array<double>)), (a, k) -> {step}, a -> a.p)"
    out = acf.filter(F.size("r") > 1).select(ID, F.posexplode(F.expr(fold)).alias("k", "pacf"))
    return out.select(ID, (F.col("k") + 1).alias("lag"), "pacf").unionByName(acf.select(ID, F.lit(0).alias("lag"), F.lit(1.0).alias("pacf")))


def autocorrelation_plot_data(df: DataFrame, max_lag: int = 40) -> DataFrame:
    return autocorrelation(df, max_lag).join(partial_autocorrelation(df, max_lag), [ID, "lag"])


def centred_mean(df: DataFrame, window: int | Column, out: str = "trend") -> DataFrame:
    """Centred moving mean with the ends of the series repeated beyond them.

    A fixed window is a frame. A window given as a column (one that depends on the series'
    length) is a difference of two running sums, fetched by two equi-joins on position.
    """
    rows = df.withColumn("__n", F.count(F.lit(1)).over(WHOLE)).withColumn("__w", (F.lit(window) if isinstance(window, int) else window).cast("int"))
    rows = rows.withColumn("__f", F.min_by(value(), position()).over(WHOLE)).withColumn("__l", F.max_by(value(), position()).over(WHOLE))
    half = F.floor(F.col("__w") / 2)
    rows = rows.withColumn("__lo", position() - half).withColumn("__hi", position() + F.col("__w") - 1 - half)
    if isinstance(window, int):
        rows = rows.withColumn("__in", F.sum(value()).over(W.rowsBetween(-(window // 2), window - 1 - window // 2)))
    else:
        sums = df.select(ID, position().alias("__k"), F.sum(value()).over(W.rowsBetween(Window.unboundedPreceding, 0)).alias("__s"))
        top = sums.select(ID, F.col("__k").alias("__top"), F.col("__s").alias("__a"))
        low = sums.select(ID, (F.col("__k") + 1).alias("__bottom"), F.col("__s").alias("__b"))
        rows = rows.withColumn("__top", F.least("__hi", F.col("__n") - 1)).withColumn("__bottom", F.greatest("__lo", F.lit(0).cast("long")))
        rows = rows.join(top, [ID, "__top"]).join(low, [ID, "__bottom"], "left").withColumn("__in", F.col("__a") - F.coalesce("__b", F.lit(0.0)))
    beyond = F.greatest(-F.col("__lo"), F.lit(0)) * F.col("__f") + F.greatest(F.col("__hi") - F.col("__n") + 1, F.lit(0)) * F.col("__l")
    return rows.withColumn(out, (F.col("__in") + beyond) / F.col("__w")).select(*df.columns, out)


def trend_window() -> Column:
    return F.greatest(F.lit(3), F.floor(F.count(F.lit(1)).over(WHOLE) / 10))


def detect_trend(df: DataFrame, method: str = "linear") -> DataFrame:
    """One row a series: slope, intercept and strength by method."""
    at = position().cast("double")
    if method == "linear":
        return df.groupBy(ID).agg(F.regr_slope(value(), at).alias("slope"), F.regr_intercept(value(), at).alias("intercept"), F.abs(correlation(value(), at)).alias("strength"))
    if method == "theil_sen":
        steep = slopes.median_slopes(df).withColumnRenamed("g", ID)
        middle = df.groupBy(ID).agg(F.percentile(value(), F.lit(0.5)).alias("mv"), F.percentile(at, F.lit(0.5)).alias("mt"), F.abs(correlation(value(), at)).alias("strength"))
        return steep.join(middle, ID).select(ID, "slope", (F.col("mv") - F.col("slope") * F.col("mt")).alias("intercept"), "strength")
    if method == "polynomial":
        x = at - F.avg(at).over(WHOLE)
        rows = df.withColumn("__x", x).withColumn("__m", F.avg(at).over(WHOLE))
        s = {f"s{k}": F.sum(F.pow("__x", F.lit(k))) for k in range(5)} | {f"y{k}": F.sum(F.pow("__x", F.lit(k)) * value()) for k in range(3)}
        g = rows.groupBy(ID).agg(*[c.alias(k) for k, c in s.items()], F.max("__m").alias("m"), F.sum(value() * value()).alias("yy"), F.sum(F.pow("__x", F.lit(1)) * F.pow("__x", F.lit(2))).alias("s12"))
        # With x centred and equally spaced, odd sums vanish and the normal equations part.
        det = F.col("s0") * F.col("s4") - F.col("s2") * F.col("s2")
        c2, c1 = (F.col("s0") * F.col("y2") - F.col("s2") * F.col("y0")) / F.nullif(det, F.lit(0.0)), F.col("y1") / F.nullif("s2", F.lit(0.0))
        c0 = (F.col("s4") * F.col("y0") - F.col("s2") * F.col("y2")) / F.nullif(det, F.lit(0.0))
        total = F.col("yy") - F.col("y0") * F.col("y0") / F.col("s0")
        explained = c0 * F.col("y0") + c1 * F.col("y1") + c2 * F.col("y2") - F.col("y0") * F.col("y0") / F.col("s0")
        return g.select(ID, c2.alias("quadratic"), (c1 - 2 * c2 * F.col("m")).alias("slope"), (c0 - c1 * F.col("m") + c2 * F.col("m") * F.col("m")).alias("intercept"), (explained / F.nullif(total, F.lit(0.0))).alias("strength"))
    if method == "moving_average":
        rows = centred_mean(df, trend_window())
        return rows.groupBy(ID).agg((1 - F.var_pop(value() - F.col("trend")) / F.nullif(F.var_pop(value()), F.lit(0.0))).alias("strength"))
    raise ValidationError("unknown trend method", {"method": method})


def detrend(df: DataFrame, method: str = "linear") -> DataFrame:
    """Adds ``trend`` and ``detrended``."""
    if method == "moving_average":
        rows = centred_mean(df, trend_window())
    else:
        fit = detect_trend(df, method)
        curve = F.col("intercept") + F.col("slope") * position() + (F.col("quadratic") * position() * position() if method == "polynomial" else F.lit(0.0))
        rows = df.join(fit, ID).withColumn("trend", curve).drop("slope", "intercept", "strength", "quadratic")
    return rows.withColumn("detrended", value() - F.col("trend"))


def add_trend(df: DataFrame) -> DataFrame:
    return df.withColumn(VALUE, F.col("detrended") + F.col("trend"))


def seasonal_period(df: DataFrame, max_period: int = 50, least: float = 0.3) -> DataFrame:
    """(series_id, period): first peak of the raw autocorrelation of at least ``least``; null without one."""
    lagged = df.select(ID, value().alias("v"), *[F.lag(value(), k).over(W).alias(f"__l{k}") for k in range(1, max_period + 1)])
    sums = lagged.groupBy(ID).agg(F.sum(F.col("v") * F.col("v")).alias("s0"), *[F.coalesce(F.sum(F.col("v") * F.col(f"__l{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, max_period + 1)])
    r = lambda k: F.col(f"s{k}") / F.nullif("s0", F.lit(0.0))
    peaks = [F.when((r(k) >= least) & (r(k) > r(k - 1) if k > 1 else F.lit(False)) & (r(k) > r(k + 1)), k) for k in range(2, max_period)]
    return sums.select(ID, F.coalesce(*peaks).alias("period"))


def seasonal_means(df: DataFrame, period: int, column: str = VALUE) -> DataFrame:
    """(series_id, phase, seasonal): centred means by phase."""
    means = df.groupBy(ID, F.pmod(position(), F.lit(period)).cast("int").alias("phase")).agg(F.avg(column).alias("m"))
    return means.select(ID, "phase", (F.col("m") - F.avg("m").over(WHOLE)).alias("seasonal"))


def decompose(df: DataFrame, period: int) -> DataFrame:
    """Adds trend (centred mean of a tenth of the series), seasonal and residual."""
    rows = centred_mean(df, trend_window()).withColumn("__d", value() - F.col("trend")).withColumn("phase", F.pmod(position(), F.lit(period)).cast("int"))
    out = rows.join(seasonal_means(rows, period, "__d"), [ID, "phase"])
    return out.withColumn("residual", F.col("__d") - F.col("seasonal")).drop("__d", "phase")


def deseasonalize(df: DataFrame, period: int) -> DataFrame:
    """Adds seasonal (phase means of the linearly detrended values) and deseasonalized."""
    rows = detrend(df).withColumn("phase", F.pmod(position(), F.lit(period)).cast("int"))
    out = rows.join(seasonal_means(rows, period, "detrended"), [ID, "phase"])
    return out.withColumn("deseasonalized", value() - F.col("seasonal")).drop("phase", "trend", "detrended")


def detect_seasonality(df: DataFrame, max_period: int = 50) -> DataFrame:
    """(series_id, period, strength): the period of the detrended series and its share of variance."""
    flat = detrend(df).select(ID, POS, F.col("detrended").alias(VALUE))
    rows = flat.join(seasonal_period(flat, max_period), ID).filter(F.col("period").isNotNull()).withColumn("phase", F.pmod(position(), F.col("period")).cast("int"))
    means = rows.groupBy(ID, "period", "phase").agg(F.avg(value()).alias("m"))
    centred = means.withColumn("seasonal", F.col("m") - F.avg("m").over(WHOLE)).drop("m")
    both = rows.join(centred, [ID, "period", "phase"])
    return both.groupBy(ID, "period").agg((F.var_pop("seasonal") / F.nullif(F.var_pop(value()), F.lit(0.0))).alias("strength"))


SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def season_of(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), name).otherwise(out)
    return out


def _in_period(df: DataFrame, reference: tuple[str, str] | None) -> DataFrame:
    rows = df.filter(value().isNotNull())
    return rows if reference is None else rows.filter(F.col(TIME).between(F.lit(reference[0]).cast("timestamp_ntz"), F.lit(reference[1]).cast("timestamp_ntz")))


def climatology(df: DataFrame, reference: tuple[str, str] | None = None) -> DataFrame:
    """(series_id, level, key, ...): statistics by month, season and year, and of all rows, in one pass."""
    rows = _in_period(df, reference).select(ID, value().alias("v"), F.month(TIME).alias("m"), season_of(F.month(TIME)).alias("s"), F.year(TIME).alias("y"))
    keys = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), c.cast("string").alias("key")) for level, c in (("month", F.col("m")), ("season", F.col("s")), ("year", F.col("y")), ("all", F.lit("all")))]))
    cut = lambda p: F.percentile("v", F.lit(p))
    g = rows.select(ID, "v", keys.alias("k")).groupBy(ID, F.col("k.level").alias("level"), F.col("k.key").alias("key"))
    out = g.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), cut(0.5).alias("median"), cut(0.25).alias("q25"), cut(0.75).alias("q75"))
    return out.withColumn("cv", F.col("std") / F.nullif("mean", F.lit(0.0)))


def climatology_cycle(df: DataFrame) -> DataFrame:
    """(series_id, amplitude, phase, interannual) from the monthly and yearly means."""
    c = climatology(df)
    month = F.when(F.col("level") == "month", F.col("mean"))
    return c.groupBy(ID).agg((F.max(month) - F.min(month)).alias("amplitude"), F.max_by(F.col("key").cast("int"), F.struct(month, -F.col("key").try_cast("int"))).alias("phase"), F.stddev_samp(F.when(F.col("level") == "year", F.col("mean"))).alias("interannual"))


def anomalies(df: DataFrame, kind: str = "absolute", reference: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``anomaly`` to the monthly climatology; a month without climatology has none."""
    base = _in_period(df, reference)
    months = base.groupBy(ID, F.month(TIME).alias("__m")).agg(F.avg(value()).alias("__c"))
    spread = base.groupBy(ID).agg(F.stddev_samp(value()).alias("__sd"))
    rows = df.withColumn("__m", F.month(TIME)).join(months, [ID, "__m"], "left").join(spread, ID, "left")
    d = value() - F.col("__c")
    out = {"absolute": d, "relative": d / F.nullif("__c", F.lit(0.0)) * 100, "standardized": d / F.nullif("__sd", F.lit(0.0))}
    if kind not in out:
        raise ValidationError("unknown kind of anomaly", {"kind": kind})
    return rows.withColumn("anomaly", out[kind]).drop("__m", "__c", "__sd")


def extreme_events(df: DataFrame, kind: str = "percentile", threshold: float = 5.0) -> DataFrame:
    """Rows beyond the dry or wet threshold with type, severity and percentile of score."""
    q = lambda p: F.percentile(value(), F.lit(p / 100)).over(WHOLE)
    mean, sd = F.avg(value()).over(WHOLE), F.stddev_samp(value()).over(WHOLE)
    dry, wet = {"percentile": (q(threshold), q(100 - threshold)), "std": (mean - threshold * sd, mean + threshold * sd), "absolute": (F.lit(float(threshold)), F.max(value()).over(WHOLE) - threshold)}[kind]
    ranked = Window.partitionBy(ID).orderBy(VALUE)
    ties = F.count(F.lit(1)).over(Window.partitionBy(ID, VALUE))
    n = F.count(value()).over(WHOLE)
    rows = df.filter(value().isNotNull()).withColumn("__dry", dry).withColumn("__wet", wet).withColumn("__sd", sd).withColumn("percentile", (2 * (F.rank().over(ranked) - 1) + ties + 1) * 50.0 / n)
    kind_of = F.when(value() <= F.col("__dry"), "dry").when(value() >= F.col("__wet"), "wet")
    severity = F.when(value() <= F.col("__dry"), F.col("__dry") - value()).otherwise(value() - F.col("__wet")) / F.nullif("__sd", F.lit(0.0))
    return rows.withColumn("event", kind_of).withColumn("severity", severity).filter(F.col("event").isNotNull()).drop("__dry", "__wet", "__sd")


def split_half_stationarity(df: DataFrame) -> DataFrame:
    """(series_id, n, t_stat, df, variance_ratio): both halves compared; null below 10 rows.

    The p-value follows from the statistic by ``kernels.special.t_two_sided``.
    """
    rows = df.withColumn("__n", F.count(F.lit(1)).over(WHOLE)).withColumn("__a", position() < F.floor(F.col("__n") / 2))
    a, b = F.when(F.col("__a"), value()), F.when(~F.col("__a"), value())
    g = rows.groupBy(ID).agg(F.count(value()).alias("n"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.count(a).alias("n1"), F.count(b).alias("n2")).filter(F.col("n") >= 10)
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n") - 2)
    t = (F.col("m1") - F.col("m2")) / F.sqrt(F.nullif(pooled * (1 / F.col("n1") + 1 / F.col("n2")), F.lit(0.0)))
    return g.select(ID, "n", t.alias("t_stat"), (F.col("n") - 2).alias("df"), (F.col("v1") / F.nullif("v2", F.lit(0.0))).alias("variance_ratio"))
