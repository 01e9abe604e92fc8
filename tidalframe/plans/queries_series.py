"""Queries over series: cleaning, features, statistics, forecasts and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frame
from ..functions import columns, metrics
from ..operators import clean, detect, forecast, simulate, stats
from . import backtest as bt
from .catalog import DAYS, MONTHS, TYPES, USERS, query

ID, POS, VALUE = frame.ID, frame.POS, frame.VALUE
OVER = "OVER (PARTITION BY series_id ORDER BY t)"


def r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


@query(f"WITH {DAYS} SELECT series_id, t, strftime(ts, '%Y-%m-%d') AS day, {r('value', 'value')} FROM e")
def panel_ingest(spark, d):
    return frame.orders_by_day(spark, d).select(ID, POS, F.date_format("ts", "yyyy-MM-dd").alias("day"), VALUE)


@query(f"WITH {USERS} SELECT series_id, t, {r('ln(value + 1)', 'logged')}, {r('exp(ln(value + 1)) - 1', 'again')} FROM e")
def log_transform(spark, d):
    e = clean.log_transform(frame.events_by_user(spark, d))
    return e.select(ID, POS, F.col(VALUE).alias("logged")).join(clean.log_inverse(e).select(ID, POS, F.col(VALUE).alias("again")), [ID, POS])


@query(f"WITH {USERS} SELECT series_id, t, {r('value', 'value')}, {r(f'lag(value, 1) {OVER}', 'lag_1')}, {r(f'lag(value, 3) {OVER}', 'lag_3')}, {r(f'value - lag(value, 1) {OVER}', 'diff_1')}, {r(f'value - lag(value, 3) {OVER}', 'diff_3')}, CASE WHEN lag(value, 1) {OVER} <> 0 THEN {r(f'(value - lag(value, 1) {OVER}) / lag(value, 1) {OVER}', 'x').replace(' AS x', '')} END AS pct_change_1, CASE WHEN lag(value, 3) {OVER} <> 0 THEN round((value - lag(value, 3) {OVER}) / lag(value, 3) {OVER}, 6) END AS pct_change_3, {r(f'lag(value, 7) {OVER}', 'seasonal_lag_7')}, {r(f'lead(value, 2) {OVER}', 'lead_2')} FROM e")
def lag_features(spark, d):
    made = columns.lags([1, 3], True, True, [7]) | {"lead_2": columns.lag_column(-2)}
    return frame.events_by_user(spark, d).select(ID, POS, VALUE, *[c.alias(n) for n, c in made.items()])


def _rolling_sql(n: int) -> str:
    w = f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    gate = lambda x: f"CASE WHEN t >= {n - 1} THEN round({x}, 6) END"
    return f"round(avg(value) {w}, 6) AS rolling_mean_{n}, round(coalesce(stddev_samp(value) {w}, 0), 6) AS rolling_std_{n}, {gate(f'min(value) {w}')} AS rolling_min_{n}, {gate(f'max(value) {w}')} AS rolling_max_{n}, {gate(f'quantile_cont(value, 0.5) {w}')} AS rolling_median_{n}"


@query(f"WITH {USERS} SELECT series_id, t, {_rolling_sql(7)}, {_rolling_sql(14)} FROM e")
def rolling_features(spark, d):
    return frame.events_by_user(spark, d).select(ID, POS, *[c.alias(n) for n, c in columns.rollings([7, 14], ["mean", "std", "min", "max", "median"]).items()])


@query(f"WITH {DAYS} SELECT t, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(isodow(ts) - 1 AS INT) AS dayofweek, CAST(dayofyear(ts) AS INT) AS dayofyear, CAST(weekofyear(ts) AS INT) AS week, CAST(quarter(ts) AS INT) AS quarter, CAST(hour(ts) AS INT) AS hour, isodow(ts) >= 6 AS is_weekend, day(ts) = 1 AS is_month_start, CAST(ts AS DATE) = last_day(CAST(ts AS DATE)) AS is_month_end FROM e")
def calendar_features(spark, d):
    return frame.orders_by_day(spark, d).select(POS, *[c.alias(n) for n, c in columns.calendar().items()])


@query(f"WITH {USERS}, a AS (SELECT *, value - lag(value) {OVER} AS d1 FROM e), b AS (SELECT *, d1 - lag(d1) {OVER} AS d2 FROM a) SELECT series_id, t, {r('d1', 'diff_1')}, {r('d2', 'diff_2')}, {r(f'd2 - lag(d2) {OVER}', 'diff_3')}, {r('sin(2 * pi() * t / 7)', 'sin_7')}, {r('cos(2 * pi() * t / 7)', 'cos_7')} FROM b")
def difference_and_fourier(spark, d):
    made = columns.differences([1, 2, 3])
    f = columns.fourier([7])
    return frame.events_by_user(spark, d).select(ID, POS, *[c.alias(n) for n, c in made.items()], f["seasonal_sin_7"].alias("sin_7"), f["seasonal_cos_7"].alias("cos_7"))


@query(f"WITH {DAYS} SELECT t, {r(f'value / lag(value, 1) {OVER} - 1', 'degradation_rate_1')}, {r(f'value / lag(value, 3) {OVER} - 1', 'degradation_rate_3')}, {r(f'value / lag(value, 5) {OVER} - 1', 'degradation_rate_5')} FROM e")
def degradation_rate(spark, d):
    rows = frame.orders_by_day(spark, d).withColumn("__filled", columns.filled_forward())
    return rows.select(POS, *[c.alias(n) for n, c in columns.degradation([1, 3, 5]).items()])


@query(f"WITH {USERS}, b AS (SELECT series_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM e GROUP BY 1) SELECT series_id, t, {r('value', 'value')} FROM e JOIN b USING (series_id) WHERE value BETWEEN a - 0.5 * (c - a) AND c + 0.5 * (c - a)")
def outliers_iqr(spark, d):
    return clean.remove_outliers_iqr(frame.events_by_user(spark, d), 0.5).select(ID, POS, VALUE)


_BASE = "CASE WHEN t >= 9 THEN quantile_cont(value, 0.5) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) ELSE quantile_cont(value, 0.5) OVER (PARTITION BY series_id) END"


@query(f"WITH {DAYS}, a AS (SELECT *, value - {_BASE} AS res FROM e), b AS (SELECT series_id, median(res) AS m FROM a GROUP BY 1), c AS (SELECT a.series_id, median(abs(res - m)) AS mad FROM a JOIN b USING (series_id) GROUP BY 1) SELECT t, {r('res', 'residual')}, {r('3 * 1.4826 * mad', 'lim')} FROM a JOIN c USING (series_id) WHERE abs(res) <= 3 * 1.4826 * mad")
def outliers_hampel(spark, d):
    rows = clean.hampel_scores(frame.orders_by_day(spark, d))
    return rows.filter(F.abs("residual") <= F.col("limit")).select(POS, "residual", F.col("limit").alias("lim"))


@query(f"WITH {DAYS}, a AS (SELECT *, {_BASE} AS base FROM e), b AS (SELECT *, ln(value) - ln(greatest(base, 1.0)) AS res FROM a), c AS (SELECT avg(res) AS m, stddev_pop(res) AS s FROM b) SELECT t, {r('abs(res - m) / s', 'zscore')} FROM b, c WHERE abs(res - m) / s <= 3")
def outliers_zscore(spark, d):
    return clean.zscore_scores(frame.orders_by_day(spark, d)).filter("zscore <= 3").select(POS, "zscore")


@query(f"WITH {USERS}, a AS (SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w FROM e), b AS (SELECT *, list_sort(w)[3] AS m FROM a), c AS (SELECT *, list_sort(list_transform(w, lambda x: abs(x - m)))[3] AS mad FROM b) SELECT series_id, t, t >= 4 AND 0.6745 * abs(value - m) / CASE WHEN mad = 0 THEN 1e-10 ELSE mad END > 3 AS anomaly FROM c")
def anomalies_mad(spark, d):
    return clean.detect_anomalies_mad(frame.events_by_user(spark, d), 3.0, 5).select(ID, POS, "anomaly")


_CALENDAR = f"{DAYS}, c AS (SELECT CAST(unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS TIMESTAMP) AS p FROM e), j AS (SELECT row_number() OVER (ORDER BY p) - 1 AS t, p, value FROM c LEFT JOIN e ON e.ts = c.p)"


@query(f"WITH {_CALENDAR} SELECT t, {r('last_value(value IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'ffill')}, {r('first_value(value IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 'bfill')} FROM j")
def fill_dates(spark, d):
    e = frame.orders_by_day(spark, d)
    one = clean.fill_missing_dates(e, "forward").select(POS, F.col(VALUE).alias("ffill"))
    return one.join(clean.fill_missing_dates(e, "backward").select(POS, F.col(VALUE).alias("bfill")), POS)


@query(f"WITH {_CALENDAR}, k AS (SELECT t, value, last_value(value IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(value IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, max(CASE WHEN value IS NOT NULL THEN t END) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ta, min(CASE WHEN value IS NOT NULL THEN t END) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM j) SELECT t, round(CASE WHEN value IS NOT NULL THEN value WHEN b IS NULL THEN a ELSE a + (b - a) * (t - ta) / (tb - ta) END, 6) AS value FROM k")
def interpolate_dates(spark, d):
    return clean.fill_missing_dates(frame.orders_by_day(spark, d), "interpolate").select(POS, VALUE)


@query(f"WITH {DAYS}, m AS (SELECT date_trunc('month', ts) AS p, avg(value) AS mean, sum(value) AS total, arg_min(value, t) AS first, arg_max(value, t) AS last FROM e GROUP BY 1) SELECT strftime(p, '%Y-%m') AS month, {r('mean', 'mean')}, {r('total', 'total')}, {r('first', 'first')}, {r('last', 'last')} FROM m")
def resample_month(spark, d):
    e = frame.orders_by_day(spark, d)
    out = None
    for method, name in (("mean", "mean"), ("sum", "total"), ("first", "first"), ("last", "last")):
        one = clean.resample(e, "M", method).select(F.date_format("ts", "yyyy-MM").alias("month"), F.col(VALUE).alias(name))
        out = one if out is None else out.join(one, "month")
    return out


@query(f"WITH {DAYS}, w AS (SELECT date_trunc('week', ts) AS p, sum(value) AS v FROM e GROUP BY 1), c AS (SELECT CAST(unnest(generate_series((SELECT min(p) FROM w), (SELECT max(p) FROM w), INTERVAL 7 DAY)) AS TIMESTAMP) AS p) SELECT strftime(c.p, '%Y-%m-%d') AS week, round(coalesce(v, 0), 6) AS value FROM c LEFT JOIN w ON w.p = c.p")
def resample_week(spark, d):
    return clean.resample(frame.orders_by_day(spark, d), "W", "sum").select(F.date_format("ts", "yyyy-MM-dd").alias("week"), VALUE)


@query("SELECT * FROM (VALUES ('days', 'D'), ('months', 'M'), ('users', 'H')) AS v(view, freq)")
def detect_frequency(spark, d):
    one = lambda df, name: clean.detect_frequency(df).groupBy().agg(F.mode("freq", True).alias("freq")).select(F.lit(name).alias("view"), "freq")
    hours = frame.panel(spark.read.parquet(f"{d}/events.parquet").withColumn("h", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")).groupBy("h").agg(F.avg("value").alias("v")), "v", "h")
    return one(frame.orders_by_day(spark, d), "days").unionByName(one(frame.orders_by_priority_month(spark, d), "months")).unionByName(one(hours, "users"))


@query(f"WITH {USERS}, n AS (SELECT series_id, count(*) AS n FROM e GROUP BY 1) SELECT series_id, CAST(floor(n * 0.8) AS BIGINT) AS train, n - CAST(floor(n * 0.8) AS BIGINT) AS test FROM n")
def split_sizes(spark, d):
    train, test = clean.split(frame.events_by_user(spark, d), train_size=0.8)
    return train.groupBy(ID).agg(F.count(F.lit(1)).alias("train")).join(test.groupBy(ID).agg(F.count(F.lit(1)).alias("test")), ID)


@query(f"WITH {DAYS}, b AS (SELECT CAST(floor(t / 7) AS BIGINT) AS t, count(*) AS n, avg(value) AS mean, median(value) AS median, max(value) AS max, min(value) AS min, stddev_samp(value) AS std FROM e GROUP BY 1) SELECT t, {r('mean', 'mean')}, {r('median', 'median')}, {r('max', 'max')}, {r('min', 'min')}, {r('std', 'std')} FROM b WHERE n = 7")
def coarse_grain(spark, d):
    e, out = frame.orders_by_day(spark, d), None
    for m in ("mean", "median", "max", "min", "std"):
        one = clean.coarse_grain(e, 7, m).select(POS, F.col(VALUE).alias(m))
        out = one if out is None else out.join(one, POS)
    return out


@query(f"WITH {USERS}, a AS (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS y FROM e) SELECT series_id, t, {r('list_sum(x)', 'x_sum')}, {r('x[1]', 'x_first')}, {r('list_sum(y)', 'y_sum')} FROM a WHERE len(x) = 5 AND len(y) = 2")
def sequences(spark, d):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    rows = clean.sequences(frame.events_by_user(spark, d), 5, 2)
    return rows.select(ID, POS, total("x").alias("x_sum"), F.col("x")[0].alias("x_first"), total("y").alias("y_sum"))


@query(f"""WITH {USERS}, a AS (SELECT series_id, t, list(value) OVER w AS x, list(value * t) OVER w AS o, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS y FROM e WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT series_id, t, {r('list_sum(x)', 'x_sum')}, {r('list_sum(o)', 'o_sum')}, {r('o[1]', 'o_first')}, {r('list_sum(y)', 'y_sum')} FROM a WHERE len(x) = 3 AND len(y) = 2""")
def sequences_exogenous(spark, d):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    rows = clean.sequences(frame.events_by_user(spark, d).withColumn("o", F.col(VALUE) * F.col(POS)), 3, 2, ["o"])
    return rows.select(ID, POS, total("x").alias("x_sum"), total("x_o").alias("o_sum"), F.col("x_o")[0].alias("o_first"), total("y").alias("y_sum"))


@query(f"""WITH {USERS} SELECT series_id, t, {r('value', 'value')}, {r(f'lag(value, 1) {OVER}', 'past__lag_1')}, {r(f'lag(value, 2) {OVER}', 'past__lag_2')}, {r(f'value - lag(value, 1) {OVER}', 'change')} FROM e""")
def feature_union(spark, d):
    from ..compose import FeatureUnion
    from ..estimators import DifferencingFeaturizer, LagFeaturizer

    y = frame.events_by_user(spark, d)
    out = FeatureUnion([("past", LagFeaturizer([1, 2])), ("step", DifferencingFeaturizer())]).fit(y).transform(y)
    change = next(c for c in out.columns if c.startswith("step__") and c.rsplit("_", 1)[-1] == "1")
    return out.select(ID, POS, VALUE, "past__lag_1", "past__lag_2", F.col(change).alias("change"))


@query(f"WITH {USERS}, a AS (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w FROM e) SELECT series_id, CAST(t // 5 AS BIGINT) AS win, {r('list_sum(w)', 'total')} FROM a WHERE t % 5 = 0 AND len(w) = 10")
def sliding_windows(spark, d):
    rows = clean.sliding_windows(frame.events_by_user(spark, d), 10, 5)
    return rows.select(ID, F.col("window").alias("win"), F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total"))


_ACF = f"{DAYS}, m AS (SELECT t, value - avg(value) OVER () AS d FROM e), s AS (SELECT sum(d * d) AS v FROM m), r AS (SELECT 0 AS lag, 1.0 AS acf UNION ALL SELECT k, (SELECT sum(a.d * b.d) FROM m a JOIN m b ON b.t = a.t - k) / (SELECT v FROM s) FROM range(1, 21) x(k))"


@query(f"WITH {_ACF} SELECT CAST(lag AS INT) AS lag, {r('acf', 'acf')} FROM r")
def autocorrelation(spark, d):
    return stats.autocorrelation(frame.orders_by_day(spark, d), 20).select("lag", "acf")


@query(f"WITH {_ACF}, l AS (SELECT list(CAST(acf AS DOUBLE) ORDER BY lag) AS q FROM r), f AS (SELECT list_reduce(list_transform(range(1, 21), lambda k: [CAST(k AS DOUBLE)]), lambda a, x: list_append(a, (q[len(a) + 2] - list_dot_product(a, list_reverse(q[2:len(a) + 1]))) / (1 - list_dot_product(a, q[2:len(a) + 1]))), [q[2]]) AS phi FROM l) SELECT CAST(k AS INT) AS lag, round(phi[k], 6) AS pacf FROM f, range(1, 21) x(k) UNION ALL SELECT 0, CAST(1 AS DOUBLE)")
def partial_autocorrelation(spark, d):
    return stats.partial_autocorrelation(frame.orders_by_day(spark, d), 20).select("lag", "pacf")


@query(f"WITH {_ACF}, l AS (SELECT list(CAST(acf AS DOUBLE) ORDER BY lag) AS q FROM r), f AS (SELECT list_reduce(list_transform(range(1, 21), lambda k: [CAST(k AS DOUBLE)]), lambda a, x: list_append(a, (q[len(a) + 2] - list_dot_product(a, list_reverse(q[2:len(a) + 1]))) / (1 - list_dot_product(a, q[2:len(a) + 1]))), [q[2]]) AS phi FROM l) SELECT CAST(r.lag AS INT) AS lag, round(CAST(acf AS DOUBLE), 6) AS acf, CASE WHEN r.lag = 0 THEN 1.0 ELSE round(phi[r.lag], 6) END AS pacf FROM r, f")
def autocorrelation_plot(spark, d):
    return stats.autocorrelation_plot_data(frame.orders_by_day(spark, d), 20).select("lag", "acf", "pacf")


@query(f"WITH {MONTHS} SELECT series_id, {r('regr_slope(value, t)', 'slope')}, {r('regr_intercept(value, t)', 'intercept')}, {r('abs(corr(value, t))', 'strength')} FROM e GROUP BY 1")
def trend_linear(spark, d):
    return stats.detect_trend(frame.orders_by_priority_month(spark, d))


@query(f"WITH {MONTHS} SELECT a.series_id, {r('quantile_cont((b.value - a.value) / (b.t - a.t), 0.5)', 'slope')} FROM e a JOIN e b ON a.series_id = b.series_id AND a.t < b.t GROUP BY 1")
def trend_theil_sen(spark, d):
    return stats.detect_trend(frame.orders_by_priority_month(spark, d), "theil_sen").select(ID, "slope")


_CENTRED = f"{MONTHS}, n AS (SELECT series_id, greatest(3, count(*) // 10) AS w, max(t) AS last FROM e GROUP BY 1), k AS (SELECT e.series_id, e.t, e.value, w, least(greatest(e.t - w // 2 + o, 0), last) AS s FROM e JOIN n USING (series_id), range(0, 40) x(o) WHERE o < w), c AS (SELECT k.series_id, k.t, any_value(k.value) AS value, sum(f.value) / any_value(w) AS trend FROM k JOIN e f ON f.series_id = k.series_id AND f.t = k.s GROUP BY 1, 2)"


@query(f"WITH {_CENTRED} SELECT series_id, t, round(trend, 4) AS trend FROM c")
def trend_moving_average(spark, d):
    return stats.detrend(frame.orders_by_priority_month(spark, d), "moving_average").select(ID, POS, F.round("trend", 4).alias("trend"))


@query(f"WITH {MONTHS}, f AS (SELECT series_id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM e GROUP BY 1) SELECT series_id, t, round(value - a - b * t, 4) AS detrended FROM e JOIN f USING (series_id)")
def detrend_linear(spark, d):
    return stats.detrend(frame.orders_by_priority_month(spark, d)).select(ID, POS, F.round("detrended", 4).alias("detrended"))


@query(f"WITH {_CENTRED}, p AS (SELECT series_id, t % 12 AS ph, avg(value - trend) AS m FROM c GROUP BY 1, 2), q AS (SELECT series_id, ph, m - avg(m) OVER (PARTITION BY series_id) AS s FROM p) SELECT c.series_id, t, round(trend, 4) AS trend, round(s, 4) AS seasonal, round(value - trend - s, 4) AS residual FROM c JOIN q ON q.series_id = c.series_id AND q.ph = c.t % 12")
def decompose(spark, d):
    rows = stats.decompose(frame.orders_by_priority_month(spark, d), 12)
    return rows.select(ID, POS, *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "residual")])


@query(f"WITH {MONTHS}, f AS (SELECT series_id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM e GROUP BY 1), g AS (SELECT series_id, t, value, value - a - b * t AS x FROM e JOIN f USING (series_id)), p AS (SELECT series_id, t % 12 AS ph, avg(x) AS m FROM g GROUP BY 1, 2), q AS (SELECT series_id, ph, m - avg(m) OVER (PARTITION BY series_id) AS s FROM p) SELECT g.series_id, t, round(value - s, 4) AS deseasonalized FROM g JOIN q ON q.series_id = g.series_id AND q.ph = g.t % 12")
def deseasonalize(spark, d):
    return stats.deseasonalize(frame.orders_by_priority_month(spark, d), 12).select(ID, POS, F.round("deseasonalized", 4).alias("deseasonalized"))


@query(f"WITH {DAYS}, x AS (SELECT value AS v, unnest(['month', 'season', 'year', 'all']) AS level, unnest([CAST(month(ts) AS VARCHAR), CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) <= 5 THEN 'MAM' WHEN month(ts) <= 8 THEN 'JJA' ELSE 'SON' END, CAST(year(ts) AS VARCHAR), 'all']) AS key FROM e) SELECT level, key, count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('quantile_cont(v, 0.25)', 'q25')}, {r('quantile_cont(v, 0.75)', 'q75')}, {r('stddev_samp(v) / avg(v)', 'cv')} FROM x GROUP BY 1, 2")
def climatology(spark, d):
    return stats.climatology(frame.orders_by_day(spark, d)).drop(ID)


@query(f"WITH {DAYS}, m AS (SELECT month(ts) AS m, avg(value) AS c FROM e GROUP BY 1), s AS (SELECT stddev_samp(value) AS sd FROM e) SELECT t, {r('value - c', 'absolute')}, {r('(value - c) / c * 100', 'relative')}, {r('(value - c) / sd', 'standardized')} FROM e JOIN m ON m.m = month(e.ts), s")
def anomalies(spark, d):
    e, out = frame.orders_by_day(spark, d), None
    for kind in ("absolute", "relative", "standardized"):
        one = stats.anomalies(e, kind).select(POS, F.col("anomaly").alias(kind))
        out = one if out is None else out.join(one, POS)
    return out


@query(f"WITH {DAYS}, q AS (SELECT quantile_cont(value, 0.05) AS dry, quantile_cont(value, 0.95) AS wet, stddev_samp(value) AS sd, count(*) AS n FROM e), k AS (SELECT *, (2 * (rank() OVER (ORDER BY value) - 1) + count(*) OVER (PARTITION BY value) + 1) * 50.0 / n AS pct FROM e, q) SELECT t, CASE WHEN value <= dry THEN 'dry' ELSE 'wet' END AS event, round(CASE WHEN value <= dry THEN dry - value ELSE value - wet END / sd, 6) AS severity, round(pct, 6) AS percentile FROM k WHERE value <= dry OR value >= wet")
def extreme_events(spark, d):
    return stats.extreme_events(frame.orders_by_day(spark, d)).select(POS, "event", "severity", "percentile")


@query(f"WITH {TYPES}, n AS (SELECT series_id, count(*) // 2 AS h FROM e GROUP BY 1), g AS (SELECT e.series_id, count(*) AS n, avg(CASE WHEN t < h THEN value END) AS m1, avg(CASE WHEN t >= h THEN value END) AS m2, var_samp(CASE WHEN t < h THEN value END) AS v1, var_samp(CASE WHEN t >= h THEN value END) AS v2, count(CASE WHEN t < h THEN 1 END) AS n1, count(CASE WHEN t >= h THEN 1 END) AS n2 FROM e JOIN n USING (series_id) GROUP BY 1) SELECT series_id, n, {r('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n - 2) * (1.0 / n1 + 1.0 / n2))', 't_stat')}, n - 2 AS df, {r('v1 / v2', 'variance_ratio')} FROM g WHERE n >= 10")
def stationarity_split_half(spark, d):
    return stats.split_half_stationarity(frame.events_by_type_day(spark, d))


@query(f"WITH {DAYS}, k AS (SELECT weekofyear(ts) AS k, avg(value) AS m, stddev_samp(value) AS s FROM e GROUP BY 1) SELECT t, {r('abs(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 'score')}, abs(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END > 2.5 AS flag FROM e JOIN k ON k.k = weekofyear(ts)")
def seasonal_baseline(spark, d):
    return detect.seasonal_baseline(frame.orders_by_day(spark, d)).select(POS, "score", "flag")


_SHIFT = f"{TYPES}, n AS (SELECT series_id, count(*) AS n FROM e GROUP BY 1), z AS (SELECT e.series_id, t, n, abs(avg(value) OVER b - avg(value) OVER a) / sqrt((pow(stddev_pop(value) OVER b, 2) + pow(stddev_pop(value) OVER a, 2)) / 2 + 1e-10) AS z FROM e JOIN n USING (series_id) WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), s AS (SELECT series_id, t, CASE WHEN t >= 5 AND t < n - 5 THEN z END AS score FROM z)"


@query(f"WITH RECURSIVE {_SHIFT}, h AS (SELECT series_id, min(t) AS t FROM s WHERE score > 0.7 GROUP BY 1 UNION ALL SELECT h.series_id, (SELECT min(s.t) FROM s WHERE s.series_id = h.series_id AND s.score > 0.7 AND s.t >= h.t + 5) FROM h WHERE h.t IS NOT NULL) SELECT s.series_id, s.t, {r('score', 'score')}, h.t IS NOT NULL AS flag FROM s LEFT JOIN h ON h.series_id = s.series_id AND h.t = s.t")
def mean_shift(spark, d):
    return detect.mean_shift(frame.events_by_type_day(spark, d), 5, 0.7).select(ID, POS, "score", "flag")


@query(f"WITH RECURSIVE {TYPES}, z AS (SELECT series_id, t, (value - avg(value) OVER (PARTITION BY series_id)) / stddev_pop(value) OVER (PARTITION BY series_id) AS z FROM e), s AS (SELECT series_id, t, greatest(0.0, z - 0.5) AS up, greatest(0.0, -z - 0.5) AS dn FROM z WHERE t = 0 UNION ALL SELECT z.series_id, z.t, greatest(0.0, up + z - 0.5), greatest(0.0, dn - z - 0.5) FROM s JOIN z ON z.series_id = s.series_id AND z.t = s.t + 1) SELECT series_id, t, {r('greatest(up, dn)', 'score')}, greatest(up, dn) > 2 AS flag FROM s")
def cusum(spark, d):
    return detect.cusum(frame.events_by_type_day(spark, d), 0.5, 2.0).select(ID, POS, "score", "flag")


@query(f"WITH {DAYS}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c, avg(value) AS m, stddev_pop(value) AS s FROM e), f AS (SELECT t, CAST(value > c + 0.5 * (c - a) OR value < a - 0.5 * (c - a) AS INT) + CAST(abs(value - m) > 2 * s AS INT) + CAST(value = max(value) OVER () AS INT) AS score FROM e, q) SELECT t, score, score >= 2 AS flag FROM f")
def voting(spark, d):
    e = frame.orders_by_day(spark, d)
    bounds = clean.iqr_bounds(e, 0.5)
    v = F.col(VALUE)
    rows = e.join(bounds, ID).withColumn("a", ~v.between(F.col("lower"), F.col("upper"))).withColumn("b", F.abs(v - F.avg(v).over(frame.WHOLE)) > 2 * F.stddev_pop(v).over(frame.WHOLE)).withColumn("c", v == F.max(v).over(frame.WHOLE))
    return detect.vote(rows, ["a", "b", "c"], 2).select(POS, "score", "flag")


@query(f"WITH {DAYS}, n AS (SELECT max(t) AS last FROM e), k AS (SELECT e.t, CASE WHEN e.t + o < 0 THEN -(e.t + o) - 1 WHEN e.t + o > last THEN 2 * last + 1 - e.t - o ELSE e.t + o END AS s FROM e, n, range(-2, 3) x(o)) SELECT k.t, {r('median(f.value)', 'value')} FROM k JOIN e f ON f.t = k.s GROUP BY 1")
def median_filter(spark, d):
    return detect.median_filter(frame.orders_by_day(spark, d), 5).select(POS, VALUE)


_LAST = f"{TYPES}, n AS (SELECT series_id, max(t) AS last FROM e GROUP BY 1), x AS (SELECT e.*, last FROM e JOIN n USING (series_id))"


@query(f"WITH {_LAST}, s AS (SELECT series_id, max(last) AS last, arg_max(value, t) AS naive, avg(CASE WHEN t > last - 7 THEN value END) AS sma, sum(value * pow(0.7, last - t) * CASE WHEN t = 0 THEN 1 ELSE 0.3 END) AS ema, sum(CASE WHEN t > last - 3 THEN value * (t - last + 3) END) / 6 AS wma, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM x GROUP BY 1) SELECT series_id, CAST(h AS INT) AS h, last + h AS t, {r('naive', 'naive')}, {r('sma', 'sma')}, {r('ema', 'ema')}, {r('wma', 'wma')}, {r('greatest(0, a + b * (last + h))', 'linear')} FROM s, range(1, 6) y(h)")
def forecasts(spark, d):
    e, out = frame.events_by_type_day(spark, d), None
    models = {"naive": forecast.naive(), "sma": forecast.moving_average(7), "ema": forecast.exponential_average(0.3), "wma": forecast.weighted_average([1 / 6, 2 / 6, 3 / 6]), "linear": forecast.linear_trend()}
    for name, m in models.items():
        one = m.predict(m.fit(e), 5).select(ID, "h", POS, F.col("y_pred").alias(name))
        out = one if out is None else out.join(one, [ID, "h", POS])
    return out


def _folds_sql(first: int, fh: int, sliding: bool) -> str:
    low = f"e.t >= cutoff - {first} AND" if sliding else ""
    return f"{TYPES}, n AS (SELECT series_id, max(t) + 1 AS n FROM e GROUP BY 1), f AS (SELECT series_id, CAST(k AS INT) AS fold_id, {first} + k AS cutoff FROM n, range(0, 100) x(k) WHERE {first} + k + {fh} <= n), g AS (SELECT f.series_id, fold_id, cutoff, arg_max(value, t) AS naive, avg(CASE WHEN t >= cutoff - 7 THEN value END) AS sma FROM f JOIN e ON e.series_id = f.series_id AND {low} e.t < cutoff GROUP BY 1, 2, 3), p AS (SELECT g.*, e.value AS y FROM g JOIN e ON e.series_id = g.series_id AND e.t >= cutoff AND e.t < cutoff + {fh})"


def _folds_out(model: str) -> str:
    return f"SELECT '{model}' AS model, series_id, fold_id, count(*) AS n, {r(f'avg(abs(y - {model}))', 'mae')}, {r(f'sqrt(avg((y - {model}) * (y - {model})))', 'rmse')}, {r(f'avg(abs((y - {model}) / y)) * 100', 'mape')} FROM p GROUP BY 1, 2, 3"


def _backtests(e, splitter):
    out = None
    for name, m in (("naive", forecast.naive()), ("sma", forecast.moving_average(7))):
        one = bt.per_fold(bt.backtest(e, m, splitter)).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_folds_sql(20, 5, False)} {_folds_out('naive')} UNION ALL {_folds_out('sma')}")
def backtest_expanding(spark, d):
    return _backtests(frame.events_by_type_day(spark, d), bt.ExpandingWindowSplit(20, 1, 5))


@query(f"WITH {_folds_sql(15, 3, True)} {_folds_out('naive')} UNION ALL {_folds_out('sma')}")
def backtest_sliding(spark, d):
    return _backtests(frame.events_by_type_day(spark, d), bt.SlidingWindowSplit(15, 1, 3))


_STATES = f"""WITH {TYPES}, n AS (SELECT series_id, max(t) + 1 AS n FROM e GROUP BY 1), f AS (SELECT series_id, CAST(k AS INT) AS fold_id, k * 2 AS lo, k * 2 + 12 AS cutoff FROM n, range(0, 100) x(k) WHERE k * 2 + 12 + 3 <= n),
g AS (SELECT f.series_id, fold_id, cutoff, lo, sum(value * pow(0.7, cutoff - 1 - t) * CASE WHEN t = lo THEN 1 ELSE 0.3 END) AS ema, sum(CASE t WHEN cutoff - 3 THEN value WHEN cutoff - 2 THEN 2 * value WHEN cutoff - 1 THEN 3 * value END) / 6 AS wma, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM f JOIN e ON e.series_id = f.series_id AND e.t >= lo AND e.t < cutoff GROUP BY 1, 2, 3, 4)
SELECT g.series_id, fold_id, CAST(e.t - cutoff + 1 AS INT) AS h, round(value, 6) AS y_true, round(ema, 6) AS ema, round(wma, 6) AS wma, round(greatest(0, a + b * e.t), 6) AS linear FROM g JOIN e ON e.series_id = g.series_id AND e.t >= cutoff AND e.t < cutoff + 3"""


@query(_STATES)
def backtest_states(spark, d):
    e, out = frame.events_by_type_day(spark, d), None
    for name, m in (("ema", forecast.exponential_average(0.3)), ("wma", forecast.weighted_average([1 / 6, 2 / 6, 3 / 6])), ("linear", forecast.linear_trend())):
        one = bt.backtest(e, m, bt.SlidingWindowSplit(12, 2, 3)).withColumnRenamed("y_pred", name).drop("cutoff")
        out = one if out is None else out.join(one.drop("y_true"), [ID, "fold_id", "h"])
    return out


@query(f"WITH {_folds_sql(20, 5, False)}, q AS ({_folds_out('naive')}) SELECT series_id, count(*) AS n_folds, {r('avg(mae)', 'mae_mean')}, {r('avg(rmse)', 'rmse_mean')}, {r('avg(mape)', 'mape_mean')}, round(stddev_samp(mae), 4) AS mae_std FROM q GROUP BY 1".replace("round(avg(mae), 6)", "round(avg(mae), 4)").replace("round(avg(rmse), 6)", "round(avg(rmse), 4)").replace("round(avg(mape), 6)", "round(avg(mape), 4)"))
def backtest_summary(spark, d):
    folds = bt.per_fold(bt.backtest(frame.events_by_type_day(spark, d), forecast.naive(), bt.ExpandingWindowSplit(20, 1, 5)))
    s = bt.summary(folds)
    return s.select(ID, "n_folds", *[F.round(c, 4).alias(c) for c in ("mae_mean", "rmse_mean", "mape_mean", "mae_std")])


_PAIR = f"{USERS}, p AS (SELECT series_id, value AS y, lag(value) {OVER} AS f FROM e), q AS (SELECT * FROM p WHERE f IS NOT NULL)"


@query(f"WITH {_PAIR} SELECT series_id, count(*) AS n, {r('avg(abs(y - f))', 'mae')}, {r('sqrt(avg((y - f) * (y - f)))', 'rmse')}, {r('avg(CASE WHEN y <> 0 THEN abs((y - f) / nullif(y, 0)) END) * 100', 'mape')}, {r('avg(f - y)', 'bias')}, {r('stddev_pop(f - y)', 'ubrmse')}, {r('avg(CASE WHEN abs(y) + abs(f) > 0 THEN abs(f - y) / nullif((abs(y) + abs(f)) / 2, 0) END) * 100', 'smape')}, {r('1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y))', 'r2')} FROM q GROUP BY 1")
def accuracy_metrics(spark, d):
    rows = frame.events_by_user(spark, d).select(ID, F.col(VALUE).alias("y_true"), columns.lag_column(1).alias("y_pred"))
    return metrics.evaluate(rows, [ID])


@query(f"WITH {_LAST}, a AS (SELECT series_id, t, value AS y, lag(value, 1) OVER w AS naive, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS sma FROM e WINDOW w AS (PARTITION BY series_id ORDER BY t)), m AS (SELECT unnest(['naive', 'sma']) AS model, y, unnest([naive, sma]) AS f FROM a WHERE t >= 3) SELECT model, count(*) AS n, {r('avg(abs(y - f))', 'mae')}, {r('sqrt(avg((y - f) * (y - f)))', 'rmse')}, {r('avg(abs((y - f) / y)) * 100', 'mape')}, {r('1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y))', 'r2')} FROM m GROUP BY 1")
def model_comparison(spark, d):
    e = frame.events_by_type_day(spark, d)
    rows = e.withColumn("naive", columns.lag_column(1)).withColumn("sma", F.avg(VALUE).over(frame.W.rowsBetween(-3, -1))).filter(F.col(POS) >= 3)
    made = rows.select(ID, POS, F.explode(F.create_map(F.lit("naive"), F.col("naive"), F.lit("sma"), F.col("sma"))).alias("model", "y_pred"))
    return metrics.compare_models(rows.select(ID, POS, F.col(VALUE).alias("y_true")), made, [ID, POS])


@query()
def gbm_bands(spark, d):
    return simulate.bands(simulate.black_scholes(frame.orders_by_day(spark, d), 10, 500, 7), [ID, "h"])


@query(f"WITH {DAYS}, x AS (SELECT t, value, ln(value / lag(value) OVER (ORDER BY t)) AS r FROM e) SELECT {r('arg_max(value, t)', 'spot')}, {r('avg(r) - 0.5 * var_samp(r)', 'drift')}, {r('stddev_samp(r)', 'volatility')} FROM x")
def return_statistics(spark, d):
    return simulate.return_statistics(frame.orders_by_day(spark, d)).drop(ID)


@query()
def synthetic_control(spark, d):
    return forecast.synthetic_control(frame.events_by_type_day(spark, d), "view", 20)[0]
