"""Queries over sequential models and random ones; where SQL cannot hold them, tests hold the kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frame
from ..kernels import series
from ..operators import detect, graph, models, moments, simulate
from . import backtest as bt
from .catalog import MONTHS, TYPES, query

ID, POS, VALUE = frame.ID, frame.POS, frame.VALUE


def typed(spark, d):
    return frame.events_by_type_day(spark, d)


@query()
def kalman_forecast(spark, d):
    return models.kalman(typed(spark, d), 5)


@query()
def exponential_smoothing(spark, d):
    return models.exponential_smoothing(typed(spark, d), 5, "add", "add", 7)


@query()
def arima_forecast(spark, d):
    return models.arima(typed(spark, d), 5)


@query()
def var_forecast(spark, d):
    return moments.vector_autoregression(typed(spark, d), 5, 3)


# Second-order model of the levels: pairwise moments, Gauss-Jordan steps on the normal equations, then the recursion.
_VAR = f"""WITH RECURSIVE {TYPES}, names AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS i, count(*) OVER () AS k, avg(value) AS mean FROM e GROUP BY 1),
z AS (SELECT e.series_id, t, i, k, value - mean AS y FROM e JOIN names USING (series_id)), span AS (SELECT min(t) AS lo, max(t) AS hi, max(k) AS k FROM z),
cells AS (SELECT z.t + a AS t, 1 + a * z.k + i AS c, y FROM z, range(0, 3) r(a), span WHERE z.t + a BETWEEN lo + 2 AND hi UNION ALL SELECT DISTINCT z.t, 0, 1.0 FROM z, span WHERE z.t BETWEEN lo + 2 AND hi),
g AS (SELECT p.c AS i, q.c AS j, avg(p.y * q.y) AS m FROM cells p JOIN cells q ON p.t = q.t GROUP BY 1, 2),
pl AS (SELECT DISTINCT i AS r, CASE WHEN i = 0 THEN 0 ELSE i - k END AS place FROM g, span WHERE i = 0 OR i > k),
body AS (SELECT pl.place AS r, list(g.m ORDER BY g.j > 0 AND g.j <= k, g.j) AS line FROM pl JOIN g ON g.i = pl.r, span GROUP BY 1),
gauss AS (SELECT 1 AS step, list(line ORDER BY r) AS m FROM body UNION ALL SELECT step + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m[1]) + 1), lambda j: CASE WHEN i = step THEN m[step][j] / m[step][step] ELSE m[i][j] - m[i][step] * m[step][j] / m[step][step] END)) FROM gauss WHERE step <= len(m)),
coef AS (SELECT list_transform(m, lambda x: x[len(m) + 1:]) AS b FROM gauss WHERE step = len(m) + 1),
cov AS (SELECT names.i, any_value(y.m) - sum(b[pl.place + 1][names.i + 1] * x.m) AS v FROM names, coef, pl JOIN g x ON x.i = pl.r JOIN g y ON y.i = x.j AND y.j = x.j WHERE x.j = names.i + 1 GROUP BY 1),
newest AS (SELECT list(coalesce(p.y, 0) ORDER BY n.i) AS r0, list(coalesce(q.y, 0) ORDER BY n.i) AS r1 FROM span, names n LEFT JOIN z p ON p.i = n.i AND p.t = (SELECT hi FROM span) LEFT JOIN z q ON q.i = n.i AND q.t = (SELECT hi FROM span) - 1),
f AS (SELECT 0 AS h, r0, r1 FROM newest UNION ALL SELECT h + 1, list_transform(range(1, len(r0) + 1), lambda i: b[1][i] + list_sum(list_transform(range(1, len(r0) + 1), lambda j: b[1 + j][i] * r0[j] + b[1 + len(r0) + j][i] * r1[j]))), r0 FROM f, coef WHERE h < 5)
SELECT n.series_id, CAST(h AS INT) AS h, CAST(hi + h AS BIGINT) AS t, round(r0[n.i + 1] + mean, 6) AS y_pred, round(r0[n.i + 1] + mean - 1.6448536269514722 * sqrt(v), 6) AS lower, round(r0[n.i + 1] + mean + 1.6448536269514722 * sqrt(v), 6) AS upper FROM f, span, names n JOIN cov ON cov.i = n.i WHERE h > 0"""


@query(_VAR)
def var_levels(spark, d):
    return moments.vector_autoregression(typed(spark, d), 5, difference=False, lag=2)


_KPSS = f"""WITH {MONTHS}, y AS (SELECT series_id, t, value - avg(value) OVER (PARTITION BY series_id) AS y, count(*) OVER (PARTITION BY series_id) AS n FROM e), k AS (SELECT *, CAST(floor(4 * pow(n / 100.0, 0.25)) AS BIGINT) AS k, sum(y) OVER (PARTITION BY series_id ORDER BY t) AS c FROM y),
s AS (SELECT series_id, max(n) AS n, sum(c * c) AS cc, sum(y * y) AS yy FROM k GROUP BY 1), w AS (SELECT a.series_id, sum(2 * (1 - (b.t - a.t) / (a.k + 1.0)) * a.y * b.y) AS v FROM k a JOIN k b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 1 AND a.k GROUP BY 1),
x AS (SELECT series_id, n, cc / n / (yy + coalesce(v, 0)) AS kpss FROM s LEFT JOIN w USING (series_id))
SELECT series_id, n, round(kpss, 6) AS kpss, round(CASE WHEN kpss <= 0.347 THEN 0.1 WHEN kpss <= 0.463 THEN 0.1 - (kpss - 0.347) / 0.116 * 0.05 WHEN kpss <= 0.574 THEN 0.05 - (kpss - 0.463) / 0.111 * 0.025 WHEN kpss <= 0.739 THEN 0.025 - (kpss - 0.574) / 0.165 * 0.015 ELSE 0.01 END, 6) AS kpss_p FROM x"""


@query(_KPSS)
def stationarity_of_levels(spark, d):
    return moments.level_tests(frame.orders_by_priority_month(spark, d))


@query()
def bayesian_forecast(spark, d):
    return models.bayesian(typed(spark, d), 5)


@query()
def recurrent_forecast(spark, d):
    return models.recurrent(typed(spark, d), 5)


@query()
def ensemble_forecast(spark, d):
    from ..estimators import EnsembleForecaster

    return EnsembleForecaster(n_estimators=20).fit(typed(spark, d)).predict(7)


@query()
def backtest_kalman(spark, d):
    return bt.per_fold(bt.backtest_grouped(typed(spark, d), lambda y, h: series.kalman_trend(y, h)[:, 0], bt.ExpandingWindowSplit(24, 1, 3)))


@query()
def bootstrap_intervals(spark, d):
    return models.bootstrap_intervals(typed(spark, d), lambda y, h: series.holt_winters(y, h, "add"), 3, 100)


@query()
def monte_carlo_forecast(spark, d):
    from ..operators.forecast import naive

    e = typed(spark, d)
    return simulate.monte_carlo(e, naive().predict(naive().fit(e), 3), 1000, 1.0, 5)


@query()
def gbm_paths(spark, d):
    y = simulate.return_statistics(frame.orders_by_day(spark, d)).select("spot", "drift", "volatility")
    spot, drift, spread = y.first()
    return simulate.bands(simulate.geometric_paths(spark, spot, drift, spread, 20, 500, 3), ["step"])


@query()
def pelt_changes(spark, d):
    return models.pelt_detector(typed(spark, d)).select(ID, POS, "flag")


@query()
def bayesian_changes(spark, d):
    return models.bayesian_changepoint(detect.preprocess_for_changepoint(typed(spark, d)), 20.0).select(ID, POS, "score", "flag")


@query()
def butterworth_filter(spark, d):
    return models.butterworth(typed(spark, d)).select(ID, POS, "value")


_SAVGOL = (
    f"WITH {TYPES}, n AS (SELECT series_id, max(t) AS last FROM e GROUP BY 1), w AS (SELECT a.series_id, a.t, least(greatest(a.t, 3), last - 3) AS mid, a.t - least(greatest(a.t, 3), last - 3) AS x FROM e a JOIN n USING (series_id)), "
    "f AS (SELECT w.series_id, w.t, w.x, sum(b.value) AS s0, sum((b.t - w.mid) * b.value) AS s1, sum((b.t - w.mid) * (b.t - w.mid) * b.value) AS s2 FROM w JOIN e b ON b.series_id = w.series_id AND b.t BETWEEN w.mid - 3 AND w.mid + 3 GROUP BY 1, 2, 3) "
    "SELECT series_id, t, round((s0 * 196 - s2 * 28) / 588 + x * s1 / 28 + x * x * (7 * s2 - 28 * s0) / 588, 6) AS value FROM f"
)


@query(_SAVGOL)
def savitzky_golay(spark, d):
    return models.savitzky_golay(typed(spark, d), 7, 2).select(ID, POS, "value")


@query()
def wavelet_denoise(spark, d):
    return models.wavelet_denoise(typed(spark, d), 3).select(ID, POS, "value")


@query()
def wavelet_detector(spark, d):
    return models.wavelet_detector(typed(spark, d), 3).select(ID, POS, "score", "flag")


@query()
def outliers_isolation_forest(spark, d):
    return models.remove_outliers_isolation(typed(spark, d)).select(ID, POS, "value")


@query()
def stationarity_tests(spark, d):
    return models.stationarity(frame.orders_by_priority_month(spark, d))


@query()
def stationarity_split_half_p(spark, d):
    return models.split_half_p(typed(spark, d))


@query()
def surrogate_series(spark, d):
    return models.surrogates(typed(spark, d), "iaaft", 3)


@query()
def metric_significance(spark, d):
    def metric(y):
        import numpy as np

        return float(np.corrcoef(y[:-1], y[1:])[0, 1])

    return models.metric_significance(typed(spark, d), metric, count=200)


def _graph(spark, d):
    e = typed(spark, d)
    return graph.visibility(e), graph.nodes_of(e)


_PATHS = (
    f"WITH RECURSIVE {TYPES}, pr AS (SELECT a.series_id AS g, a.t AS src, b.t AS dst, (b.value - a.value) / (b.t - a.t) AS slope FROM e a JOIN e b ON a.series_id = b.series_id AND a.t < b.t), "
    "vis AS (SELECT g, src, dst FROM (SELECT *, max(slope) OVER (PARTITION BY g, src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM pr) WHERE top IS NULL OR slope > top), "
    "nb AS (SELECT g, src AS a, dst AS b FROM vis UNION ALL SELECT g, dst, src FROM vis), "
    "reach AS (SELECT series_id AS g, t AS s, t AS u, 0 AS hops FROM e UNION SELECT r.g, r.s, nb.b, r.hops + 1 FROM reach r JOIN nb ON nb.g = r.g AND nb.a = r.u WHERE r.hops < 12), "
    "d AS (SELECT g, s, u, min(hops) AS hops FROM reach GROUP BY 1, 2, 3), far AS (SELECT g, s, max(hops) AS ecc FROM d GROUP BY 1, 2) "
    "SELECT d.g, round(sum(hops) / count(*) FILTER (hops > 0), 6) AS avg_path, CAST(max(f.hi) AS DOUBLE) AS diameter, CAST(max(f.lo) AS DOUBLE) AS radius, round(max(f.sd), 6) AS eccentricity_std FROM d JOIN (SELECT g, max(ecc) AS hi, min(ecc) AS lo, stddev_pop(ecc) AS sd FROM far GROUP BY 1) f ON f.g = d.g GROUP BY 1"
)


@query(_PATHS)
def path_lengths(spark, d):
    return models.path_lengths(*_graph(spark, d))


@query()
def modularity(spark, d):
    return models.modularity(*_graph(spark, d))


@query()
def node_roles(spark, d):
    return models.roles(*_graph(spark, d)).select("g", "node", "degree", "core", "role")


_FOUR = f"""WITH {TYPES}, pr AS (SELECT a.series_id AS g, a.t AS src, b.t AS dst, (b.value - a.value) / (b.t - a.t) AS slope FROM e a JOIN e b ON a.series_id = b.series_id AND a.t < b.t),
ed AS (SELECT g, src, dst FROM (SELECT *, max(slope) OVER (PARTITION BY g, src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM pr) WHERE top IS NULL OR slope > top),
q AS (SELECT a.series_id AS g, [a.t, b.t, c.t, d.t] AS p FROM e a JOIN e b ON b.series_id = a.series_id AND a.t < b.t JOIN e c ON c.series_id = a.series_id AND b.t < c.t JOIN e d ON d.series_id = a.series_id AND c.t < d.t),
x AS (SELECT q.g, [CAST(e1.src IS NOT NULL AS INT), CAST(e2.src IS NOT NULL AS INT), CAST(e3.src IS NOT NULL AS INT), CAST(e4.src IS NOT NULL AS INT), CAST(e5.src IS NOT NULL AS INT), CAST(e6.src IS NOT NULL AS INT)] AS b FROM q LEFT JOIN ed e1 ON e1.g = q.g AND e1.src = p[1] AND e1.dst = p[2] LEFT JOIN ed e2 ON e2.g = q.g AND e2.src = p[1] AND e2.dst = p[3] LEFT JOIN ed e3 ON e3.g = q.g AND e3.src = p[1] AND e3.dst = p[4] LEFT JOIN ed e4 ON e4.g = q.g AND e4.src = p[2] AND e4.dst = p[3] LEFT JOIN ed e5 ON e5.g = q.g AND e5.src = p[2] AND e5.dst = p[4] LEFT JOIN ed e6 ON e6.g = q.g AND e6.src = p[3] AND e6.dst = p[4]),
c AS (SELECT g, list_sum(b) AS m, [b[1] + b[2] + b[3], b[1] + b[4] + b[5], b[2] + b[4] + b[6], b[3] + b[5] + b[6]] AS d FROM x)
SELECT g, CASE WHEN m = 6 THEN 'clique' WHEN m = 5 THEN 'diamond' WHEN m = 4 AND list_max(d) = 2 THEN 'square' WHEN m = 4 THEN 'triangle_tail' WHEN m = 3 AND list_min(d) = 0 THEN 'triangle_isolated' WHEN m = 3 AND list_max(d) = 3 THEN 'star' WHEN m = 3 THEN 'chain' ELSE 'other' END AS motif, count(*) AS n FROM c GROUP BY 1, 2"""


@query(_FOUR)
def motifs_4(spark, d):
    return models.motifs4(*_graph(spark, d))


@query()
def graph_summary(spark, d):
    e, n = _graph(spark, d)
    return graph.small_world(e, n, models.path_lengths(e, n)).select("g", "n_nodes", "n_edges", "density", "average", "avg_path", "assortativity", "sigma")


_WAVE = f"{MONTHS}, mw AS (SELECT series_id, t, value * 0.01 + 1000000 * cos(2 * pi() * t / 12) AS value FROM e), fw AS (SELECT series_id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM mw GROUP BY 1), g AS (SELECT series_id, t, value - a - b * t AS x FROM mw JOIN fw USING (series_id))"


@query(
    f"WITH {_WAVE}, s0 AS (SELECT series_id, sum(x * x) AS q FROM g GROUP BY 1), c AS (SELECT p.series_id, k.k, sum(p.x * g.x) / min(q) AS r FROM range(1, 25) k(k) JOIN g p ON TRUE JOIN g ON g.series_id = p.series_id AND g.t = p.t + k.k JOIN s0 ON s0.series_id = p.series_id GROUP BY 1, 2), "
    "o AS (SELECT *, lag(r) OVER v AS before, lead(r) OVER v AS after FROM c WINDOW v AS (PARTITION BY series_id ORDER BY k)), f AS (SELECT series_id, min(k) AS period FROM o WHERE r >= 0.3 AND r > before AND r > after GROUP BY 1), "
    "h AS (SELECT g.series_id, period, t % period AS ph, x FROM g JOIN f USING (series_id)), m AS (SELECT series_id, ph, avg(x) AS m FROM h GROUP BY 1, 2), z AS (SELECT series_id, ph, m - avg(m) OVER (PARTITION BY series_id) AS s FROM m) "
    "SELECT h.series_id, CAST(period AS INT) AS period, round(var_pop(s) / var_pop(x), 6) AS strength FROM h JOIN z ON z.series_id = h.series_id AND z.ph = h.ph GROUP BY 1, 2"
)
def seasonal_period(spark, d):
    from ..operators.stats import detect_seasonality

    e = frame.orders_by_priority_month(spark, d)
    wave = e.withColumn(VALUE, F.col(VALUE) * 0.01 + 1000000 * F.cos(2 * F.pi() * F.col(POS) / 12))
    return detect_seasonality(wave, 24).select(ID, F.col("period").cast("int").alias("period"), "strength")
