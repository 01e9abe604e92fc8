"""Estimator classes: thin parameter holders over the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseDetector, BaseFeaturizer, BaseForecaster, BaseTransformer
from .frame import ID, POS, TIME, VALUE, WHOLE, W, validate_forecast_horizon
from .functions import columns
from .operators import causal, clean, detect, forecast, graph, models, moments, simulate, stats

KEYS = (ID, POS, TIME)


def keys_of(df: DataFrame) -> list[str]:
    return [c for c in KEYS if c in df.columns]


# Transformers


@dataclass
class LogTransformer(BaseTransformer):
    offset: float = 1.0

    def transform(self, y, X=None):
        return clean.log_transform(y, self.offset)

    def inverse_transform(self, y, X=None):
        return clean.log_inverse(y, self.offset)


@dataclass
class OutlierRemover(BaseTransformer):
    factor: float = 1.5

    def transform(self, y, X=None):
        return clean.remove_outliers_iqr(y, self.factor, self._check_is_fitted())


@dataclass
class HampelOutlierRemover(BaseTransformer):
    window: int = 10
    n_sigma: float = 3.0

    def transform(self, y, X=None):
        return clean.remove_outliers_hampel(y, self.window, self.n_sigma)


@dataclass
class ZScoreOutlierRemover(BaseTransformer):
    window: int = 10
    z_threshold: float = 3.0
    use_log: bool = True

    def transform(self, y, X=None):
        return clean.remove_outliers_zscore(y, self.window, self.z_threshold, self.use_log)


@dataclass
class IsolationForestOutlierRemover(BaseTransformer):
    contamination: float = 0.1
    random_state: int | None = None
    window: int = 10

    def transform(self, y, X=None):
        return models.remove_outliers_isolation(y, self.contamination, self.window, self.random_state or 0)


@dataclass
class MissingValueFiller(BaseTransformer):
    method: str = "forward"

    def transform(self, y, X=None):
        return clean.fill_missing(y, self.method)


@dataclass
class MissingDateFiller(BaseTransformer):
    method: str = "forward"
    freq: str = "D"

    def transform(self, y, X=None):
        return clean.fill_missing_dates(y, self.method, self.freq)


@dataclass
class Resampler(BaseTransformer):
    freq: str = "D"
    method: str = "mean"

    def transform(self, y, X=None):
        return clean.resample(y, self.freq, self.method)


@dataclass
class DetrendTransformer(BaseTransformer):
    """transform adds ``trend`` and ``detrended`` and sets value to the latter."""

    method: str = "linear"

    def transform(self, y, X=None):
        return stats.detrend(y, self.method).withColumn(VALUE, F.col("detrended"))

    def inverse_transform(self, y, X=None):
        return y.withColumn(VALUE, F.col(VALUE) + F.col("trend")).drop("trend", "detrended")


@dataclass
class DeseasonalizeTransformer(BaseTransformer):
    seasonal_period: int = 7

    def transform(self, y, X=None):
        return stats.deseasonalize(y, self.seasonal_period).withColumn(VALUE, F.col("deseasonalized"))

    def inverse_transform(self, y, X=None):
        return y.withColumn(VALUE, F.col(VALUE) + F.col("seasonal")).drop("seasonal", "deseasonalized")


@dataclass
class DecomposeTransformer(BaseTransformer):
    seasonal_period: int = 7

    def transform(self, y, X=None):
        return stats.decompose(y, self.seasonal_period).withColumn(VALUE, F.col("residual"))

    def inverse_transform(self, y, X=None):
        return y.withColumn(VALUE, F.col(VALUE) + F.col("trend") + F.col("seasonal")).drop("trend", "seasonal", "residual")

    def get_components(self, y: DataFrame) -> DataFrame:
        return stats.decompose(y, self.seasonal_period)


@dataclass
class ButterworthFilter(BaseTransformer):
    cutoff_freq: float = 0.1
    filter_order: int = 4
    btype: str = "low"

    def transform(self, y, X=None):
        return models.butterworth(y, self.cutoff_freq, self.filter_order, self.btype)


@dataclass
class SavitzkyGolayFilter(BaseTransformer):
    window_length: int = 5
    polyorder: int = 2

    def transform(self, y, X=None):
        return models.savitzky_golay(y, self.window_length, self.polyorder)


@dataclass
class WaveletDenoiser(BaseTransformer):
    threshold_mode: str = "soft"
    level: int = 5

    def transform(self, y, X=None):
        return models.wavelet_denoise(y, self.level, self.threshold_mode)


# Featurizers: ``columns()`` are merged by FeatureUnion into one select.


class ColumnFeaturizer(BaseFeaturizer):
    def columns(self) -> dict:
        raise NotImplementedError

    def transform(self, y, X=None):
        return y.select(*keys_of(y), *([VALUE] if VALUE in y.columns else []), *[c.alias(n) for n, c in self.columns().items()])


@dataclass
class LagFeaturizer(ColumnFeaturizer):
    lags: list[int] = field(default_factory=lambda: [1, 2, 3, 7, 14])
    include_diff: bool = False
    include_pct_change: bool = False
    seasonal_lags: list[int] | None = None
    prevent_leads: bool = True

    def columns(self):
        return columns.lags(self.lags, self.include_diff, self.include_pct_change, self.seasonal_lags, self.prevent_leads)


@dataclass
class RollingFeaturizer(ColumnFeaturizer):
    windows: list[int] = field(default_factory=lambda: [7, 14, 30])
    functions: list[str] = field(default_factory=lambda: ["mean", "std"])

    def columns(self):
        return columns.rollings(self.windows, self.functions)


@dataclass
class TimeFeaturizer(ColumnFeaturizer):
    features: list[str] | None = None

    def columns(self):
        return {n: c for n, c in columns.calendar().items() if (n != "hour" if self.features is None else n in self.features)}


@dataclass
class DifferencingFeaturizer(ColumnFeaturizer):
    orders: list[int] = field(default_factory=lambda: [1])

    def columns(self):
        return columns.differences(self.orders)


@dataclass
class SeasonalFeaturizer(ColumnFeaturizer):
    seasonal_periods: list[float] = field(default_factory=lambda: [7])

    def columns(self):
        return columns.fourier(self.seasonal_periods)


@dataclass
class DegradationRateFeaturizer(BaseFeaturizer):
    periods: list[int] = field(default_factory=lambda: [1, 3, 5])

    def transform(self, y, X=None):
        rows = y.withColumn("__filled", columns.filled_forward())
        return rows.select(*keys_of(y), VALUE, *[c.alias(n) for n, c in columns.degradation(self.periods).items()])


class GraphFeaturizer(BaseFeaturizer):
    include_degrees = True

    def edges(self, y: DataFrame) -> DataFrame:
        raise NotImplementedError

    def nodes(self, y: DataFrame) -> DataFrame:
        return graph.nodes_of(y)

    def transform(self, y, X=None):
        rows = graph.renumber_finite(y)
        e, n = self.edges(rows), self.nodes(rows)
        out = graph.features(e, n)
        return out.join(graph.degree_arrays(e, n), "g") if self.include_degrees else out


@dataclass
class HVGFeaturizer(GraphFeaturizer):
    """The natural line-of-sight test by default; ``strict_horizontal`` for the horizontal one."""

    weighted: bool = False
    limit: int | None = None
    include_degrees: bool = True
    strict_horizontal: bool = False

    def edges(self, y):
        return graph.visibility(y, "difference" if self.weighted else None, self.limit, self.strict_horizontal)


@dataclass
class NVGFeaturizer(GraphFeaturizer):
    weighted: bool = False
    limit: int | None = None
    include_degrees: bool = True

    def edges(self, y):
        return graph.visibility(y, "length" if self.weighted else None, self.limit)


@dataclass
class RecurrenceNetworkFeaturizer(GraphFeaturizer):
    threshold: float | None = None
    embedding_dimension: int = 1
    time_delay: int = 1
    metric: str = "euclidean"
    k: int | None = None
    include_degrees: bool = True

    def edges(self, y):
        return graph.recurrence(y, self.threshold, self.embedding_dimension, self.time_delay, self.metric, self.k)


@dataclass
class TransitionNetworkFeaturizer(GraphFeaturizer):
    n_bins: int = 10
    order: int = 1
    ordinal: int | None = None
    include_degrees: bool = True

    def edges(self, y):
        return graph.transitions(y, self.n_bins, self.order, self.ordinal)

    def nodes(self, y):
        return graph.symbols(y, self.n_bins, self.ordinal).groupBy("g").agg((F.max("s") + 1).cast("long").alias("n"))


# Forecasters


class ClosedFormForecaster(BaseForecaster):
    def closed_form(self) -> forecast.ClosedForm:
        raise NotImplementedError

    def _fit(self, y, X):
        self._state = self.closed_form().fit(y)

    def predict(self, fh, X=None):
        self._check_is_fitted()
        validate_forecast_horizon(fh)
        return self.closed_form().predict(self._state, fh)


@dataclass
class NaiveForecaster(ClosedFormForecaster):
    def closed_form(self):
        return forecast.naive()


@dataclass
class SimpleMovingAverageForecaster(ClosedFormForecaster):
    window: int = 7

    def closed_form(self):
        return forecast.moving_average(self.window)


@dataclass
class ExponentialMovingAverageForecaster(ClosedFormForecaster):
    alpha: float = 0.3

    def closed_form(self):
        return forecast.exponential_average(self.alpha)


@dataclass
class WeightedMovingAverageForecaster(ClosedFormForecaster):
    window: int = 7
    weights: list[float] | None = None

    def closed_form(self):
        return forecast.weighted_average(self.weights or [1 / self.window] * self.window)


@dataclass
class LinearTrendForecaster(ClosedFormForecaster):
    clamp: bool = True

    def closed_form(self):
        return forecast.linear_trend(self.clamp)


class KernelForecaster(BaseForecaster):
    default_coverage = 0.9

    def run(self, y: DataFrame, fh: int, coverage: float) -> DataFrame:
        raise NotImplementedError

    def predict(self, fh, X=None):
        steps = list(range(1, fh + 1)) if isinstance(fh, int) else validate_forecast_horizon(fh)
        return self.run(self._check_is_fitted(), max(steps), self.default_coverage).filter(F.col("h").isin(steps))

    def predict_interval(self, fh, X=None, coverage=0.9):
        steps = list(range(1, fh + 1)) if isinstance(fh, int) else validate_forecast_horizon(fh)
        return self.run(self._check_is_fitted(), max(steps), coverage).filter(F.col("h").isin(steps))


@dataclass
class KalmanFilterForecaster(KernelForecaster):
    measurement_noise: float = 5.0
    process_noise: float = 0.1
    initial_covariance: float = 1000.0
    dt: float = 1.0

    def run(self, y, fh, coverage):
        return models.kalman(y, fh, coverage, measurement_noise=self.measurement_noise, process_noise=self.process_noise, initial_covariance=self.initial_covariance, dt=self.dt)


@dataclass
class ExponentialSmoothingForecaster(KernelForecaster):
    trend: str | None = "add"
    seasonal: str | None = "add"
    seasonal_periods: int | None = None

    def run(self, y, fh, coverage):
        return models.exponential_smoothing(y, fh, self.trend, self.seasonal, self.seasonal_periods, coverage)


@dataclass
class ARIMAForecaster(KernelForecaster):
    max_p: int = 3
    max_d: int = 1
    max_q: int = 2

    def run(self, y, fh, coverage):
        return models.arima(y, fh, self.max_p, self.max_d, self.max_q, coverage)


@dataclass
class VARForecaster(KernelForecaster):
    maxlags: int = 10
    ic: str = "aic"
    force_differencing: bool = False

    def run(self, y, fh, coverage):
        return moments.vector_autoregression(y, fh, self.maxlags, self.ic, coverage, difference=True if self.force_differencing else None)


@dataclass
class BayesianForecaster(KernelForecaster):
    model_type: str = "linear_trend"
    n_samples: int = 2000
    random_state: int = 0

    def run(self, y, fh, coverage):
        return models.bayesian(y, fh, self.model_type, self.n_samples, self.random_state, coverage)

    def get_posterior_summary(self) -> DataFrame:
        return models.posterior_summary(self._check_is_fitted(), self.model_type, self.n_samples, self.random_state)


@dataclass
class LSTMForecaster(KernelForecaster):
    """A fixed random LSTM layer with a trained readout; no gradient training of the layer."""

    input_chunk_length: int = 12
    hidden_dim: int = 64
    random_state: int = 0

    def run(self, y, fh, coverage):
        return models.recurrent(y, fh, self.input_chunk_length, self.hidden_dim, self.random_state)


@dataclass
class BlackScholesMonteCarloForecaster(BaseForecaster):
    n_simulations: int = 1000
    random_state: int = 0

    def predict(self, fh, X=None):
        return simulate.bands(self.paths(fh), [ID, "h"])

    def paths(self, fh) -> DataFrame:
        return simulate.black_scholes(self._check_is_fitted(), fh, self.n_simulations, self.random_state)

    def predict_interval(self, fh, X=None, coverage=0.9):
        return simulate.interval(self.paths(fh), [ID, "h"], coverage)


@dataclass
class MonteCarloForecaster(BaseForecaster):
    base_forecaster: BaseForecaster = None
    n_samples: int = 1000
    random_state: int = 0
    noise_level: float | None = None

    def _fit(self, y, X):
        self.base_forecaster.fit(y, X)

    def predict(self, fh, X=None):
        return simulate.monte_carlo(self._check_is_fitted(), self.base_forecaster.predict(fh), self.n_samples, self.noise_level, self.random_state)

    def predict_interval(self, fh, X=None, coverage=0.9):
        samples = simulate.noisy(self._check_is_fitted(), self.base_forecaster.predict(fh), self.n_samples, self.noise_level, self.random_state)
        return simulate.interval(samples, [ID, "h"], coverage)


@dataclass
class SyntheticControlForecaster(BaseForecaster):
    """Fit on a panel of the treated series and its controls."""

    treated: str = "0"
    treatment_start: int = 0
    pre_period_min: int = 5

    def _fit(self, y, X):
        self._prediction, self._weights = forecast.synthetic_control(y, self.treated, self.treatment_start, self.pre_period_min)

    def predict(self, fh=None, X=None):
        self._check_is_fitted()
        return self._prediction

    def get_weights(self) -> dict[str, float]:
        return {n: w for n, w in self._weights.items() if w > 0.01}


@dataclass
class EnsembleForecaster(BaseForecaster):
    """Random forests of pyspark.ml: the direction first, then the next value from features and direction.

    One model for all series of the panel; the recursion extends the panel by one row a step.
    """

    n_lags: int = 2
    n_estimators: int = 20
    max_depth: int = 5
    random_state: int = 0

    def features(self, y: DataFrame) -> DataFrame:
        made = {f"lag_{k}": columns.lag_column(k) for k in range(1, self.n_lags + 1)} | {"diff": F.col(VALUE) - columns.lag_column(1), "ma_3": columns.rolling("mean", 3), "ma_5": columns.rolling("mean", 5)}
        return y.select(ID, POS, VALUE, *[c.alias(n) for n, c in made.items()]).dropna()

    def _fit(self, y, X):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import StandardScaler, VectorAssembler
        from pyspark.ml.regression import RandomForestRegressor

        rows = self.features(y).withColumn("__next", F.lead(VALUE).over(W)).dropna().withColumn("__up", (F.col("__next") > F.col(VALUE)).cast("double"))
        names = [c for c in rows.columns if c not in (ID, POS, "__next", "__up")]
        common = {"numTrees": self.n_estimators, "maxDepth": self.max_depth, "seed": self.random_state}
        self._model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), RandomForestClassifier(featuresCol="__x", labelCol="__up", predictionCol="__dir", probabilityCol="__pr", rawPredictionCol="__rw", **common), VectorAssembler(inputCols=["__x", "__dir"], outputCol="__y"), RandomForestRegressor(featuresCol="__y", labelCol="__next", predictionCol="__made", **common)]).fit(rows)

    def predict(self, fh, X=None):
        """One row a series holds its last values; each step appends to the array, so the plan grows by one model a step."""
        keep = max(5, self.n_lags + 1)
        rows = self._check_is_fitted().select(ID, POS, VALUE)
        last = rows.withColumn("__n", F.max(POS).over(WHOLE)).filter(F.col(POS) > F.col("__n") - keep)
        state = last.groupBy(ID).agg(F.max(POS).alias("__at"), F.transform(F.array_sort(F.collect_list(F.struct(POS, VALUE))), lambda p: p[VALUE]).alias("__v"))
        back = lambda k: F.get("__v", F.size("__v") - 1 - k)
        total = lambda k: F.aggregate(F.filter(F.slice("__v", F.greatest(F.lit(1), F.size("__v") - (k - 1)), k), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)
        seen = lambda k: F.size(F.filter(F.slice("__v", F.greatest(F.lit(1), F.size("__v") - (k - 1)), k), lambda x: x.isNotNull()))
        made = {VALUE: back(0)} | {f"lag_{k}": back(k) for k in range(1, self.n_lags + 1)} | {"diff": back(0) - back(1), "ma_3": total(3) / seen(3), "ma_5": total(5) / seen(5)}
        for _ in range(fh):
            new = self._model.transform(state.select(ID, "__at", "__v", *[c.alias(n) for n, c in made.items()]).dropna(subset=list(made)))
            state = new.select(ID, "__at", F.concat("__v", F.array("__made")).alias("__v"))
        steps = state.select(ID, "__at", F.posexplode(F.slice("__v", F.size("__v") - (fh - 1), fh)).alias("__k", "y_pred"))
        return steps.select(ID, (F.col("__k") + 1).alias("h"), (F.col("__at") + F.col("__k") + 1).alias(POS), "y_pred")


# Detectors


@dataclass
class SeasonalBaselineDetector(BaseDetector):
    seasonality: str = "week"
    threshold_sigma: float = 2.5

    def score(self, y, X=None):
        return detect.seasonal_baseline(y, self.seasonality, self.threshold_sigma, self._check_is_fitted())


@dataclass
class CUSUMDetector(BaseDetector):
    """Two-window mean shift; ``detect.cusum`` has the cumulative sums."""

    baseline_window: int = 10
    threshold: float = 3.0

    def score(self, y, X=None):
        return detect.mean_shift(y, self.baseline_window, self.threshold)


@dataclass
class MADDetector(BaseDetector):
    threshold_std: float = 3.0
    window: int = 3

    def score(self, y, X=None):
        rows = clean.detect_anomalies_mad(y, self.threshold_std, self.window)
        return rows.withColumn("score", F.col("anomaly").cast("double")).withColumnRenamed("anomaly", "flag")


@dataclass
class PELTDetector(BaseDetector):
    penalty: float | None = None
    model: str = "l2"
    min_size: int = 3
    jump: int = 1
    preprocess: bool = True

    def score(self, y, X=None):
        rows = detect.preprocess_for_changepoint(y) if self.preprocess else y
        return models.pelt_detector(rows, self.penalty, self.model, self.min_size, self.jump)


@dataclass
class BayesianChangePointDetector(BaseDetector):
    expected_segment_length: float = 100.0
    threshold: float = 0.5
    preprocess: bool = True

    def score(self, y, X=None):
        rows = detect.preprocess_for_changepoint(y) if self.preprocess else y
        return models.bayesian_changepoint(rows, self.expected_segment_length, self.threshold)


@dataclass
class WaveletDetector(BaseDetector):
    threshold_factor: float = 3.0
    level: int = 5

    def score(self, y, X=None):
        return models.wavelet_detector(y, self.level, self.threshold_factor)


@dataclass
class VotingEnsembleDetector(BaseDetector):
    detectors: list = field(default_factory=list)
    threshold: int = 2

    def _fit(self, y, X):
        for d in self.detectors:
            d.fit(y, X)

    def score(self, y, X=None):
        rows, names = y, []
        for k, d in enumerate(self.detectors):
            flags = d.predict(y).select(ID, POS, F.col("flag").alias(f"__f{k}"))
            rows, names = rows.join(flags, [ID, POS], "left"), [*names, f"__f{k}"]
        return detect.vote(rows, names, self.threshold).drop(*names)


@dataclass
class TransferEntropyDetector(BaseDetector):
    """score: transfer entropy from each series of X's panel to each of y's."""

    lag: int = 1
    bins: int = 10
    threshold: float | None = None

    def score(self, y, X=None):
        source = self._exogenous if X is None else X
        both = source.select(F.concat(F.lit("x:"), ID).alias(ID), POS, VALUE).unionByName(y.select(F.concat(F.lit("y:"), ID).alias(ID), POS, VALUE))
        xs, ys = source.select(F.concat(F.lit("x:"), ID).alias("x")).distinct(), y.select(F.concat(F.lit("y:"), ID).alias("y")).distinct()
        out = causal.transfer_entropy(both, xs.join(ys), self.lag, self.bins).withColumnRenamed("te", "score")
        return out.withColumn("flag", F.lit(None).cast("boolean") if self.threshold is None else F.col("score") >= self.threshold)


# External detectors by name

_REGISTRY: dict[str, Callable] = {}


def register_detector(name: str, factory: Callable) -> None:
    _REGISTRY[name] = factory


def list_external_detectors() -> list[str]:
    return sorted(_REGISTRY)


def get_external_detector(name: str, **params):
    return _REGISTRY[name](**params)


@dataclass
class ExternalDetectorAdapter(BaseDetector):
    """Runs any object with score_samples, decision_function, predict_proba or predict on each series' values."""

    detector: object = None
    detector_name: str | None = None
    detector_params: dict = field(default_factory=dict)

    def score(self, y, X=None):
        model = self.detector if self.detector is not None else get_external_detector(self.detector_name, **self.detector_params)

        def kernel(values):
            own = values.reshape(-1, 1)
            for name in ("fit", "train"):
                if hasattr(model, name):
                    getattr(model, name)(own)
                    break
            for name in ("score_samples", "decision_function", "score"):
                if hasattr(model, name):
                    return getattr(model, name)(own)
            return model.predict_proba(own)[:, -1] if hasattr(model, "predict_proba") else (model.predict if hasattr(model, "predict") else model.detect)(own)

        rows = models.along(y, kernel, "score")
        return rows.withColumn("flag", F.coalesce(F.col("score") > 0.5, F.lit(False)))


@dataclass
class MultiscaleGraphs(BaseFeaturizer):
    method: str = "hvg"
    scales: list[int] = field(default_factory=lambda: [1, 2, 4, 8, 16])
    coarse_method: str = "mean"

    def transform(self, y, X=None):
        rows = graph.multiscale(y, self.scales, self.coarse_method)
        out = graph.features(graph.build(rows, self.method), graph.nodes_of(rows))
        return out.select(F.substring_index("g", "@", 1).alias(ID), F.substring_index("g", "@", -1).cast("int").alias("scale"), *[c for c in out.columns if c != "g"])

    def scale_signature(self, y: DataFrame, column: str = "avg_degree") -> DataFrame:
        return self.transform(y).select(ID, "scale", column)
