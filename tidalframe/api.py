"""All public names in one place; functions take and give panels (see ``frame``)."""

from __future__ import annotations

from .__main__ import main, print_info, print_version  # noqa: F401
from .base import BaseDetector, BaseEstimator, BaseFeaturizer, BaseForecaster, BaseObject, BaseTransformer, get_tags, set_tags  # noqa: F401
from .compose import BacktestResult, DetectTask, FeatureUnion, Forecast, ForecasterPipeline, ForecastTask, ModelComparison, ModelResult, Pipeline, SeriesToTableAdapter, TableToSeriesAdapter, make_pipeline  # noqa: F401
from .compose import make_forecaster_pipeline as make_forecaster_pipeline
from .errors import ConfigurationError, DataError, EngineError, ForecastError, NotFittedError, PipelineError, TransformError, UnsupportedOperationError, ValidationError  # noqa: F401
from .estimators import *  # noqa: F403
from .frame import assert_panel, assert_series, assert_table, check_data_alignment, ensure_datetime_index, ensure_panel_like, ensure_series_like, is_panel, is_series, is_table, to_dataframe, to_series, validate_data_quality, validate_forecast_horizon, validate_input  # noqa: F401
from .functions import columns as _columns
from .functions.metrics import bias, compare_models, mae, mape, r2_score, rmse, smape, ubrmse  # noqa: F401
from .log import configure_logging, get_logger  # noqa: F401
from .model import get_model_metadata, load_model, save_model  # noqa: F401
from .operators import causal, clean, detect, distances, graph, models, simulate, stats
from .plans.backtest import ExpandingWindowSplit, SlidingWindowSplit, summarize_backtest  # noqa: F401
from .plans.backtest import backtest as backtest_forecaster  # noqa: F401
from .sources.loaders import load_fred, load_ts_data, load_yahoo  # noqa: F401
from .sources.sinks import draw, plot_autocorrelation_data, plot_forecast_data, plot_monte_carlo_data, plot_multiple_series_data, plot_residuals_data, plot_timeseries_data  # noqa: F401

# Series
resample_ts, detect_frequency, split_ts, train_test_split = clean.resample, clean.detect_frequency, clean.split, clean.train_test_split
fill_missing_dates, remove_outliers_iqr, detect_anomalies_mad = clean.fill_missing_dates, clean.remove_outliers_iqr, clean.detect_anomalies_mad
create_sequences, create_sequences_with_exog, ts_to_windows, coarse_grain = clean.sequences, clean.sequences, clean.sliding_windows, clean.coarse_grain
create_lags_vectorized, rolling_statistics = _columns.lags, _columns.rollings
autocorrelation, partial_autocorrelation, autocorrelation_plot_data = stats.autocorrelation, stats.partial_autocorrelation, stats.autocorrelation_plot_data
detect_trend, detect_seasonality = stats.detect_trend, stats.detect_seasonality
compute_climatology, compute_anomalies, detect_extreme_events = stats.climatology, stats.anomalies, stats.extreme_events
test_stationarity, is_stationary, basic_stationarity_test = models.stationarity, models.is_stationary, models.split_half_p
preprocess_for_changepoint = detect.preprocess_for_changepoint
monte_carlo_simulation, black_scholes_monte_carlo = simulate.geometric_paths, simulate.black_scholes
bootstrap_confidence_intervals = models.bootstrap_intervals


def rolling_mean(window: int, min_periods: int = 1):
    return _columns.rolling("mean", window, min_periods)


def rolling_std(window: int):
    return _columns.rolling("std", window)


def rolling_min(window: int):
    return _columns.rolling("min", window)


def rolling_max(window: int):
    return _columns.rolling("max", window)


def rolling_median(window: int):
    return _columns.rolling("median", window)


def parametric_confidence_intervals(forecaster, forecast_steps: int, confidence: float = 0.95):
    """The interval of a fitted forecaster's own variance."""
    return forecaster.predict_interval(forecast_steps, coverage=confidence)


# Distances, graphs, causality
correlation_distance, cross_correlation_distance = distances.correlation, distances.cross_correlation
dtw_distance, euclidean_distance, manhattan_distance = distances.dtw, distances.euclidean, distances.manhattan
Graph, build_hvg, build_nvg = graph.Graph, graph.build_hvg, graph.build_nvg
build_recurrence_network, build_transition_network, build_windows = graph.recurrence, graph.transitions, graph.build_windows
net_knn, net_enn = graph.net_knn, graph.net_enn
compute_clustering, compute_path_lengths, compute_modularity = graph.clustering, models.path_lengths, models.modularity
node_roles, directed_3node_motifs, undirected_4node_motifs = models.roles, graph.motifs3, models.motifs4
generate_surrogate, compute_network_metric_significance = models.surrogates, models.metric_significance
transfer_entropy, conditional_transfer_entropy, transfer_entropy_network = causal.transfer_entropy, causal.conditional_transfer_entropy, causal.transfer_entropy_network


def network_metrics(edges, nodes, include: tuple[str, ...] = ("clustering", "paths", "modularity")):
    """Clustering, path lengths and modularity of each graph, joined."""
    parts = {"clustering": graph.clustering, "paths": models.path_lengths, "modularity": models.modularity}
    out = nodes
    for name in include:
        out = out.join(parts[name](edges, nodes), "g")
    return out


def graph_summary(edges, nodes, motifs: bool = False):
    """Size, degrees, clustering, paths and small-world sigma; counts of three-node motifs on request."""
    out = graph.small_world(edges, nodes, models.path_lengths(edges, nodes))
    if motifs:
        from pyspark.sql import functions as F

        counts = graph.motifs3(edges, nodes).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("motifs_3"))
        out = out.join(counts, "g", "left")
    return out
