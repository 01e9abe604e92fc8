"""Protocol, errors, kernels and invariants of the engine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe import compose, errors, estimators, frame, model
from tidalframe.base import get_tags
from tidalframe.functions import metrics
from tidalframe.kernels import series, special
from tidalframe.operators import causal, clean, detect, distances, forecast, graph, models, simulate, stats
from tidalframe.plans import backtest as bt


def values(df, column="value"):
    return [r[column] for r in df.orderBy("series_id", "t").collect()]


def test_errors():
    e = errors.DataError("bad", {"rows": 1})
    assert "[rows: 1]" in str(e) and isinstance(e, errors.EngineError)
    assert "x is not fitted" in str(errors.NotFittedError("x"))


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 2.5), ("a", 3.0, 2.5), ("z", 0.0, 1.0), ("c", 2.0, 2.0), ("c", 2.0, 2.0)], "k string, y_true double, y_pred double")
    rows = {r["k"]: r for r in metrics.evaluate(df, ["k"]).collect()}
    assert rows["a"]["mae"] == 0.5 and abs(rows["a"]["rmse"] - 0.5) < 1e-10
    assert rows["z"]["mape"] is None and rows["c"]["r2"] == 1.0


def test_splitters(make):
    y = make({"a": range(10), "short": range(3)})
    e = bt.ExpandingWindowSplit(3, 1, 2).folds(y).orderBy("fold_id").collect()
    assert [r["cutoff"] for r in e] == [3, 4, 5, 6, 7, 8] and all(r["series_id"] == "a" for r in e)
    s = bt.SlidingWindowSplit(3, 2, 2).folds(y).orderBy("fold_id").collect()
    assert [(r["start"], r["cutoff"]) for r in s] == [(0, 3), (2, 5), (4, 7)]


def test_backtest_nested_and_grouped(make):
    y = make({"a": range(20)})
    split = bt.ExpandingWindowSplit(15, 1, 2)
    closed = bt.backtest(y, forecast.naive(), split)
    same = bt.backtest_grouped(y, lambda v, h: np.full(h, v[-1]), split)
    assert sorted(closed.select("fold_id", "h", "y_pred").collect()) == sorted(same.select("fold_id", "h", "y_pred").collect())
    assert len(bt.nested(closed).first()["y_pred"]) == 2
    assert bt.summary(bt.per_fold(closed)).first()["mae_mean"] == 1.5


def test_panel_equals_single_series(make):
    a, b = [1, 4, 2, 8, 5, 7, 1], [9, 1, 1, 3, 5, 2, 2]
    both = values(clean.remove_outliers_iqr(make({"a": a, "b": b}), 0.2))
    one = values(clean.remove_outliers_iqr(make({"a": a}), 0.2)) + values(clean.remove_outliers_iqr(make({"b": b}), 0.2))
    assert both == one


def test_fill_and_empty(make, spark):
    y = make({"a": [None, 1, None, 3, None]})
    assert values(clean.fill_missing(y, "forward")) == [None, 1, 1, 3, 3]
    assert values(clean.fill_missing(y, "backward")) == [1, 1, 3, 3, None]
    assert values(clean.fill_missing(y, "interpolate")) == [None, 1, 2, 3, 3]
    empty = y.filter("t < 0")
    for out in (clean.fill_missing(empty), clean.resample(empty), stats.autocorrelation(empty, 3), detect.mean_shift(empty), graph.visibility(empty), causal.transfer_entropy_network(empty)):
        assert out.count() == 0


def test_resample_empty_buckets(make):
    y = make({"a": range(10)}).filter("t not in (3, 4)")
    assert values(clean.resample(y, "D", "sum"))[3:5] == [0, 0]
    assert values(clean.resample(y, "D", "mean"))[3:5] == [None, None]


def test_acf_and_transfer_entropy_invariants(make):
    r = np.random.default_rng(0)
    x = r.normal(size=200)
    y = np.roll(x, 1) + 0.1 * r.normal(size=200)
    df = make({"x": x, "y": y, "const": [1] * 200})
    acf = {(k["series_id"], k["lag"]): k["acf"] for k in stats.autocorrelation(df, 3).collect()}
    assert abs(acf["x", 0] - 1) < 1e-12 and acf["const", 1] == 0
    te = {(k["x"], k["y"]): k["te"] for k in causal.transfer_entropy_network(df, 1, 4).collect()}
    assert te["x", "y"] > te.get(("y", "x"), 0) and all(v >= 0 for v in te.values())
    phase = stats.seasonal_means(df, 7).groupBy("series_id").agg(F.sum("seasonal").alias("s")).collect()
    assert all(abs(p["s"]) < 1e-9 for p in phase)


def test_polynomial_and_centred_trend(make):
    df = make({"a": [3 + 2 * t + 0.5 * t * t for t in range(20)]})
    p = stats.detect_trend(df, "polynomial").first()
    assert abs(p["quadratic"] - 0.5) < 1e-9 and abs(p["slope"] - 2) < 1e-8 and abs(p["intercept"] - 3) < 1e-7 and abs(p["strength"] - 1) < 1e-9
    v = np.arange(20.0) ** 2
    got = values(stats.centred_mean(make({"a": v}), F.lit(4)), "trend")
    padded = np.concatenate([[v[0]] * 2, v, [v[-1]]])
    assert np.allclose(got, [padded[k : k + 4].mean() for k in range(20)])


def test_seasonality(make):
    s = stats.detect_seasonality(make({"a": [10 + 5 * np.sin(2 * np.pi * t / 12) for t in range(120)]}), 30).first()
    assert s["period"] == 12 and s["strength"] > 0.9


def test_median_filter_matches_reflection(make):
    v = np.random.default_rng(1).normal(size=30)
    for size in (5, 6):
        padded = np.concatenate([v[: size // 2][::-1], v, v[::-1][: size - 1 - size // 2]])
        want = [sorted(padded[k : k + size])[size // 2] for k in range(30)]
        assert np.allclose(values(detect.median_filter(make({"a": v}), size)), want)


def test_detectors(make):
    df = make({"a": [0.0, 0.1] * 20 + [9.0, 9.1] * 20})
    assert [k["t"] for k in detect.mean_shift(df, 10, 3).filter("flag").collect()][0] <= 40
    assert any(k["flag"] for k in detect.cusum(df).collect())
    pelt = estimators.PELTDetector(preprocess=False).fit(df).predict(df)
    assert [k["t"] for k in pelt.filter("flag").collect()] == [40]
    v = estimators.VotingEnsembleDetector([estimators.CUSUMDetector(), estimators.PELTDetector(preprocess=False), estimators.WaveletDetector(level=3)], 1).fit(df)
    assert v.predict(df).filter("flag").count() >= 1
    te = estimators.TransferEntropyDetector().fit(df, df).predict(df)
    assert te.count() == 1


def test_visibility_against_brute_force(make):
    v = np.random.default_rng(2).integers(0, 6, 25).astype(float)
    def seen(i, j):
        return all(v[k] < v[i] + (v[j] - v[i]) * (k - i) / (j - i) for k in range(i + 1, j))
    want = {(i, j) for i in range(25) for j in range(i + 1, 25) if seen(i, j)}
    got = {(r["src"], r["dst"]) for r in graph.visibility(make({"a": v})).collect()}
    assert got == want
    flat = {(i, j) for i in range(25) for j in range(i + 1, 25) if all(v[k] < min(v[i], v[j]) for k in range(i + 1, j))}
    assert {(r["src"], r["dst"]) for r in graph.visibility(make({"a": v}), horizontal=True).collect()} == flat


def test_graph_measures(make):
    df = make({"a": np.random.default_rng(3).normal(size=20)})
    e, n = graph.visibility(df), graph.nodes_of(df)
    assert 0 < graph.clustering(e, n).first()["average"] <= 1 and models.path_lengths(e, n).first()["diameter"] >= 2
    assert sum(r["n"] for r in models.motifs4(e, n).collect()) == 20 * 19 * 18 * 17 // 24
    assert estimators.HVGFeaturizer().fit(df).transform(df).first()["n_nodes"] == 20
    assert estimators.TransitionNetworkFeaturizer(4).fit(df).transform(df).first()["n_nodes"] <= 4


def test_kernels():
    y = np.sin(np.arange(120) / 6) + 0.05 * np.random.default_rng(0).normal(size=120)
    a, details, sizes = series.wavelet_details(y, 3)
    for d, s in zip(details[::-1], sizes[::-1], strict=True):
        a = series.wavelet_join(a[: len(d)], d, s)
    assert np.allclose(a, y)
    assert np.allclose(series.butterworth(np.full(60, 3.0)), 3) and np.allclose(series.savgol(np.arange(30.0) ** 2), np.arange(30.0) ** 2)
    assert np.allclose(series.kalman_trend(np.arange(60.0), 2)[:, 0], [60, 61], atol=1e-3)
    assert np.allclose(series.holt_winters(np.arange(60.0), 3)[:, 0], [60, 61, 62], atol=0.2)
    assert sorted(series.surrogate(y, "iaaft")) == pytest.approx(sorted(y))
    assert abs(np.abs(np.fft.rfft(series.surrogate(y, "phase"))) - np.abs(np.fft.rfft(y))).max() < 1e-9
    assert abs(special.t_two_sided(2.0, 10) - 0.07339) < 1e-4 and abs(special.normal_quantile(0.975) - 1.959964) < 1e-6
    assert series.dtw([1, 2, 3], [1, 2, 2, 3]) == 0
    m, order = series.arima(np.arange(50.0), 2)
    assert np.allclose(m[:, 0], [50, 51], atol=0.5)


def test_forecasters_and_composition(make, tmp_path, spark):
    df = make({"a": [10 + t for t in range(30)], "b": [5.0] * 30})
    p = compose.make_forecaster_pipeline(estimators.LogTransformer(), forecaster=estimators.LinearTrendForecaster())
    p.inverse = True
    p.fit(df)
    assert p.predict(2).count() == 4 and p.get_params()["step0__offset"] == 1.0
    with pytest.raises(errors.NotFittedError):
        estimators.NaiveForecaster().predict(1)
    with pytest.raises(errors.ValidationError):
        estimators.OutlierRemover().set_params(nope=1)
    pipe = compose.make_pipeline(estimators.LogTransformer(), estimators.MissingValueFiller()).fit(df)
    assert pipe.transform(df).count() == 60
    back = estimators.LogTransformer().fit(df)
    assert values(back.inverse_transform(back.transform(df))) == pytest.approx(values(df))
    u = compose.FeatureUnion([("lag", estimators.LagFeaturizer([1])), ("roll", estimators.RollingFeaturizer([3])), ("rate", estimators.DegradationRateFeaturizer([1]))]).fit(df).transform(df)
    assert {"lag__lag_1", "roll__rolling_mean_3", "rate__degradation_rate_1"} <= set(u.columns) and u.count() == 60
    path = str(tmp_path / "m")
    model.save_model(estimators.SimpleMovingAverageForecaster(5).fit(df), path)
    again = model.load_model(spark, path)
    assert again.window == 5 and again.predict(1).count() == 2 and model.get_model_metadata(spark, path)["class_name"] == "SimpleMovingAverageForecaster"
    assert get_tags(again, "requires_fh")
    d = estimators.DetrendTransformer().fit(df)
    assert values(d.inverse_transform(d.transform(df))) == pytest.approx(values(df))
    for f in (estimators.KalmanFilterForecaster(), estimators.ARIMAForecaster(), estimators.ExponentialSmoothingForecaster(seasonal=None), estimators.BlackScholesMonteCarloForecaster(50), estimators.MonteCarloForecaster(estimators.NaiveForecaster(), 50, 0, 0.1)):
        assert f.fit(df).predict(2).count() == 4
        assert f.predict_interval(2).count() == 4
    sc = estimators.SyntheticControlForecaster("a", 20).fit(make({"a": range(30), "c": range(30), "d": [9.0] * 30}))
    assert sc.get_weights() == pytest.approx({"c": 1.0}, abs=1e-3)


def test_frame_checks(make, spark):
    df = make({"a": [1, 2, 3]})
    frame.validate_input(df, "panel")
    with pytest.raises(errors.ValidationError):
        frame.assert_series(spark.createDataFrame([(1,)], "x int"))
    assert frame.validate_forecast_horizon(3) == [3] and frame.validate_forecast_horizon([1, 2]) == [1, 2]
    for bad in (0, [], [-1], [1.5]):
        with pytest.raises(errors.ValidationError):
            frame.validate_forecast_horizon(bad)
    with pytest.raises(errors.DataError):
        frame.validate_data_quality(df, min_length=5)
    frame.check_data_alignment(df, df)
    rows = spark.createDataFrame([("x", float("nan")), ("x", 1.0)], "k string, v double")
    assert values(frame.panel(rows, "v", series="k", tie=["v"])) == [1.0, None]


def test_simulation_is_repeatable(make, spark):
    a = simulate.geometric_paths(spark, 100, 0, 0.1, 5, 20, 1)
    assert sorted(a.collect()) == sorted(simulate.geometric_paths(spark, 100, 0, 0.1, 5, 20, 1).repartition(3).collect())
    assert a.filter("step = 0 and price <> 100").count() == 0


def test_distances(make):
    df = make({"a": [1, 2, 3, 4], "b": [2, 4, 6, 8]})
    pairs = distances.all_pairs(df)
    assert abs(distances.correlation(df, pairs).first()["distance"]) < 1e-6
    assert distances.manhattan(df, pairs).first()["distance"] == 10
    assert distances.dtw(df, pairs).count() == 1


def test_cli_and_log(capsys):
    from tidalframe.__main__ import main
    from tidalframe.log import configure_logging, get_logger

    assert main(["--version"]) == 0 and "tidalframe" in capsys.readouterr().out
    configure_logging("DEBUG", "json")
    assert get_logger("x").name.endswith(".x")


def test_sources_and_sinks(make, tmp_path, spark):
    from tidalframe.sources import loaders, sinks

    (tmp_path / "gdp.csv").write_text("date,value\n2020-01-01,1\n2020-01-02,2\n2020-01-03,x\n")
    assert values(loaders.load_ts_data(spark, str(tmp_path / "gdp.csv"))) == [1, 2, None]
    assert loaders.load_fred(spark, "gdp", start="2020-01-02", root=str(tmp_path)).count() == 2
    with pytest.raises(errors.DataError):
        loaders.load_yahoo(spark, "x")
    loaders.register_fetcher("fred", lambda name, start, end: [("2020-01-01", 1.0)])
    assert loaders.load_fred(spark, "gdp").first()["series_id"] == "gdp"
    df = make({"a": range(50)})
    assert sinks.plot_timeseries_data(df, 10).count() == 10
    assert sinks.plot_residuals_data(df.select(F.col("value").alias("y_true"), F.lit(1.0).alias("y_pred")), 5).count() == 5
    assert sinks.plot_forecast_data(df, estimators.NaiveForecaster().fit(df).predict(2)).count() == 52


def test_streams(make, spark, tmp_path):
    from tidalframe.streaming import streams

    make({"a": range(20)}).select("series_id", "ts", "value").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("series_id string, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    for name, df in (("days", streams.resample_stream(source)), ("ema", streams.ema_stream(source))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() >= 18


def test_api_and_graph(make):
    from tidalframe import api

    df = make({"a": [3.0, 1.0, 2.0, 5.0, 4.0]})
    g = api.Graph(api.build_nvg(df), graph.nodes_of(df))
    assert g.summary().first()["n_nodes"] == 5 and g.n_edges().first()["n_edges"] == g.edges.count()
    dense = {r["i"]: r["row"] for r in g.adjacency_matrix(dense=True).collect()}
    assert all(dense[i][j] == dense[j][i] for i in range(5) for j in range(5)) and sum(map(sum, dense.values())) == 2 * g.edges.count()
    assert api.network_metrics(g.edges, g.nodes).count() == 1 and api.graph_summary(g.edges, g.nodes, motifs=True).first()["motifs_3"]
    d = api.Graph(api.build_transition_network(df, 3), graph.nodes_of(df), directed=True)
    assert d.summary().first()["irreversibility"] >= 0 and d.in_degree_sequence().count() == 5


def test_simulated_intervals_honour_coverage(make):
    y = make({"a": [100 + (k * 7) % 13 for k in range(60)], "b": [50 + (k * 5) % 11 for k in range(60)]})
    for f in (estimators.BlackScholesMonteCarloForecaster(400), estimators.MonteCarloForecaster(estimators.NaiveForecaster(), 400, noise_level=1.0)):
        f.fit(y)
        wide, slim = ({(r["series_id"], r["h"]): r for r in f.predict_interval(4, coverage=c).collect()} for c in (0.95, 0.5))
        assert len(wide) == 8
        for k in [k for k in wide if k[1] > 1]:
            assert wide[k]["lower"] < slim[k]["lower"] < slim[k]["upper"] < wide[k]["upper"]


def test_ensemble_plan_does_not_double(make):
    y = make({"a": [float((k * k) % 17) for k in range(40)], "b": [float(k % 5) for k in range(40)], "short": [1.0, 2.0]})
    made = estimators.EnsembleForecaster(n_estimators=3).fit(y).predict(12)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.splitlines()) < 400 and plan.count("Aggregate") <= 2
    rows = sorted((r["series_id"], r["h"], r["t"]) for r in made.collect())
    assert rows == [(s, h, 39 + h) for s in "ab" for h in range(1, 13)] + [("short", h, 1 + h) for h in range(1, 13) if any(r[0] == "short" for r in rows)]


def test_nearest_vectors_in_blocks(spark):
    """Blocked neighbours equal brute force for every number of blocks, without a nested loop join."""
    import numpy as np

    from tidalframe.operators import distances

    x = np.random.default_rng(3).normal(size=(90, 5)).round(1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for block in (7, 1000):
        near = distances.nearest_vectors(df, "id", "vec", 4, block_rows=block)
        got = {}
        for r in near.collect():
            got.setdefault(r["i"], []).append((round(r["d"], 9), r["j"]))
        for i in range(90):
            assert len(got[i]) == 4 and sorted(x for x, _ in got[i]) == sorted(round(d[i, j], 9) for j in range(90) if j != i)[:4]
            assert all(round(d[i, j], 9) == x for x, j in got[i])
        within = {(r["i"], r["j"]) for r in distances.vectors_within(df, "id", "vec", 1.55, block_rows=block).collect()}
        assert within == {(i, j) for i in range(90) for j in range(90) if i != j and d[i, j] <= 1.55}
        assert distances.distance_percentile(df, "id", "vec", 7.0, block_rows=block) == pytest.approx(np.percentile(d[np.triu_indices(90, 1)], 7.0))
        assert "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString()
