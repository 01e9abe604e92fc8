"""Pipelines, feature unions, adapters, tasks and results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseFeaturizer, BaseForecaster, BaseObject, BaseTransformer
from .errors import PipelineError, ValidationError
from .estimators import ColumnFeaturizer, keys_of
from .frame import VALUE, to_series


def nested_params(steps: list[tuple[str, BaseObject]]) -> dict:
    return {f"{name}__{k}": v for name, step in steps for k, v in step.get_params().items()}


def set_nested(steps: list[tuple[str, BaseObject]], params: dict) -> None:
    named = dict(steps)
    for key, value in params.items():
        name, _, inner = key.partition("__")
        if name not in named or not inner:
            raise ValidationError("unknown parameter", {"name": key})
        named[name].set_params(**{inner: value})


@dataclass
class Pipeline(BaseTransformer):
    steps: list[tuple[str, BaseTransformer]] = field(default_factory=list)

    def __post_init__(self):
        for name, step in self.steps:
            if not isinstance(step, BaseTransformer):
                raise PipelineError("steps must be transformers", {"step": name})

    def fit(self, y, X=None):
        self._fitted = y
        for _, step in self.steps:
            y = step.fit(y, X).transform(y, X)
        return self

    def transform(self, y, X=None):
        self._check_is_fitted()
        for _, step in self.steps:
            y = step.transform(y, X)
        return y

    def inverse_transform(self, y, X=None):
        for _, step in reversed(self.steps):
            y = step.inverse_transform(y, X)
        return y

    def get_params(self, deep=True):
        return {"steps": self.steps} | (nested_params(self.steps) if deep else {})

    def set_params(self, **params):
        set_nested(self.steps, params)
        return self


def make_pipeline(*steps: BaseTransformer) -> Pipeline:
    return Pipeline([(f"step{k}", s) for k, s in enumerate(steps)])


@dataclass
class ForecasterPipeline(BaseForecaster):
    """Transformers, then a forecaster. ``inverse`` undoes the transformers on the forecasts."""

    steps: list[tuple[str, BaseTransformer]] = field(default_factory=list)
    forecaster: BaseForecaster = None
    inverse: bool = False

    def fit(self, y, X=None):
        self._fitted = y
        for _, step in self.steps:
            y = step.fit(y, X).transform(y, X)
        self.forecaster.fit(y, X)
        return self

    def _back(self, made: DataFrame) -> DataFrame:
        for column in ("y_pred", "lower", "upper") if self.inverse else ():
            if column in made.columns:
                rows = made.withColumnRenamed(column, VALUE)
                for _, step in reversed(self.steps):
                    rows = step.inverse_transform(rows)
                made = rows.withColumnRenamed(VALUE, column)
        return made

    def predict(self, fh, X=None):
        return self._back(self.forecaster.predict(fh, X))

    def predict_interval(self, fh, X=None, coverage=0.9):
        return self._back(self.forecaster.predict_interval(fh, X, coverage))

    def get_params(self, deep=True):
        own = {"steps": self.steps, "forecaster": self.forecaster, "inverse": self.inverse}
        return own | (nested_params([*self.steps, ("forecaster", self.forecaster)]) if deep else {})

    def set_params(self, **params):
        set_nested([*self.steps, ("forecaster", self.forecaster)], params)
        return self


def make_forecaster_pipeline(*transformers: BaseTransformer, forecaster: BaseForecaster) -> ForecasterPipeline:
    return ForecasterPipeline([(f"step{k}", t) for k, t in enumerate(transformers)], forecaster)


@dataclass
class FeatureUnion(BaseFeaturizer):
    """Features of several featurizers, prefixed by their names.

    Column featurizers become one select over one sort; others are joined on the keys.
    """

    featurizers: list[tuple[str, BaseFeaturizer]] = field(default_factory=list)

    def __post_init__(self):
        for name, f in self.featurizers:
            if not isinstance(f, BaseFeaturizer):
                raise PipelineError("featurizers are needed", {"name": name})

    def fit(self, y, X=None):
        self._fitted = y
        for _, f in self.featurizers:
            f.fit(y, X)
        return self

    def transform(self, y, X=None):
        direct = [(n, f) for n, f in self.featurizers if isinstance(f, ColumnFeaturizer)]
        keys = keys_of(y)
        out = y.select(*keys, VALUE, *[c.alias(f"{n}__{k}") for n, f in direct for k, c in f.columns().items()])
        for n, f in self.featurizers:
            if not isinstance(f, ColumnFeaturizer):
                more = f.transform(y, X)
                shared = [k for k in keys if k in more.columns]
                out = out.join(more.select(*shared, *[F.col(c).alias(f"{n}__{c}") for c in more.columns if c not in (*shared, VALUE)]), shared, "full")
        return out


@dataclass
class SeriesToTableAdapter(BaseTransformer):
    def transform(self, y, X=None):
        return y.select(*keys_of(y), VALUE)


@dataclass
class TableToSeriesAdapter(BaseTransformer):
    """The first value column of a table as a series."""

    def fit(self, y, X=None):
        self._fitted = y
        return self

    def transform(self, y, X=None):
        own = [c for c in y.columns if c not in keys_of(y)]
        return to_series(y.select(*keys_of(y), F.col(own[0]).cast("double").alias(VALUE)))


@dataclass
class ForecastTask:
    y: DataFrame
    fh: int | list[int]
    X: DataFrame | None = None
    cutoff: int | None = None
    frequency: str | None = None


@dataclass
class DetectTask:
    y: DataFrame
    X: DataFrame | None = None
    labels: DataFrame | None = None
    horizon: int | None = None


@dataclass
class Forecast:
    y_pred: DataFrame
    fh: int | list[int]
    y_int: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.y_pred is None:
            raise ValidationError("a forecast needs predictions")


@dataclass
class BacktestResult:
    results: DataFrame
    summary: DataFrame | None = None
    per_fold_metrics: DataFrame | None = None

    def __post_init__(self):
        missing = {"fold_id", "cutoff", "y_true", "y_pred"} - set(self.results.columns)
        if missing:
            raise ValidationError("columns are missing", {"columns": sorted(missing)})


@dataclass
class ModelResult:
    name: str
    forecast: DataFrame
    metrics: dict = field(default_factory=dict)
    confidence_intervals: DataFrame | None = None
    model_params: dict = field(default_factory=dict)


@dataclass
class ModelComparison:
    results: list[ModelResult] = field(default_factory=list)

    def add_result(self, result: ModelResult) -> None:
        self.results.append(result)

    def compare_metrics(self, actual: DataFrame, on: list[str]) -> DataFrame | None:
        """Forecasts (keys, y_pred) of all models against (keys, y_true), best RMSE first."""
        from .functions.metrics import compare_models

        made = None
        for r in self.results:
            rows = r.forecast.select(F.lit(r.name).alias("model"), *on, "y_pred")
            made = rows if made is None else made.unionByName(rows)
        return None if made is None else compare_models(actual, made, on)

    def get_best_model(self, actual: DataFrame, on: list[str], metric: str = "rmse") -> str | None:
        from .functions.metrics import best_model

        table = self.compare_metrics(actual, on)
        row = None if table is None else best_model(table, metric).first()
        return None if row is None else row["model"]
