"""Estimator protocol over panels: parameters are dataclass fields, fitted state is set by fit.

``fit`` keeps a reference to the panel (a lazy plan) or small fitted tables; nothing is
collected unless an estimator says so. ``transform``, ``predict`` and ``score`` give DataFrames.
"""

from __future__ import annotations

import copy
from dataclasses import fields

from pyspark.sql import DataFrame

from .errors import NotFittedError, UnsupportedOperationError, ValidationError
from .frame import assert_series

TAGS = ("scitype_input", "scitype_output", "handles_missing", "requires_sorted_index", "supports_panel", "requires_fh")


class BaseObject:
    tags: dict = {}

    def get_params(self, deep: bool = True) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def set_params(self, **params):
        known = {f.name for f in fields(self)}
        for name, value in params.items():
            if name not in known:
                raise ValidationError("unknown parameter", {"name": name, "known": sorted(known)})
            setattr(self, name, value)
        return self

    def clone(self):
        """A copy of parameters and fitted state; DataFrames are shared, being immutable."""
        return copy.copy(self)


class BaseEstimator(BaseObject):
    _fitted: DataFrame | None = None

    def fit(self, y: DataFrame, X: DataFrame | None = None):
        assert_series(y)
        self._fitted, self._exogenous = y, X
        self._fit(y, X)
        return self

    def _fit(self, y: DataFrame, X: DataFrame | None) -> None:
        pass

    @property
    def is_fitted(self) -> bool:
        return self._fitted is not None

    def _check_is_fitted(self) -> DataFrame:
        if self._fitted is None:
            raise NotFittedError(type(self).__name__)
        return self._fitted


class BaseTransformer(BaseEstimator):
    tags = {"scitype_input": "series", "scitype_output": "series", "supports_panel": True}

    def transform(self, y: DataFrame, X: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def inverse_transform(self, y: DataFrame, X: DataFrame | None = None) -> DataFrame:
        raise UnsupportedOperationError("inverse_transform", type(self).__name__)

    def fit_transform(self, y: DataFrame, X: DataFrame | None = None) -> DataFrame:
        return self.fit(y, X).transform(y, X)


class BaseFeaturizer(BaseTransformer):
    tags = {"scitype_input": "series", "scitype_output": "table", "supports_panel": True}


class BaseForecaster(BaseEstimator):
    tags = {"scitype_input": "series", "scitype_output": "forecast", "supports_panel": True, "requires_fh": True}

    def predict(self, fh: int | list[int], X: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def predict_interval(self, fh: int | list[int], X: DataFrame | None = None, coverage: float = 0.9) -> DataFrame:
        raise UnsupportedOperationError("predict_interval", type(self).__name__)


class BaseDetector(BaseEstimator):
    tags = {"scitype_input": "series", "scitype_output": "flags", "supports_panel": True}

    def score(self, y: DataFrame, X: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def predict(self, y: DataFrame, X: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
        """Rows with ``score`` and ``flag``; a threshold, 0 included, overrides the detector's own."""
        from pyspark.sql import functions as F

        rows = self.score(y, X)
        return rows if threshold is None else rows.withColumn("flag", F.coalesce(F.col("score") > threshold, F.lit(False)))


def get_tags(obj, tag: str | None = None):
    return dict(obj.tags) if tag is None else obj.tags.get(tag)


def set_tags(obj, **tags):
    obj.tags = {**obj.tags, **tags}
    return obj
