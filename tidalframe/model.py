"""Saved estimators: parameters as JSON, fitted panels as Parquet. Nothing is unpickled on loading."""

from __future__ import annotations

import importlib
import json
from dataclasses import is_dataclass

from pyspark.sql import SparkSession

from . import __version__
from .errors import ConfigurationError, DataError, NotFittedError


def _plain(value):
    if is_dataclass(value) and not isinstance(value, type):
        return {"__class__": f"{type(value).__module__}:{type(value).__qualname__}", "params": {k: _plain(v) for k, v in value.get_params(deep=False).items()}}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise ConfigurationError("parameter cannot be saved", {"type": type(value).__name__})


def _object(value):
    if isinstance(value, dict) and "__class__" in value:
        module, _, name = value["__class__"].partition(":")
        if not module.startswith(f"{__package__}."):
            raise ConfigurationError("class is not of this package", {"class": value["__class__"]})
        return getattr(importlib.import_module(module), name)(**{k: _object(v) for k, v in value["params"].items()})
    if isinstance(value, list):
        return [tuple(v) if isinstance(v, list) and len(v) == 2 and isinstance(v[0], str) else v for v in map(_object, value)]
    return value


def save_model(estimator, path: str, include_metadata: bool = True) -> None:
    """Write ``path``/estimator (one JSON line) and ``path``/fitted (the fitted panel)."""
    if not estimator.is_fitted:
        raise NotFittedError(type(estimator).__name__)
    spark = estimator._fitted.sparkSession
    meta = {"class_name": type(estimator).__name__, "module": type(estimator).__module__, "is_fitted": True, "version": __version__} if include_metadata else {}
    line = json.dumps({"estimator": _plain(estimator), "metadata": meta})
    estimator._fitted.write.mode("overwrite").parquet(f"{path}/fitted")
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/estimator")


def _read(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(f"{path}/estimator").first()["value"])
    except Exception as e:
        raise DataError("no saved estimator", {"path": path}) from e


def load_model(spark: SparkSession, path: str):
    """The estimator, fitted again on its saved panel."""
    estimator = _object(_read(spark, path)["estimator"])
    return estimator.fit(spark.read.parquet(f"{path}/fitted"))


def get_model_metadata(spark: SparkSession, path: str) -> dict:
    meta = _read(spark, path)["metadata"]
    if not meta:
        raise DataError("saved without metadata", {"path": path})
    return meta
