"""Exceptions of the engine; each carries a context that is shown after its message."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, message: str, context: dict | None = None):
        self.message, self.context = message, dict(context or {})
        shown = "; ".join(f"{k}: {v!r}" for k, v in self.context.items())
        super().__init__(f"{message} [{shown}]" if shown else message)


class ValidationError(EngineError, ValueError):
    """An argument or schema does not fit."""


class DataError(EngineError):
    """The data do not fit: empty, too short, without finite values."""


class ForecastError(EngineError):
    """A forecast cannot be made."""


class TransformError(EngineError):
    """A transformation cannot be made."""


class PipelineError(EngineError):
    """A pipeline is put together wrongly."""


class ConfigurationError(EngineError):
    """A model file or option does not fit."""


class NotFittedError(EngineError):
    def __init__(self, estimator_name: str):
        super().__init__(f"{estimator_name} is not fitted; call fit first", {"estimator": estimator_name})


class UnsupportedOperationError(EngineError):
    def __init__(self, operation: str, estimator_name: str, reason: str | None = None):
        super().__init__(f"no {operation} for a {estimator_name}" + (f", because {reason}" if reason else ""), {"operation": operation, "estimator": estimator_name})
