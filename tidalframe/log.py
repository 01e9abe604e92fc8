"""Logging of the package: level and format from arguments or environment."""

from __future__ import annotations

import json
import logging
import os
import sys

NAME = __package__
FORMATS = {"simple": "%(levelname)s %(message)s", "detailed": "%(asctime)s %(name)s %(levelname)s %(message)s"}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "name": record.name, "level": record.levelname, "message": record.getMessage()})


def configure_logging(level: str | int | None = None, format_string: str | None = None, stream=None) -> logging.Logger:
    logger = logging.getLogger(NAME)
    level = level or os.environ.get("TIDALFRAME_LOG_LEVEL", "INFO")
    kind = format_string or os.environ.get("TIDALFRAME_LOG_FORMAT", "simple")
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonFormatter() if kind == "json" else logging.Formatter(FORMATS.get(kind, kind)))
    logger.handlers[:] = [handler]
    logger.setLevel(level.upper() if isinstance(level, str) else level)
    logger.propagate = False
    return logger


def get_logger(name: str) -> logging.Logger:
    if not logging.getLogger(NAME).handlers:
        configure_logging()
    return logging.getLogger(name if name.startswith(NAME) else f"{NAME}.{name}")
