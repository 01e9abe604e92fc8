from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A panel from {series: values}, daily from 2020-01-01."""
    from datetime import datetime, timedelta

    def panel(series: dict, start=datetime(2020, 1, 1)):
        rows = [(k, t, start + timedelta(days=t), None if v is None else float(v)) for k, vs in series.items() for t, v in enumerate(vs)]
        return spark.createDataFrame(rows, "series_id string, t long, ts timestamp_ntz, value double")

    return panel
