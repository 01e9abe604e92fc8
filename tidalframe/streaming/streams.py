"""Structured Streaming forms: windowed resampling with late rows, and per-series state.

Both take a streaming (or, for tests, a static) DataFrame (series_id, ts, value).
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resample_stream(rows: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(series_id, ts, n, mean, sum, min, max) of each window; rows later than ``late`` are dropped."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy("series_id", F.window("ts", every).alias("w")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    return g.select("series_id", F.col("w.start").alias("ts"), "n", "mean", "sum", "min", "max")


def _smooth(alpha: float):
    def update(key: tuple, batches, state: GroupState):
        level = state.get[0] if state.exists else None
        for rows in batches:
            out = []
            for v in rows.sort_values("ts")["value"]:
                if np.isfinite(v):
                    level = v if level is None else alpha * v + (1 - alpha) * level
                out.append(level)
            yield pd.DataFrame({"series_id": key[0], "ts": rows.sort_values("ts")["ts"].to_numpy(), "ema": [np.nan if x is None else x for x in out]})
        if level is not None:
            state.update((float(level),))

    return update


def ema_stream(rows: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Exponential mean after every row; the state of a series is one number."""
    return rows.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "value").groupBy("series_id").applyInPandasWithState(_smooth(alpha), "series_id string, ts timestamp, ema double", "level double", "append", GroupStateTimeout.NoTimeout)
