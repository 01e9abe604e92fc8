"""Transfer entropy between series of a panel: grouped counts of binned, lagged values.

TE(x > y) = H(y, yp) - H(yp) - H(y, yp, xp) + H(yp, xp), base 2, at least 0; the conditional
form carries zp along in every term. All pairs are one grouping-set-free pass of counts each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ID, POS, VALUE, WHOLE, W


def binned(df: DataFrame, bins: int = 10, lag: int = 1) -> DataFrame:
    """(series_id, t, b, past): equal-width bins of the series' range; a constant series has one bin."""
    lo, hi = F.min(VALUE).over(WHOLE), F.max(VALUE).over(WHOLE) + 1e-10
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(VALUE) - lo) / ((hi - lo) / bins)))).cast("int")
    rows = df.select(ID, POS, b.alias("b"))
    return rows.withColumn("past", F.lag("b", lag).over(W))


def _entropy(rows: DataFrame, by: list[str], keys: list[str], name: str) -> DataFrame:
    counts = rows.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*by))
    return counts.select(*by, (-p * F.log2(p)).alias("h")).groupBy(*by).agg(F.sum("h").alias(name))


def transfer_entropy(df: DataFrame, pairs: DataFrame, lag: int = 1, bins: int = 10) -> DataFrame:
    """(x, y, te) of each pair of ids (x, y)."""
    b = binned(df, bins, lag).filter(F.col("past").isNotNull())
    xs = b.select(F.col(ID).alias("x"), POS, F.col("past").alias("xp"))
    ys = b.select(F.col(ID).alias("y"), F.col(POS).alias("__t"), F.col("b").alias("yt"), F.col("past").alias("yp"))
    left = pairs.join(xs, "x")
    rows = left.join(ys, (left["y"] == ys["y"]) & (left[POS] == ys["__t"])).select("x", left["y"].alias("y"), "yt", "yp", "xp")
    by = ["x", "y"]
    h = [_entropy(rows, by, keys, f"h{k}") for k, keys in enumerate((["yt", "yp"], ["yp"], ["yt", "yp", "xp"], ["yp", "xp"]))]
    out = h[0].join(h[1], by).join(h[2], by).join(h[3], by)
    return out.select(*by, F.greatest(F.lit(0.0), F.col("h0") - F.col("h1") - F.col("h2") + F.col("h3")).alias("te"))


def conditional_transfer_entropy(df: DataFrame, triples: DataFrame, lag: int = 1, bins: int = 10) -> DataFrame:
    """(x, y, z, te) of each triple of ids: from x to y given z."""
    b = binned(df, bins, lag).filter(F.col("past").isNotNull())
    ys = b.select(F.col(ID).alias("y"), POS, F.col("b").alias("yt"), F.col("past").alias("yp"))
    xs = b.select(F.col(ID).alias("x"), POS, F.col("past").alias("xp"))
    zs = b.select(F.col(ID).alias("z"), POS, F.col("past").alias("zp"))
    rows = triples.join(ys, "y").join(xs, ["x", POS]).join(zs, ["z", POS])
    by = ["x", "y", "z"]
    h = [_entropy(rows, by, keys, f"h{k}") for k, keys in enumerate((["yt", "yp", "zp"], ["yp", "zp"], ["yt", "yp", "xp", "zp"], ["yp", "xp", "zp"]))]
    out = h[0].join(h[1], by).join(h[2], by).join(h[3], by)
    return out.select(*by, F.greatest(F.lit(0.0), F.col("h0") - F.col("h1") - F.col("h2") + F.col("h3")).alias("te"))


def transfer_entropy_network(df: DataFrame, lag: int = 1, bins: int = 10, threshold: float = 0.0) -> DataFrame:
    """Edges (x, y, te) of all ordered pairs of series with te >= threshold and te > 0."""
    ids = df.select(ID).distinct()
    pairs = ids.select(F.col(ID).alias("x")).join(ids.select(F.col(ID).alias("y")), F.col("x") != F.col("y"))
    return transfer_entropy(df, pairs, lag, bins).filter((F.col("te") >= threshold) & (F.col("te") > 0))
