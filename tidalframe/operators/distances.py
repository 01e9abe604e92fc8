"""Distances between the series of a panel, or between vectors of a table.

``pairs`` names the compared ids; rows are matched by position, so each distance is one join
and one aggregation, whatever the number of pairs.
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import ID, POS, VALUE
from ..functions.columns import correlation as pearson
from . import neighbours


def all_pairs(df: DataFrame) -> DataFrame:
    """(i, j) of all pairs of different series, i before j. The ids of a panel, not its rows, are paired."""
    ids = df.select(ID).distinct()
    return ids.select(F.col(ID).alias("i")).join(ids.select(F.col(ID).alias("j")), F.col("i") < F.col("j"))


def matched(df: DataFrame, pairs: DataFrame, lag: int | None = None) -> DataFrame:
    """(i, j, t, x, y): values at equal positions, or y ``k`` positions later for abs(k) <= lag."""
    left = pairs.join(df.select(F.col(ID).alias("i"), POS, F.col(VALUE).alias("x")), "i")
    right = df.select(F.col(ID).alias("j"), F.col(POS).alias("__t"), F.col(VALUE).alias("y"))
    if lag is None:
        return left.join(right, (left["j"] == right["j"]) & (left[POS] == right["__t"])).select("i", left["j"].alias("j"), POS, "x", "y")
    shifted = left.withColumn("k", F.explode(F.sequence(F.lit(-lag), F.lit(lag))))
    return shifted.join(right, (shifted["j"] == right["j"]) & (shifted[POS] + F.col("k") == right["__t"])).select("i", shifted["j"].alias("j"), "k", POS, "x", "y")


def euclidean(df: DataFrame, pairs: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("y")
    return matched(df, pairs).groupBy("i", "j").agg(F.sqrt(F.sum(d * d)).alias("distance"))


def manhattan(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return matched(df, pairs).groupBy("i", "j").agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("distance"))


def ranked(df: DataFrame) -> DataFrame:
    """Values replaced by their average ranks within the series."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(ID, VALUE))
    return df.withColumn(VALUE, F.rank().over(Window.partitionBy(ID).orderBy(VALUE)) + (ties - 1) / 2.0)


def correlation(df: DataFrame, pairs: DataFrame, method: str = "pearson", absolute: bool = False) -> DataFrame:
    if method not in ("pearson", "spearman"):
        raise ValidationError("unknown correlation", {"method": method})
    r = pearson("x", "y")
    r = F.abs(r) if absolute else r
    return matched(ranked(df) if method == "spearman" else df, pairs).groupBy("i", "j").agg(F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - r))).alias("distance"))


def cross_correlation(df: DataFrame, pairs: DataFrame, max_lag: int = 10) -> DataFrame:
    """From the largest absolute cross-correlation within ``max_lag``."""
    own = Window.partitionBy(ID)
    z = (F.col(VALUE) - F.avg(VALUE).over(own)) / F.nullif(F.stddev_pop(VALUE).over(own), F.lit(0.0))
    rows = df.withColumn("__n", F.count(F.lit(1)).over(own)).withColumn(VALUE, z)
    sizes = rows.groupBy(F.col(ID).alias("i")).agg(F.max("__n").alias("n"))
    products = matched(rows, pairs, max_lag).groupBy("i", "j", "k").agg(F.sum(F.col("x") * F.col("y")).alias("s")).join(sizes, "i")
    best = products.groupBy("i", "j").agg(F.max(F.abs(F.col("s") / F.col("n"))).alias("m"))
    return best.select("i", "j", F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.col("m")))).alias("distance"))


def dtw(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dynamic time warping with squared costs: a pandas UDF over two arrays of each pair."""
    from ..kernels.series import dtw as kernel

    arrays = df.groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct(POS, VALUE))), lambda p: p[VALUE]).alias("a"))
    both = pairs.join(arrays.select(F.col(ID).alias("i"), F.col("a").alias("x")), "i").join(arrays.select(F.col(ID).alias("j"), F.col("a").alias("y")), "j")

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kernel(a, b) for a, b in zip(x, y, strict=True)])

    return both.select("i", "j", run("x", "y").alias("distance"))


def nearest_vectors(vectors: DataFrame, id_col: str, vector_col: str, k: int, queries: DataFrame | None = None, block_rows: int = neighbours.BOX_ROWS) -> DataFrame:
    """(i, j, d): the k nearest other vectors of each query vector (all rows unless a set is given); of equal distances the smaller id is nearer."""
    return neighbours.nearest(vectors, id_col, vector_col, k, queries, block_rows)


def vectors_within(vectors: DataFrame, id_col: str, vector_col: str, epsilon: float, queries: DataFrame | None = None, block_rows: int = neighbours.BOX_ROWS) -> DataFrame:
    """(i, j, d): other vectors within epsilon of each query vector."""
    return neighbours.within(vectors, id_col, vector_col, epsilon, queries, block_rows)


def distance_percentile(vectors: DataFrame, id_col: str, vector_col: str, percentile: float, bins: int = 4096, block_rows: int = neighbours.BOX_ROWS) -> float | None:
    """Interpolated percentile of the distances of all pairs, exact."""
    return neighbours.percentile(vectors, id_col, vector_col, percentile, block_rows, bins)[0]
