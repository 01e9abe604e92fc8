"""Connected components of an edge table by alternating large-star and small-star steps.

Labels never reach the driver; every round is written to the shared folder, so lineage stays
short and a lost executor costs one round. Stars converge in a number of rounds logarithmic in
the vertices. Vertices with very many edges are looked up by a broadcast: at most 2,000 or
200,000 of them can exist, as a vertex is hot from a thousandth (of few edges) or a
hundred-thousandth of the edges on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored


def _star(edges: DataFrame, large: bool, hot: int, few: bool) -> DataFrame:
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("__m"), F.count(F.lit(1)).alias("__c")).select("a", F.least("__m", "a").alias("__m"), "__c")
    if few:
        joined = both.join(low, "a")
    else:
        low = stored(low)
        joined = looked_up(both, low.filter(F.col("__c") > hot), low.filter(F.col("__c") <= hot), ["a"])
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("__m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("__m").alias("b")).unionByName(low.select("a", F.col("__m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b); root is the smallest vertex reachable.

    Self loops and repeated edges are harmless; an empty table gives an empty result.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == before or not sums[0]:
            break
        before, hot = tuple(sums), max(1000, sums[0] // 100_000)
        few = sums[0] <= hot  # no vertex can be hot
        large = _star(edges, large=True, hot=hot, few=few)
        edges = stored(_star(large if few else stored(large), large=False, hot=hot, few=few))
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
