"""Pairs of near states of a series by a grid join, and the distances that bound them.

States (g, p, e) fall into cells whose side is the radius asked for, on the first ``GRID_DIMS``
components; a state meets the states of its own and the adjacent cells only, so the pairs that
are looked at follow the pairs that are near. Cells are keys of an equi-join; one that holds much
of a series is split by Spark.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import stored

GRID_DIMS = 3
#: Pairs of states per series, spread over it, that propose a first radius.
PROBES = 16
#: Bins in which distances are counted before the bin of a rank is looked into.
BINS = 4096


def distance(x: str, y: str, metric: str) -> Column:
    diff = F.zip_with(x, y, lambda p, q: p - q)
    if metric == "manhattan":
        return F.aggregate(diff, F.lit(0.0), lambda s, v: s + F.abs(v))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v))


def met(asking: DataFrame, states: DataFrame, metric: str, dimension: int, once: bool = False) -> DataFrame:
    """(g, p, q, d, radius): other states q within ``radius`` of the asking states (g, p, e, radius); with ``once`` p < q.

    The radius is the same for all asking states of a series.
    """
    m = min(dimension, GRID_DIMS)
    # A little wider than the radius, so that rounding moves no state beyond the adjacent cells.
    side = F.when(F.col("radius") > 0, F.col("radius") * (1 + 1e-9)).otherwise(F.lit(1.0))
    cell = lambda k: F.floor(F.col("e")[k] / side)
    radii = asking.groupBy("g").agg(F.max("radius").alias("radius"))
    around = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"s{k}") for k, s in enumerate(shift)]) for shift in product((-1, 0, 1), repeat=m)]))
    left = asking.select("g", "p", F.col("e").alias("x"), "radius", *[cell(k).alias(f"b{k}") for k in range(m)], around.alias("s")).select("g", "p", "x", "radius", *[(F.col(f"b{k}") + F.col(f"s.s{k}")).alias(f"c{k}") for k in range(m)])
    right = states.join(radii, "g").select("g", F.col("p").alias("q"), F.col("e").alias("y"), *[cell(k).alias(f"c{k}") for k in range(m)])
    both = left.join(right, ["g", *[f"c{k}" for k in range(m)]]).filter((F.col("p") < F.col("q")) if once else (F.col("p") != F.col("q")))
    return both.select("g", "p", "q", distance("x", "y", metric).alias("d"), "radius").filter(F.col("d") <= F.col("radius"))


def scales(states: DataFrame, metric: str, dimension: int, part: Column) -> DataFrame:
    """(g, n, spread, radius): states, a bound of all distances, and the quantile ``part`` (over n) of a few probed ones."""
    spread = sum((F.max(F.col("e")[k]) - F.min(F.col("e")[k]) for k in range(dimension)), F.lit(0.0))
    sizes = states.groupBy("g").agg(F.count(F.lit(1)).alias("n"), spread.alias("spread"))
    few = states.join(sizes.select("g", "n"), "g").filter(F.pmod(F.xxhash64("p"), F.greatest(F.lit(1), F.floor(F.col("n") / 64))) == 0)
    far = few.select("g", F.col("e").alias("x"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda k: (F.col("p") + F.floor(F.col("n") * k / (PROBES + 1)) + 1) % F.col("n"))).alias("p"))
    probed = far.join(states.select("g", "p", F.col("e").alias("y")), ["g", "p"]).select("g", distance("x", "y", metric).alias("d")).groupBy("g").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    at = lambda p: F.greatest(F.lit(1), F.least(F.size("ds"), F.ceil(p * F.size("ds")))).cast("int")
    known = sizes.join(probed, "g", "left")
    guess = F.coalesce(F.try_element_at("ds", at(part)), F.lit(0.0))
    return known.select("g", "n", "spread", F.when(guess > 0, guess).otherwise(F.col("spread") / F.greatest(F.col("n"), F.lit(1))).alias("radius"))


def low_percentile(states: DataFrame, dimension: int, metric: str, q: float = 0.1) -> DataFrame:
    """(g, src, dst, d, eps), stored: all pairs within eps, the interpolated q-quantile of all nonzero distances of the series.

    Each pair counts twice, as in a full matrix. A probed radius is doubled until counts show
    that it holds the ranks; counts of bins then lead to the two distances between which eps lies.
    """
    sizes = scales(states, metric, dimension, F.lit(min(1.0, 1.3 * q)))
    same = states.groupBy("g", "e").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("zero"))
    rank = q * (2 * F.col("m") - 1)
    open_ = sizes.join(same, "g").withColumn("m", (F.col("n") * (F.col("n") - 1) / 2).cast("long") - F.col("zero")).filter("m > 0")
    open_ = stored(open_.select("g", "m", "spread", "radius", rank.alias("rank"), F.floor(F.floor(rank) / 2).alias("low"), F.floor(F.ceil(rank) / 2).alias("high")))
    found = None
    while not open_.isEmpty():
        pairs = stored(met(states.join(open_.select("g", "radius"), "g"), states, metric, dimension, True))
        enough = pairs.filter("d > 0").groupBy("g").agg(F.count(F.lit(1)).alias("c")).join(open_, "g").filter(F.col("c") > F.col("high"))
        enough = stored(enough.drop("c"))
        own = pairs.drop("radius").join(enough, "g")
        found = own if found is None else found.unionByName(own)
        open_ = stored(open_.join(enough, "g", "left_anti").withColumn("radius", F.least(2 * F.col("radius"), F.col("spread") * (1 + 1e-9))))
    if found is None:
        return met(states.withColumn("radius", F.lit(0.0)).limit(0), states, metric, dimension, True).select("g", F.col("p").alias("src"), F.col("q").alias("dst"), "d", F.col("radius").alias("eps"))
    rows = found.filter("d > 0").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("d") / F.col("radius") * BINS)))
    sums = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy("g", "bin", "low", "high", "rank").agg(F.count(F.lit(1)).alias("c")).withColumn("to", F.sum("c").over(sums)).withColumn("from", F.col("to") - F.col("c"))
    bins = bins.filter((F.col("low") < F.col("to")) & (F.col("high") >= F.col("from")))
    inner = Window.partitionBy("g", "bin").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    values = rows.select("g", "bin", "d").join(bins.drop("c", "to"), ["g", "bin"]).groupBy("g", "bin", "d", "from", "low", "high", "rank").agg(F.count(F.lit(1)).alias("c"))
    values = values.withColumn("to", F.sum("c").over(inner) + F.col("from")).withColumn("at", F.col("to") - F.col("c"))
    holds = lambda k: F.max(F.when((F.col(k) >= F.col("at")) & (F.col(k) < F.col("to")), F.col("d")))
    limits = values.groupBy("g").agg(holds("low").alias("a"), holds("high").alias("b"), F.max("rank").alias("rank"))
    limits = limits.select("g", (F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a"))).alias("eps"))
    return found.select("g", F.col("p").alias("src"), F.col("q").alias("dst"), "d").join(limits, "g").filter(F.col("d") <= F.col("eps"))


def nearest(states: DataFrame, dimension: int, metric: str, k: int) -> DataFrame:
    """(g, p, q, d): of each state all others up to the distance of its k-th nearest; none in a series of k states or fewer.

    States whose radius holds k others are done; the radius of the rest is made four times as wide.
    """
    sizes = scales(states, metric, dimension, F.lit(2.0 * k) / F.col("n")).filter(F.col("n") > k)
    asking, out = stored(states.join(sizes.select("g", "radius", "spread"), "g")), None
    while not asking.isEmpty():
        near = stored(met(asking, states, metric, dimension))
        nth = near.withColumn("r", F.row_number().over(Window.partitionBy("g", "p").orderBy("d"))).filter(F.col("r") == k)
        done = stored(nth.select("g", "p", F.col("d").alias("limit")))
        own = near.join(done, ["g", "p"]).filter(F.col("d") <= F.col("limit")).select("g", "p", "q", "d")
        out = own if out is None else out.unionByName(own)
        asking = stored(asking.join(done, ["g", "p"], "left_anti").withColumn("radius", F.least(4 * F.col("radius"), F.col("spread") * (1 + 1e-9))))
    return met(asking, states, metric, dimension).select("g", "p", "q", "d") if out is None else out
