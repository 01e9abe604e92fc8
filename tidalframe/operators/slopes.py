"""The median of all pairwise slopes of a series, without listing its pairs.

The number of slopes at or below s is the number of pairs i < j with z_j <= z_i, z = y - s * t.
Pairs are counted over a table of buckets of z against blocks of t: pairs that differ in both
follow from the counts of cells, pairs within a bucket or within a block from those rows alone.
A sample proposes thresholds, counts choose the two between which the median lies, and that is
repeated until few slopes are left between them; those pairs are near in z, and a grid join
lists them. Series of up to ``SHORT`` rows list all their pairs.

Buckets hold the rows of one value of z apart, so equal values are a count and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ID, POS, VALUE
from ..stages import stored
from . import grid

SHORT, SAMPLED, LISTED = 512, 500, 200_000
#: Rows of a block and of a bucket at least; there are no more than ``PARTS`` of either in a series.
BLOCK_ROWS, PARTS = 4096, 2048
THRESHOLDS, ROUNDS = 8, 40
#: Relative width at which the two thresholds count as one value: all slopes between are ties.
TIED = 1e-12


def inversions(z: np.ndarray) -> int:
    """Pairs i < j with z[j] <= z[i]."""
    n = len(z)
    order = np.lexsort((-np.arange(n), z))
    x = np.empty(n, np.int64)
    x[order] = np.arange(n)
    total = 0
    for b in range(max(n - 1, 0).bit_length()):
        by = np.argsort(x >> (b + 1), kind="stable")
        ones, key = (x[by] >> b) & 1, x[by] >> (b + 1)
        before = np.cumsum(ones) - ones
        starts = np.searchsorted(key, key, "left")
        total += int((before - before[starts])[ones == 0].sum())
    return total


def _parts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each block and threshold: its pairs across buckets (bucket -1), and a piece for each bucket."""
    for part in parts:
        out = []
        for r in part.itertuples(index=False):
            t, y = np.asarray(r.t, float), np.asarray(r.y, float)
            for k, s in enumerate(r.thresholds):
                z, bounds = y - s * t, np.unique(np.asarray(r.bounds[k], float))
                at = np.searchsorted(bounds, z, "left")
                same = (at < len(bounds)) & (bounds[np.minimum(at, len(bounds) - 1)] == z)
                bucket, across = 2 * at + same, inversions(z)
                for b in np.unique(bucket):
                    own = np.flatnonzero(bucket == b)
                    tied = b % 2 == 1
                    across -= len(own) * (len(own) - 1) // 2 if tied else inversions(z[own])
                    out.append((r.g, k, int(b), r.q, len(own), 0, [] if tied else z[own]))
                out.append((r.g, k, -1, r.q, 0, across, []))
        yield pd.DataFrame(out, columns=["g", "k", "bucket", "q", "n", "pairs", "z"])


def _bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs within one bucket, and the counts of its cells passed on."""
    rows = rows.sort_values("q")
    n = int(rows["n"].sum())
    pairs = n * (n - 1) // 2 if rows["bucket"].iloc[0] % 2 else inversions(np.concatenate(rows["z"].to_list()).astype(float))
    return pd.DataFrame({"g": rows["g"].iloc[0], "k": rows["k"].iloc[0], "bucket": rows["bucket"], "q": rows["q"], "n": rows["n"], "pairs": [pairs] + [0] * (len(rows) - 1)})


def _cells(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs that differ in bucket and block: the earlier one in the higher bucket."""
    b, q = (np.unique(rows[c], return_inverse=True)[1] for c in ("bucket", "q"))
    table = np.zeros((b.max() + 1, q.max() + 1))
    table[b, q] = rows["n"]
    later = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
    lower = np.cumsum(later, axis=0) - later
    return pd.DataFrame({"g": [rows["g"].iloc[0]], "k": [rows["k"].iloc[0]], "c": [int((table * lower).sum())]})


def counted(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, counts): slopes at or below each of the thresholds of (g, parts, thresholds); blocks are (g, q, t, y)."""
    each = blocks.join(asked, "g")
    flat = each.select("g", "parts", F.posexplode("thresholds").alias("k", "s"), "t", "y").select("g", "parts", "k", "s", F.explode(F.arrays_zip("t", "y")).alias("r"))
    most = asked.agg(F.max("parts")).first()[0] or 1
    z = F.col("r.y") - F.col("s") * F.col("r.t").cast("double")
    bounds = flat.groupBy("g", "k").agg(F.percentile_approx(z, [p / most for p in range(1, most)] or [0.5], 20 * most).alias("b")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]).alias("bounds"))
    pieces = stored(each.join(bounds, "g").select("g", "q", "t", "y", "thresholds", "bounds").mapInPandas(_parts, "g string, k int, bucket long, q long, n long, pairs long, z array<double>"))
    inside = stored(pieces.filter("bucket >= 0").groupBy("g", "k", "bucket").applyInPandas(_bucket, "g string, k int, bucket long, q long, n long, pairs long"))
    cells = inside.select("g", "k", "bucket", "q", "n").groupBy("g", "k").applyInPandas(_cells, "g string, k int, c long")
    rest = pieces.filter("bucket < 0").select("g", "k", F.col("pairs").alias("c")).unionByName(inside.select("g", "k", F.col("pairs").alias("c"))).unionByName(cells)
    return rest.groupBy("g", "k").agg(F.sum("c").alias("c")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("counts"))


def _proposed(rows: pd.DataFrame) -> pd.DataFrame:
    """Thresholds about the middle of the slopes of a bounded sample."""
    rows = rows.sort_values("t")
    t, y = rows["t"].to_numpy(float), rows["y"].to_numpy(float)
    i, j = np.triu_indices(len(t), 1)
    slopes = (y[j] - y[i]) / (t[j] - t[i])
    found = np.quantile(slopes, np.linspace(0.42, 0.58, THRESHOLDS)) if len(slopes) else np.zeros(THRESHOLDS)
    # Thresholds lie beside the slopes of the data, so that rounding decides no tie.
    beside = (np.ptp(y) / max(1.0, np.ptp(t)) + 1e-300) * 1e-7 * np.linspace(-1, 1.2345, THRESHOLDS)
    return pd.DataFrame({"g": [rows["g"].iloc[0]], "thresholds": [np.sort(found + beside)]})


def _all_pairs(rows: DataFrame) -> DataFrame:
    """(g, slope) of short series."""
    other = rows.select("g", F.col("t").alias("u"), F.col("y").alias("x"))
    pairs = rows.select("g", "t", "y").join(other, "g").filter(F.col("t") < F.col("u"))
    return pairs.groupBy("g").agg(F.percentile((F.col("x") - F.col("y")) / (F.col("u") - F.col("t")), F.lit(0.5)).alias("slope"))


def median_slopes(df: DataFrame) -> DataFrame:
    """(g, slope): the interpolated median of (y_j - y_i) / (j - i) over all pairs of a series with values; none for fewer than two."""
    rows = df.filter(F.col(VALUE).isNotNull()).select(F.col(ID).alias("g"), F.col(POS).alias("t"), F.col(VALUE).alias("y"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    short = _all_pairs(rows.join(sizes.filter(F.col("n") <= SHORT).select("g"), "g", "left_semi"))
    long_ = sizes.filter(F.col("n") > SHORT)
    if long_.isEmpty():
        return short
    size = F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col("n") / PARTS))
    packed = rows.join(long_.select("g", "n", size.alias("size")), "g").groupBy("g", F.floor(F.col("t") / F.col("size")).alias("q")).agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("r"))
    blocks = stored(packed.select("g", "q", F.col("r.t").alias("t"), F.col("r.y").alias("y")))
    sample = rows.join(long_.select("g", "n"), "g").filter(F.pmod(F.xxhash64("t"), F.ceil(F.col("n") / SAMPLED)) == 0)
    first = sample.select("g", "t", "y").groupBy("g").applyInPandas(_proposed, "g string, thresholds array<double>")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    open_ = long_.join(first, "g").select("g", "n", "t0", "t1", "y0", "y1", F.ceil(F.col("n") / size).cast("int").alias("parts"), "thresholds", ((pairs - 1) / 2).alias("rank"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("upto"))
    open_, done = stored(open_.filter("y1 > y0")), long_.filter("y1 = y0").select("g", F.lit(0.0).alias("slope"))
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        found = open_.join(counted(blocks, open_.select("g", "parts", "thresholds")), "g")
        steps = F.arrays_zip("thresholds", "counts")
        under = F.filter(steps, lambda x: x["counts"] <= F.floor("rank"))
        over = F.filter(steps, lambda x: x["counts"] > F.ceil("rank"))
        last = F.try_element_at(under, F.lit(-1))
        next_ = F.try_element_at(over, F.lit(1))
        known = found.select("g", "n", "t0", "t1", "y0", "y1", "parts", "rank", F.coalesce(last["thresholds"], "low").alias("low"), F.coalesce(next_["thresholds"], "high").alias("high"), F.coalesce(last["counts"], "below").alias("below"), F.coalesce(next_["counts"], "upto").alias("upto"), F.element_at("thresholds", 1).alias("a"), F.element_at("thresholds", -1).alias("b"))
        steep = (F.col("y1") - F.col("y0")) / (F.col("t1") - F.col("t0"))
        wide = F.greatest(2 * (F.col("b") - F.col("a")), steep * 1e-6)
        # Without a threshold on one side the search goes on outside; else between the two.
        low = F.when(F.col("low").isNull(), F.col("a") - THRESHOLDS * wide).otherwise(F.col("low"))
        high = F.when(F.col("high").isNull(), F.col("b") + THRESHOLDS * wide).otherwise(F.col("high"))
        inner = F.transform(F.sequence(F.lit(1), F.lit(THRESHOLDS)), lambda k: F.col("__l") + (F.col("__h") - F.col("__l")) * k / (THRESHOLDS + 1))
        known = stored(known.withColumn("__l", low).withColumn("__h", high).withColumn("thresholds", inner).withColumn("closed", F.col("low").isNotNull() & F.col("high").isNotNull()).withColumn("steep", steep))
        tied = F.col("closed") & (F.col("high") - F.col("low") <= TIED * (F.abs("low") + F.abs("high") + F.col("steep")))
        few = F.col("closed") & ~tied & (F.col("upto") - F.col("below") <= F.greatest(F.lit(LISTED), F.col("n")))
        done = done.unionByName(known.filter(tied).select("g", ((F.col("low") + F.col("high")) / 2).alias("slope"))).unionByName(_listed(blocks, known.filter(few)))
        open_ = stored(known.filter(~(tied | few)).drop("a", "b", "__l", "__h", "closed", "steep"))
    return short.unionByName(done)


def _listed(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(g, slope): the median among the pairs whose slopes lie above low and up to high."""
    ends = known.select("g", "low", "high", "below", "rank", ((F.col("high") - F.col("low")) * (F.col("t1") - F.col("t0") + 1)).alias("radius"))
    z = F.col("r.y") - F.col("low") * F.col("r.t").cast("double")
    rows = blocks.join(ends, "g").select("g", "radius", "low", F.explode(F.arrays_zip("t", "y")).alias("r")).select("g", F.col("r.t").alias("p"), F.array(z).alias("e"), "radius")
    near = grid.met(rows, rows.drop("radius"), "manhattan", 1, True).select("g", "p", "q")
    flat = blocks.select("g", F.explode(F.arrays_zip("t", "y")).alias("r"))
    at = lambda k, v: flat.select("g", F.col("r.t").alias(k), F.col("r.y").alias(v))
    slopes = near.join(at("p", "yp"), ["g", "p"]).join(at("q", "yq"), ["g", "q"]).select("g", ((F.col("yq") - F.col("yp")) / (F.col("q") - F.col("p"))).alias("s"))
    kept = slopes.join(ends.select("g", "low", "high", "below", "rank"), "g").filter((F.col("s") > F.col("low")) & (F.col("s") <= F.col("high")))
    packed = kept.groupBy("g").agg(F.array_sort(F.collect_list("s")).alias("s"), F.max("below").alias("below"), F.max("rank").alias("rank"))
    value = lambda k: F.try_element_at("s", (k - F.col("below") + 1).cast("int"))
    low, high = value(F.floor("rank")), value(F.ceil("rank"))
    return packed.select("g", (low + (F.col("rank") - F.floor("rank")) * (high - low)).alias("slope"))
