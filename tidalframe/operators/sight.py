"""Lines of sight in long series: visibility edges without listing the pairs of a series.

A series is cut into blocks of ``BLOCK`` rows, and blocks are the leaves of a tree with
``FANOUT`` children a node; a node knows its box: the height and place of its highest row and the
places of its first and last one. Within a block all rows are compared at once. Beyond it, a row
carries the steepest slope (natural) or the greatest height (horizontal) that it has met so far
and opens a node only if its box can exceed that; what follows an opened node sees at least the
node's highest row. So nodes that hide nothing are never opened, and pairs that are looked at
follow the edges. Natural visibility does not change when a line is taken off the series; boxes
are those of the series without its least-squares line, which keeps them low under a trend.

Every task works on one block against a few boxes or one other block; a node that many blocks
open is a key of a join that Spark can split. Rows without a value are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ID, POS, VALUE
from ..stages import stored

BLOCK, FANOUT = 512, 16
#: Blocks in a batch of a task, and edges or candidates that it holds before it sends them.
BATCH, HELD = 256, 200_000
#: Relative slack of a box test, for rounding; edges are decided by the exact slopes.
SLACK = 1e-9
BOX = "array<struct<level:int,node:long,top:double,at:long,first:long,last:long>>"
NEAR = "src array<long>, dst array<long>, yi array<double>, yj array<double>"
ASK = "g string, level int, node long, t array<long>, y array<double>, met array<double>, own array<double>, tilt double, scale double"
EDGE = "src long, dst long, yi double, yj double, slope double, own double"


def blocks_of(df: DataFrame) -> DataFrame:
    """(g, b, t, y): the rows of each block as arrays."""
    rows = df.filter(F.col(VALUE).isNotNull()).select(F.col(ID).alias("g"), F.col(POS).alias("t"), F.col(VALUE).alias("y"))
    packed = rows.groupBy("g", F.floor(F.col("t") / BLOCK).alias("b")).agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("r"))
    return packed.select("g", "b", F.col("r.t").alias("t"), F.col("r.y").alias("y"))


def tilted(blocks: DataFrame, horizontal: bool) -> DataFrame:
    """Adds the slope of each series' line (0 if horizontal) and the scale of its values; sums of blocks are added up."""
    if horizontal:
        return blocks.withColumn("tilt", F.lit(0.0)).withColumn("scale", F.lit(0.0))
    dot = lambda f: F.aggregate(F.arrays_zip("t", "y"), F.lit(0.0), lambda s, x: s + f(x["t"].cast("double"), x["y"]))
    parts = blocks.select("g", "b", F.size("t").cast("double").alias("n"), dot(lambda t, y: t).alias("x"), dot(lambda t, y: y).alias("z"), dot(lambda t, y: t * t).alias("xx"), dot(lambda t, y: t * y).alias("xz"), F.array_max(F.transform("y", F.abs)).alias("m"))
    own = Window.partitionBy("g")
    n, x, z, xx, xz = (F.sum(c).over(own) for c in ("n", "x", "z", "xx", "xz"))
    line = parts.select("g", "b", F.coalesce((n * xz - x * z) / F.nullif(n * xx - x * x, F.lit(0.0)), F.lit(0.0)).alias("tilt"), F.max("m").over(own).alias("scale"))
    return blocks.join(line, ["g", "b"])


def tree_of(blocks: DataFrame, levels: int) -> DataFrame:
    """(g, level, node, kids): the boxes of the children of every node from level 1."""
    flat = F.transform(F.arrays_zip("t", "y"), lambda x: F.struct((x["y"] - F.col("tilt") * x["t"]).alias("h"), (-x["t"]).alias("t")))
    rows = blocks.withColumn("p", F.array_max(flat)).select("g", F.lit(0).alias("level"), F.col("b").alias("node"), F.col("p.h").alias("top"), (-F.col("p.t")).alias("at"), F.array_min("t").alias("first"), F.array_max("t").alias("last"))
    out = None
    for level in range(1, levels + 1):
        kids = F.array_sort(F.collect_list(F.struct("first", "level", "node", "top", "at", "last")))
        up = rows.groupBy("g", F.floor(F.col("node") / FANOUT).alias("node")).agg(kids.alias("kids"), F.max(F.struct("top", (-F.col("at")).alias("k"))).alias("p"), F.min("first").alias("first"), F.max("last").alias("last"))
        up = stored(up.withColumn("level", F.lit(level)))
        own = up.select("g", "level", "node", F.transform("kids", lambda x: F.struct(x["level"].alias("level"), x["node"].alias("node"), x["top"].alias("top"), x["at"].alias("at"), x["first"].alias("first"), x["last"].alias("last"))).alias("kids"))
        out = own if out is None else out.unionByName(own)
        rows = up.select("g", "level", "node", F.col("p.top").alias("top"), (-F.col("p.k")).alias("at"), "first", "last")
    return out


def ahead_of(blocks: DataFrame, tree: DataFrame, levels: int) -> DataFrame:
    """(g, b, ahead): boxes that cover all rows behind a block, nearest first: right siblings of the block and of its ancestors."""
    up = blocks.select("g", "b", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("l"))
    up = up.select("g", "b", (F.col("l") + 1).alias("level"), F.floor(F.col("b") / F.pow(F.lit(FANOUT), F.col("l"))).alias("own"), F.floor(F.col("b") / F.pow(F.lit(FANOUT), F.col("l") + 1)).alias("node"))
    found = up.join(tree, ["g", "level", "node"]).select("g", "b", "level", F.filter("kids", lambda k: k["node"] > F.col("own")).alias("k"))
    return found.groupBy("g", "b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("level", "k"))), lambda x: x["k"])).alias("ahead"))


def opened(t: np.ndarray, y: np.ndarray, met: np.ndarray, tilt: float, scale: float, boxes: list, horizontal: bool) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(box, rows that open it, what they have met before it) of the boxes, in order of place."""
    if not len(boxes) or not len(t):
        return
    top, at, first, last = (np.array([b[k] for b in boxes], float) for k in ("top", "at", "first", "last"))
    here = t.astype(float)[:, None]
    rise = top[None] - (y - tilt * t)[:, None]
    sure = np.broadcast_to(top[None], rise.shape) if horizontal else rise / (at[None] - here)
    before = np.maximum.accumulate(np.column_stack([met, sure]), axis=1)[:, :-1]
    if horizontal:
        may = (before < y[:, None]) & (top[None] > before)
    else:
        most = rise / np.where(rise >= 0, first[None] - here, last[None] - here)
        may = most >= before - SLACK * (scale + np.abs(before, where=np.isfinite(before), out=np.zeros_like(before)))
    for k in np.flatnonzero(may.any(axis=0)):
        rows = np.flatnonzero(may[:, k])
        yield boxes[k], rows, before[rows, k]


def seen(t: np.ndarray, y: np.ndarray, met: np.ndarray, t2: np.ndarray, y2: np.ndarray, horizontal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, measure) of the records among the others above what each row has met, and what it has met after them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.broadcast_to(y2[None], (len(t), len(t2))).copy() if horizontal else (y2[None] - y[:, None]) / (t2[None] - t[:, None]).astype(float)
    slope[t2[None] <= t[:, None]] = -np.inf
    run = np.maximum.accumulate(np.column_stack([met, slope]), axis=1)
    ok = (t2[None] > t[:, None]) & ((slope > run[:, :-1]) | (run[:, :-1] == -np.inf))
    if horizontal:
        # Also the first one that is not lower ends the view; equal heights hide each other's followers.
        ok = (t2[None] > t[:, None]) & (run[:, :-1] < np.minimum(y[:, None], y2[None]))
    i, j = np.nonzero(ok)
    return i, j, slope[i, j], run[:, -1]


ASKED = ["g", "level", "node", "t", "y", "met", "own", "tilt", "scale"]
FOUND = ["src", "dst", "yi", "yj"]


def asking(r, own: np.ndarray, met: np.ndarray, boxes: list, horizontal: bool) -> Iterator[dict]:
    """One row for each box that rows of ``r`` open."""
    t, y = np.asarray(r.t), np.asarray(r.y, float)
    for box, rows, before in opened(t, y, met, r.tilt, r.scale, boxes, horizontal):
        yield {"g": r.g, "level": box["level"], "node": box["node"], "t": t[rows], "y": y[rows], "met": before, "own": own[rows], "tilt": r.tilt, "scale": r.scale, **dict.fromkeys(FOUND)}


def _near(horizontal: bool):
    """A row for each block with the edges inside it (level -1), and what its rows ask of the boxes ahead."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out, held = [], 0
            for r in part.itertuples(index=False):
                t, y = np.asarray(r.t), np.asarray(r.y, float)
                i, j, _, met = seen(t, y, np.full(len(t), -np.inf), t, y, horizontal)
                held += len(i)
                out.append(dict.fromkeys(ASKED) | {"g": r.g, "level": -1, "node": -1, "tilt": r.tilt, "scale": r.scale, "src": t[i], "dst": t[j], "yi": y[i], "yj": y[j]})
                if r.ahead is not None:
                    asks = list(asking(r, met, met - (0.0 if horizontal else r.tilt), list(r.ahead), horizontal))
                    held += sum(len(x["t"]) for x in asks)
                    out += asks
                if held >= HELD:
                    yield pd.DataFrame(out, columns=ASKED + FOUND)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=ASKED + FOUND)

    return run


def _down(horizontal: bool):
    """What opened nodes pass on to their children."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, held = [], 0
            for r in part.itertuples(index=False):
                for x in asking(r, np.asarray(r.own, float), np.asarray(r.met, float), list(r.kids), horizontal):
                    rows.append(x)
                    held += len(x["t"])
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=ASKED)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=ASKED)

    return run


def _far(horizontal: bool):
    """Candidates in opened blocks: rows above all that was surely met before."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out, held = [], 0
            for r in part.itertuples(index=False):
                t, y, own = np.asarray(r.t), np.asarray(r.y, float), np.asarray(r.own, float)
                t2, y2, met = np.asarray(r.t2), np.asarray(r.y2, float), np.asarray(r.met, float)
                if not horizontal:
                    met = np.maximum(own, met + r.tilt - SLACK * (r.scale + np.abs(met, where=np.isfinite(met), out=np.zeros_like(met))))
                i, j, slope, _ = seen(t, y, met, t2, y2, horizontal)
                out.append(pd.DataFrame({"g": r.g, "src": t[i], "dst": t2[j], "yi": y[i], "yj": y2[j], "slope": slope, "own": own[i]}))
                held += len(i)
                if held >= HELD:
                    yield pd.concat(out)
                    out, held = [], 0
            yield pd.concat(out) if out else pd.DataFrame(columns=["g", "src", "dst", "yi", "yj", "slope", "own"])

    return run


def candidates(df: DataFrame, horizontal: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Edges (g, src, dst, yi, yj) within blocks, and candidates (with slope and own) between them; None if no series is longer than a block."""
    # A row of a batch is a block with its edges, so batches are small.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    blocks = blocks_of(df)
    most = blocks.agg(F.max("b")).first()[0] or 0
    levels = 0
    while FANOUT**levels <= most:
        levels += 1
    listed = lambda rows: rows.filter("level = -1").select("g", F.explode(F.arrays_zip(*FOUND)).alias("e")).select("g", "e.*")
    if not levels:
        rows = blocks.select("g", "t", "y", F.lit(0.0).alias("tilt"), F.lit(0.0).alias("scale"), F.lit(None).cast(BOX).alias("ahead"))
        return listed(rows.mapInPandas(_near(horizontal), f"{ASK}, {NEAR}")), None
    blocks = stored(tilted(blocks, horizontal))
    tree = tree_of(blocks, levels)
    rows = blocks.join(ahead_of(blocks, tree, levels), ["g", "b"], "left").select("g", "t", "y", "tilt", "scale", "ahead")
    near = stored(rows.mapInPandas(_near(horizontal), f"{ASK}, {NEAR}"))
    asks = near.filter("level >= 0").select(*ASKED)
    for level in range(levels - 1, 0, -1):
        at = asks.filter(F.col("level") == level).join(tree.filter(F.col("level") == level).drop("level"), ["g", "node"])
        asks = stored(asks.filter(F.col("level") < level).unionByName(at.mapInPandas(_down(horizontal), ASK)))
    found = asks.join(blocks.select("g", F.col("b").alias("node"), F.col("t").alias("t2"), F.col("y").alias("y2")), ["g", "node"])
    return listed(near), found.mapInPandas(_far(horizontal), f"g string, {EDGE}")


def edges(df: DataFrame, horizontal: bool = False) -> DataFrame:
    """(g, src, dst, yi, yj): candidates are decided by the slopes or heights of all candidates before them."""
    near, far = candidates(df, horizontal)
    if far is None:
        return near
    before = F.max("slope").over(Window.partitionBy("g", "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1))
    top = F.greatest(F.col("own"), F.coalesce(before, F.lit(float("-inf"))))
    limit = F.least("yi", "yj") if horizontal else F.col("slope")
    return near.unionByName(far.withColumn("__top", top).filter(F.col("__top") < limit).select("g", "src", "dst", "yi", "yj"))
