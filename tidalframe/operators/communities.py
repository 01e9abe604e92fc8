"""Communities of graphs by moves that are aggregates over edges.

In a round half of the nodes, picked by a hash, move at once to the label of the greatest gain;
ties go to the smallest label. The modularity of each round's labels is counted, and a graph
keeps its best ones, so moves that hinder each other cost a round and nothing else. When no
graph improves, communities become nodes and the rounds begin anew. Labels are tables; the
driver sees one row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..stages import discard, stored
from .networks import both_ends, simple

ROUNDS, LEVELS = 60, 20
#: Rounds without a better graph that end a level: each half of the nodes has had a turn.
PATIENCE = 3
METHODS = ("louvain", "leiden", "greedy", "label_propagation")


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("n > 0").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("node"))


def _weights(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, u, c, w): the weight from each node to each label among its neighbours."""
    return links.join(labels.select("g", F.col("u").alias("v"), F.col("c")), ["g", "v"]).groupBy("g", "u", "c").agg(F.sum("w").alias("w"))


def _round(links: DataFrame, labels: DataFrame, totals: DataFrame, resolution: float, turn: int) -> DataFrame:
    """(g, u, c, k, loop, own, next): labels, the weight to their own one, and the labels after the round."""
    spread = labels.groupBy("g", "c").agg(F.sum("k").alias("all"))
    to = _weights(links, labels).unionByName(labels.select("g", "u", "c", F.lit(0.0).alias("w"))).groupBy("g", "u", "c").agg(F.sum("w").alias("w"))
    to = to.join(spread, ["g", "c"]).join(labels.select("g", "u", "k", "loop", F.col("c").alias("mine")), ["g", "u"]).join(totals, "g")
    here = F.col("c") == F.col("mine")
    gain = F.col("w") - resolution * F.col("k") * (F.col("all") - F.when(here, F.col("k")).otherwise(0.0)) / F.nullif("total", F.lit(0.0))
    best = to.withColumn("gain", F.coalesce(gain, F.lit(0.0))).groupBy("g", "u").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("top"), F.max(F.when(here, F.col("gain"))).alias("stay"), F.max(F.when(here, F.col("w"))).alias("own"), F.max("mine").alias("c"), F.max("k").alias("k"), F.max("loop").alias("loop"))
    active = F.pmod(F.xxhash64("g", "u", F.lit(turn)), F.lit(2)) == 0
    moved = active & (F.col("top.gain") > F.col("stay") + 1e-12)
    return best.select("g", "u", "c", "k", "loop", "own", F.when(moved, -F.col("top.c")).otherwise(F.col("c")).alias("next"))


def _quality(rows: DataFrame, totals: DataFrame, resolution: float) -> DataFrame:
    """(g, q, moves) of (g, u, c, k, loop, own, next)."""
    inside = rows.groupBy("g", "c").agg(F.sum("k").alias("k"), F.sum(F.col("own") + 2 * F.col("loop")).alias("in"), F.sum((F.col("next") != F.col("c")).cast("int")).alias("m"))
    part = F.col("in") / F.col("total") - resolution * F.pow(F.col("k") / F.col("total"), F.lit(2.0))
    return inside.join(totals.filter("total > 0"), "g").groupBy("g").agg(F.sum(part).alias("q"), F.sum("m").alias("moves"))


def _moved(links: DataFrame, labels: DataFrame, totals: DataFrame, resolution: float, level: int) -> DataFrame:
    """(g, u, c): the best labels of each graph over the rounds of a level; stored."""
    best, stale = stored(labels.select("g", "u", "c").join(totals.select("g"), "g").withColumn("q", F.lit(float("-inf")))), 0
    for turn in range(ROUNDS):
        rows = stored(_round(links, labels, totals, resolution, 1000 * level + turn))
        quality = _quality(rows, totals, resolution)
        pick = rows.select("g", "u", F.col("c").alias("now")).join(quality, "g", "left").join(best.select("g", "u", F.col("c").alias("old"), F.col("q").alias("had")), ["g", "u"])
        better = F.coalesce(F.col("q") > F.col("had") + 1e-12, F.lit(False))
        new = stored(pick.select("g", "u", F.when(better, F.col("now")).otherwise(F.col("old")).alias("c"), F.when(better, F.col("q")).otherwise(F.col("had")).alias("q"), better.alias("better"), F.coalesce("moves", F.lit(0)).alias("moves")))
        discard(best)
        best = new
        flags = best.agg(F.max("better"), F.max("moves")).first()
        stale = 0 if flags[0] else stale + 1
        if stale >= PATIENCE or (not flags[1] and turn % 2):
            break
        labels = rows.select("g", "u", F.col("next").alias("c"), "k", "loop")
    return best.select("g", "u", "c")


def _propagated(links: DataFrame, every: DataFrame) -> DataFrame:
    """(g, u, c) by label propagation: half of the nodes a round take the most frequent label around them, their own if it is one of those, else the smallest."""
    labels = stored(every.select("g", F.col("node").alias("u"), F.col("node").alias("c")))
    for turn in range(ROUNDS):
        count = _weights(links, labels).join(labels.select("g", "u", F.col("c").alias("mine")), ["g", "u"])
        top = count.groupBy("g", "u").agg(F.max(F.struct("w", (F.col("c") == F.col("mine")).alias("stay"), (-F.col("c")).alias("k"))).alias("t"))
        active = F.pmod(F.xxhash64("g", "u", F.lit(turn)), F.lit(2)) == 0
        rows = stored(labels.join(top, ["g", "u"], "left").select("g", "u", F.col("c").alias("was"), F.when(active & F.col("t").isNotNull(), -F.col("t.k")).otherwise(F.col("c")).alias("c"), F.coalesce(-F.col("t.k") != F.col("c"), F.lit(False)).alias("open")))
        if not rows.agg(F.max("open")).first()[0]:
            break
        labels = rows.select("g", "u", "c")
    return labels.select("g", "u", "c")


def communities(edges: DataFrame, nodes: DataFrame, method: str = "louvain", resolution: float = 1.0) -> DataFrame:
    """(g, node, label): a community is named by its smallest node. Lone nodes are communities of their own."""
    if method not in METHODS:
        raise ValidationError("unknown method", {"method": method})
    every, e = _nodes(nodes), both_ends(simple(edges))
    links = stored(e.withColumn("w", F.lit(1.0)))
    if method == "label_propagation":
        member = _propagated(links, every).withColumnRenamed("u", "node")
    else:
        degree = links.groupBy("g", F.col("u").alias("node")).agg(F.sum("w").alias("k"))
        labels = stored(every.join(degree, ["g", "node"], "left").select("g", F.col("node").alias("u"), F.col("node").alias("c"), F.coalesce("k", F.lit(0.0)).alias("k"), F.lit(0.0).alias("loop")))
        totals = stored(labels.groupBy("g").agg(F.sum("k").alias("total")))
        member = every.withColumn("c", F.col("node"))
        for level in range(LEVELS):
            best = _moved(links, labels, totals, resolution, level)
            moved = stored(member.withColumnRenamed("c", "u").join(best, ["g", "u"]).select("g", "node", "c"))
            shrunk = labels.agg(F.count(F.lit(1))).first()[0] - best.select("g", "c").distinct().count()
            member = moved
            if not shrunk:
                break
            ends = links.join(best, ["g", "u"]).select("g", F.col("c").alias("a"), "v", "w").join(best.select("g", F.col("u").alias("v"), F.col("c").alias("b")), ["g", "v"])
            merged = stored(ends.groupBy("g", "a", "b").agg(F.sum("w").alias("w")))
            inner = merged.filter("a = b").select("g", F.col("a").alias("c"), (F.col("w") / 2).alias("inner"))
            sums = labels.drop("c").join(best, ["g", "u"]).groupBy("g", "c").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(inner, ["g", "c"], "left")
            labels = stored(sums.select("g", F.col("c").alias("u"), "c", "k", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop")))
            links = merged.filter("a <> b").select("g", F.col("a").alias("u"), F.col("b").alias("v"), "w")
    return member.select("g", "node", F.min("node").over(Window.partitionBy("g", "c")).alias("label"))


def modularity_of(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(g, modularity, n_communities) of labels (g, node, label); 0 for a graph without edges."""
    e = both_ends(simple(edges))
    at = lambda n, c: labels.select("g", F.col("node").alias(n), F.col("label").alias(c))
    inside = e.join(at("u", "a"), ["g", "u"]).join(at("v", "b"), ["g", "v"]).groupBy("g", F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("in"))
    total = F.sum("k").over(Window.partitionBy("g"))
    parts = inside.withColumn("total", total).withColumn("q", F.col("in") / F.col("total") - resolution * F.pow(F.col("k") / F.col("total"), F.lit(2.0)))
    found = parts.groupBy("g").agg(F.sum("q").alias("modularity"))
    count = labels.groupBy("g").agg(F.countDistinct("label").alias("n_communities"))
    return count.join(found, "g", "left").select("g", F.coalesce("modularity", F.lit(0.0)).alias("modularity"), "n_communities")


def modularity(edges: DataFrame, nodes: DataFrame, method: str = "louvain", resolution: float = 1.0) -> DataFrame:
    """(g, modularity, n_communities) of the communities that ``method`` finds."""
    return modularity_of(edges, stored(communities(edges, nodes, method, resolution)), resolution)
