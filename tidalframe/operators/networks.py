"""Measures of whole graphs by joins of edges: all paths, and counts of small subgraphs.

Nothing here holds a graph in one task. Edges are ordered by the degrees of their ends, so a
node has few neighbours above it, whatever its degree, and a hub's wedges are never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import discard, stored


def simple(edges: DataFrame) -> DataFrame:
    """(g, a, b), a < b: each undirected edge once, without loops."""
    return edges.filter(F.col("src") != F.col("dst")).select("g", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ends(e: DataFrame) -> DataFrame:
    """(g, u, v) in both directions."""
    return e.select("g", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select("g", F.col("b").alias("u"), F.col("a").alias("v")))


def degrees_of(e: DataFrame) -> DataFrame:
    return both_ends(e).groupBy("g", "u").agg(F.count(F.lit(1)).alias("d"))


def upward(e: DataFrame) -> DataFrame:
    """(g, u, v, du, dv): each edge from its end of lower degree (then number) to the other."""
    d = degrees_of(e)
    known = e.join(d.select("g", F.col("u").alias("a"), F.col("d").alias("da")), ["g", "a"]).join(d.select("g", F.col("u").alias("b"), F.col("d").alias("db")), ["g", "b"])
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return known.select("g", pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("da", "db").alias("du"), pick("db", "da").alias("dv"))


def above(x: str, dx: str, y: str, dy: str) -> Column:
    return (F.col(dx) < F.col(dy)) | ((F.col(dx) == F.col(dy)) & (F.col(x) < F.col(y)))


def triangles_of(up: DataFrame) -> DataFrame:
    """(g, x, y, z), each triangle once, rising in the order of ``upward``: wedges open at their lowest node."""
    one = up.select("g", F.col("u").alias("x"), F.col("v").alias("y"), F.col("dv").alias("dy"))
    two = up.select("g", F.col("u").alias("x"), F.col("v").alias("z"), F.col("dv").alias("dz"))
    wedges = one.join(two, ["g", "x"]).filter(above("y", "dy", "z", "dz"))
    return wedges.join(up.select("g", F.col("u").alias("y"), F.col("v").alias("z")), ["g", "y", "z"]).select("g", "x", "y", "z")


def path_lengths(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(g, avg_path, diameter, radius, eccentricity_std) of each graph's largest component; null for one of a single node.

    A frontier (graph, source, node) moves along all edges at once, a stored table a level; what
    it reaches is new unless it lies on one of the two levels before. Every node is a source
    unless ``sources`` (g, node) states them, as one should for large graphs, since pairs of
    nodes are as many as rows; then averages are over the stated sources in the component, and
    diameter and radius are those of their eccentricities. Of components of equal size the one
    with the smallest node counts.
    """
    along = stored(both_ends(simple(edges)))
    every = nodes.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("s")).filter("s >= 0")
    start = every if sources is None else every.join(sources.select("g", F.col("node").cast("long").alias("s")).distinct(), ["g", "s"])
    frontier, before, level, tables, counts = stored(start.withColumn("v", F.col("s"))), None, 0, [], None
    while True:
        found = frontier.groupBy("g", "s").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least")).withColumn("level", F.lit(level))
        found = stored(found)
        if found.isEmpty():
            break
        counts = found if counts is None else counts.unionByName(found)
        step = frontier.withColumnRenamed("v", "u").join(along, ["g", "u"]).select("g", "s", "v").distinct()
        step = step.join(frontier, ["g", "s", "v"], "left_anti")
        after = stored(step if before is None else step.join(before, ["g", "s", "v"], "left_anti"))
        if before is not None:
            discard(before)
        frontier, before, level = after, frontier, level + 1
        tables.append(found)
    if counts is None:
        counts = stored(start.select("g", "s", F.lit(1).cast("long").alias("c"), F.col("s").alias("least"), F.lit(0).alias("level")))
    by_source = counts.groupBy("g", "s").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("level")).alias("hops"), F.max("level").alias("far"), F.min("least").alias("least"))
    largest = by_source.groupBy("g").agg(F.max(F.struct("size", (-F.col("least")).alias("k"))).alias("top")).select("g", (-F.col("top.k")).alias("least"))
    own = by_source.join(largest, ["g", "least"]).filter("size > 1").groupBy("g").agg((F.sum("hops") / F.sum(F.col("size") - 1)).alias("avg_path"), F.max("far").cast("double").alias("diameter"), F.min("far").cast("double").alias("radius"), F.stddev_pop("far").alias("eccentricity_std"))
    return nodes.select("g").join(own, "g", "left")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.na.fill(0)


def motifs3(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, code, n) over all node triples i < j < k; bits for edges i > j, i > k, j > k; codes that do not occur are left out.

    Triangles are listed; pairs of edges follow from degrees to either side, single edges from
    the places of their ends, and what is left has none.
    """
    e = stored(edges.filter(F.col("src") < F.col("dst")).select("g", F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    up, down = e.groupBy("g", F.col("a").alias("u")).agg(F.count(F.lit(1)).alias("o")), e.groupBy("g", F.col("b").alias("u")).agg(F.count(F.lit(1)).alias("i"))
    sides = up.join(down, ["g", "u"], "full").na.fill(0, ["o", "i"]).groupBy("g").agg(F.sum(pairs("o")).alias("oo"), F.sum(F.col("i") * F.col("o")).alias("io"), F.sum(pairs("i")).alias("ii"))
    places = e.join(nodes, "g").groupBy("g").agg(F.sum("a").alias("low"), F.sum(F.col("b") - F.col("a") - 1).alias("mid"), F.sum(F.col("n") - 1 - F.col("b")).alias("high"))
    three = triangles_of(upward(e)).groupBy("g").agg(F.count(F.lit(1)).alias("t"))
    known = _filled(nodes.join(sides, "g", "left").join(places, "g", "left").join(three, "g", "left"))
    codes = {"111": F.col("t"), "110": F.col("oo") - F.col("t"), "101": F.col("io") - F.col("t"), "011": F.col("ii") - F.col("t")}
    codes |= {"100": F.col("high") - codes["110"] - codes["101"] - codes["111"], "010": F.col("mid") - codes["110"] - codes["011"] - codes["111"], "001": F.col("low") - codes["101"] - codes["011"] - codes["111"]}
    codes["000"] = F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6 - sum(codes.values())
    return _listed(known, codes, "code")


def _listed(known: DataFrame, counts: dict[str, Column], name: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.round(c).cast("long").alias("c")) for k, c in counts.items()])
    return known.select("g", F.explode(rows).alias("x")).select("g", F.col("x.k").alias(name), F.col("x.c").alias("n")).filter("n > 0")


def motifs4(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, motif, n): all sets of four nodes by the subgraph they induce; motifs that do not occur are left out.

    Stars, chains, tailed triangles and diamonds with or without further edges follow from
    degrees and triangles; squares are counted at their highest node, by wedges that stay below
    it, and cliques by two triangles over the same lowest edge. Subtraction gives the induced ones.
    """
    e = stored(simple(edges))
    up = stored(upward(e))
    d = degrees_of(e)
    three = stored(triangles_of(up))
    corners = three.select("g", F.explode(F.array("x", "y", "z")).alias("u")).groupBy("g", "u").agg(F.count(F.lit(1)).alias("t"))
    stars = d.groupBy("g").agg(F.sum(F.col("d") * (F.col("d") - 1) * (F.col("d") - 2) / 6).alias("star"))
    chains = up.groupBy("g").agg(F.sum((F.col("du") - 1) * (F.col("dv") - 1)).alias("chain"))
    tails = corners.join(d, ["g", "u"]).groupBy("g").agg(F.sum(F.col("t") * (F.col("d") - 2)).alias("tail"), (F.sum("t") / 3).alias("t"))
    sides = three.select("g", F.explode(F.array(F.struct(F.col("x").alias("p"), F.col("y").alias("q")), F.struct(F.col("x").alias("p"), F.col("z").alias("q")), F.struct(F.col("y").alias("p"), F.col("z").alias("q")))).alias("k"))
    diamonds = sides.groupBy("g", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("diamond"))
    # Wedges u - m - w with m and w below u: m has the lower degree, so its neighbours are few.
    around = up.select("g", F.col("u").alias("m"), F.col("v").alias("w"), F.col("dv").alias("dw")).unionByName(up.select("g", F.col("v").alias("m"), F.col("u").alias("w"), F.col("du").alias("dw")))
    wedges = up.select("g", F.col("v").alias("u"), F.col("dv").alias("du"), F.col("u").alias("m")).join(around, ["g", "m"]).filter((F.col("w") != F.col("u")) & above("w", "dw", "u", "du"))
    squares = wedges.groupBy("g", "u", "w").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("square"))
    over = three.join(three.select("g", "x", "y", F.col("z").alias("w")), ["g", "x", "y"]).filter(F.col("z") != F.col("w"))
    cliques = over.join(up.select("g", F.col("u").alias("z"), F.col("v").alias("w")), ["g", "z", "w"]).groupBy("g").agg(F.count(F.lit(1)).alias("clique"))
    known = nodes
    for part in (stars, chains, tails, diamonds, squares, cliques):
        known = known.join(part, "g", "left")
    known = _filled(known)
    n, t, k = F.col("n"), F.col("t"), F.col("clique")
    diamond = F.col("diamond") - 6 * k
    square = F.col("square") - diamond - 3 * k
    tail = F.col("tail") - 4 * diamond - 12 * k
    star = F.col("star") - tail - 2 * diamond - 4 * k
    chain = F.col("chain") - 3 * t - 4 * square - 2 * tail - 6 * diamond - 12 * k
    alone = t * (n - 3) - tail - 2 * diamond - 4 * k
    counts = {"clique": k, "diamond": diamond, "square": square, "triangle_tail": tail, "star": star, "chain": chain, "triangle_isolated": alone}
    counts["other"] = n * (n - 1) * (n - 2) * (n - 3) / 24 - sum(counts.values())
    return _listed(known, counts, "motif")
