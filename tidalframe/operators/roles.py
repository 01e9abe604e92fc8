"""Roles of nodes: centralities by joins of edges, clustered over the node table by k-means.

Ranks and core numbers are rounds over edges, a few to a stored table; shortest paths are
frontiers (graph, source, node) that carry their counts forth and the dependencies back. Pairs of
source and node are as many as rows, so large graphs should state their sources.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import stored
from .networks import both_ends, simple, triangles_of, upward

FEATURES = ["degree", "clustering", "pagerank", "eigenvector", "core", "betweenness", "closeness"]
DAMPING, STEPS, AT_ONCE, TOLERANCE = 0.85, 100, 10, 1e-9


def _all_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("n > 0").select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("u"))


def core_numbers(along: DataFrame, every: DataFrame) -> DataFrame:
    """(g, u, core): bounds fall from degrees; a node's bound is the greatest h that h of its neighbours reach."""
    degree = along.groupBy("g", "u").agg(F.count(F.lit(1)).alias("core"))
    state = stored(every.select("g", "u").join(degree, ["g", "u"], "left").na.fill(0, ["core"]))
    while True:
        around = along.join(state.select("g", F.col("u").alias("v"), "core"), ["g", "v"]).groupBy("g", "u", "core").agg(F.count(F.lit(1)).alias("c"))
        reach = F.sum("c").over(Window.partitionBy("g", "u").orderBy(F.desc("core")))
        bound = around.withColumn("h", F.least("core", reach)).groupBy("g", "u").agg(F.max("h").alias("h"))
        after = stored(state.join(bound, ["g", "u"], "left").select("g", "u", F.coalesce("h", F.lit(0)).alias("core"), (F.coalesce("h", F.lit(0)) < F.col("core")).alias("fell")))
        if not after.agg(F.max("fell")).first()[0]:
            return after.select("g", "u", "core")
        state = after.drop("fell")


def ranks(along: DataFrame, every: DataFrame) -> DataFrame:
    """(g, u, pagerank, eigenvector): both powers in the same rounds, until neither moves or after ``STEPS``.

    A step is one exchange: what lone nodes pass on follows from their number, as all of them have
    the same rank, so each node carries it; vectors are scaled once a round.
    """
    degree = along.groupBy("g", "u").agg(F.count(F.lit(1)).alias("d"))
    start = every.join(degree, ["g", "u"], "left").na.fill(0, ["d"]).withColumn("lone", F.sum((F.col("d") == 0).cast("long")).over(Window.partitionBy("g")))
    state = stored(start.select("g", "u", "n", "d", "lone", (F.col("lone") / F.col("n")).alias("alone"), (1 / F.col("n")).alias("r"), (1 / F.sqrt("n")).alias("e")))
    # A node also sends its state to itself, so that a round reads the rows of the one before once.
    ways = stored(along.withColumn("own", F.lit(False)).unionByName(every.select("g", "u", F.col("u").alias("v"), F.lit(True).alias("own"))))
    # The steps of a round are one statement, which is analysed once, not anew with each step on the last ones.
    kept = lambda *names: ", ".join(f"max(if(own, {c}, null)) AS {c}" for c in names)
    base = f"(({1 - DAMPING}D + {DAMPING}D * alone) / n)"
    steps = ["s0 AS (SELECT *, r AS r0, e AS e0 FROM {state})"]
    for k in range(1, AT_ONCE + 1):
        steps.append(
            f"m{k} AS (SELECT w.g, w.v AS u, {kept('n', 'd', 'lone', 'r0', 'e0', 'alone')}, coalesce(sum(if(own, null, r / nullif(d, 0))), 0D) AS a, sum(e) AS e FROM {{ways}} w JOIN s{k - 1} s ON w.g = s.g AND w.u = s.u GROUP BY w.g, w.v), "
            f"s{k} AS (SELECT g, u, n, d, lone, r0, e0, lone * {base} AS alone, {base} + {DAMPING}D * a AS r, e FROM m{k})"
        )
    text = f"WITH {', '.join(steps)} SELECT * FROM s{AT_ONCE}"
    for _ in range(STEPS // AT_ONCE):
        rows = along.sparkSession.sql(text, state=state, ways=ways)
        norm = F.sqrt(F.sum(F.col("e") * F.col("e")).over(Window.partitionBy("g")))
        rows = stored(rows.withColumn("e", F.col("e") / norm))
        step = rows.agg(F.max(F.greatest(F.abs(F.col("r") - F.col("r0")), F.abs(F.col("e") - F.col("e0"))))).first()[0]
        state = rows.drop("r0", "e0")
        if step is None or step < TOLERANCE:
            break
    return state.select("g", "u", F.col("r").alias("pagerank"), F.col("e").alias("eigenvector"))


def shortest_paths(along: DataFrame, every: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(g, u, betweenness, closeness): shares of shortest paths between other nodes (each pair once), and closeness with the reached share of the graph."""
    start = every.select("g", F.col("u").alias("s")) if sources is None else sources.select("g", F.col("node").cast("long").alias("s")).distinct()
    levels = [stored(start.withColumn("v", F.col("s")).withColumn("paths", F.lit(1.0)))]
    while True:
        step = levels[-1].withColumnRenamed("v", "u").join(along, ["g", "u"]).groupBy("g", "s", "v").agg(F.sum("paths").alias("paths"))
        for seen in levels[-2:]:
            step = step.join(seen, ["g", "s", "v"], "left_anti")
        step = stored(step)
        if step.isEmpty():
            break
        levels.append(step)
    hops, depends, after = None, None, None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("share", F.lit(0.0)) if after is None else levels[k].join(after, ["g", "s", "v"], "left").na.fill(0.0, ["share"])
        one = here.groupBy("g", "s").agg(F.count(F.lit(1)).alias("c")).withColumn("hops", F.col("c") * k)
        hops = one if hops is None else hops.unionByName(one)
        own = here.groupBy("g", F.col("v").alias("u")).agg(F.sum("share").alias("b"))
        depends = own if depends is None else depends.unionByName(own)
        back = here.select("g", "s", "v", ((1 + F.col("share")) / F.col("paths")).alias("x")).join(along, ["g", "v"]).join(levels[k - 1].select("g", "s", F.col("v").alias("u"), "paths"), ["g", "s", "u"])
        after = stored(back.groupBy("g", "s", F.col("u").alias("v")).agg(F.sum(F.col("paths") * F.col("x")).alias("share")))
    out = every
    if hops is not None:
        far = hops.groupBy("g", F.col("s").alias("u")).agg(F.sum("c").alias("c"), F.sum("hops").alias("hops"))
        between = depends.groupBy("g", "u").agg((F.sum("b") / 2).alias("betweenness"))
        out = out.join(far, ["g", "u"], "left").join(between, ["g", "u"], "left").withColumn("closeness", F.col("c") * F.col("c") / F.nullif(F.col("hops") * (F.col("n") - 1), F.lit(0)))
    else:
        out = out.withColumn("betweenness", F.lit(0.0)).withColumn("closeness", F.lit(0.0))
    return out.select("g", "u", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def centralities(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(g, node, degree, clustering, pagerank, eigenvector, core, betweenness, closeness)."""
    e = stored(simple(edges))
    along, every = stored(both_ends(e)), stored(_all_nodes(nodes))
    degree = along.groupBy("g", "u").agg(F.count(F.lit(1)).cast("double").alias("degree"))
    corners = triangles_of(upward(e)).select("g", F.explode(F.array("x", "y", "z")).alias("u")).groupBy("g", "u").agg(F.count(F.lit(1)).alias("t"))
    rows = every.join(degree, ["g", "u"], "left").join(corners, ["g", "u"], "left").na.fill(0, ["degree", "t"])
    rows = rows.withColumn("clustering", F.coalesce(2 * F.col("t") / F.nullif(F.col("degree") * (F.col("degree") - 1), F.lit(0.0)), F.lit(0.0)))
    for part in (ranks(along, every), core_numbers(along, every), shortest_paths(along, every, sources)):
        rows = rows.join(part, ["g", "u"])
    return rows.select("g", F.col("u").alias("node"), *[F.col(c).cast("double").alias(c) for c in FEATURES])


def roles(edges: DataFrame, nodes: DataFrame, n_roles: int = 4, seed: int = 3363, sources: DataFrame | None = None) -> DataFrame:
    """The centralities with ``role``: k-means over features standardised within each graph, all graphs together.

    Roles are numbered from 0 by the mean degree of their nodes, so that reruns agree.
    """
    rows = stored(centralities(edges, nodes, sources))
    own = Window.partitionBy("g")
    scaled = [F.coalesce((F.col(c) - F.avg(c).over(own)) / F.nullif(F.stddev_samp(c).over(own), F.lit(0.0)), F.lit(0.0)).alias(f"z_{c}") for c in FEATURES]
    table = VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="x").transform(rows.select("*", *scaled))
    distinct = table.select("x").distinct().limit(n_roles).count()
    if distinct < 2:
        return rows.withColumn("role", F.lit(0).cast("long"))
    found = KMeans(k=min(n_roles, distinct), seed=seed, featuresCol="x", predictionCol="p", maxIter=50).fit(table).transform(table)
    named = found.groupBy("p").agg(F.avg("z_degree").alias("m")).withColumn("role", (F.row_number().over(Window.orderBy("m", "p")) - 1).cast("long"))
    return found.join(F.broadcast(named.select("p", "role")), "p").select("g", "node", *FEATURES, "role")
