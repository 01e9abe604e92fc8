"""Series graphs as edge tables (g, src, dst, weight); ``g`` names the graph, here the series.

Nodes are positions 0..n-1 of table (g, n). Undirected edges are listed once, src < dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import ID, POS, VALUE, W
from ..functions.columns import correlation
from ..stages import stored
from . import grid, neighbours, networks, sight
from .networks import motifs3  # noqa: F401


def value() -> Column:
    return F.col(VALUE)


def position() -> Column:
    return F.col(POS)


def nodes_of(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col(ID).alias("g")).agg(F.count(F.lit(1)).alias("n"))


def renumber_finite(df: DataFrame) -> DataFrame:
    """Finite values only, positions made dense."""
    rows = df.filter(value().isNotNull() & (F.abs(value()) != float("inf")))
    return rows.withColumn(POS, (F.row_number().over(W) - 1).cast("long"))


def build(df: DataFrame, method: str = "hvg", **params) -> DataFrame:
    """Edges by the name of the construction."""
    if method in ("hvg", "nvg"):
        return visibility(df, **params)
    if method == "recurrence":
        return recurrence(df, **params)
    if method == "transition":
        return transitions(df, **params)
    raise ValidationError("unknown graph", {"method": method})


def build_windows(df: DataFrame, width: int, step: int = 1, method: str = "hvg", **params) -> DataFrame:
    """Graph features of every sliding window: (series_id, window, ...)."""
    rows = in_windows(df, width, step)
    nodes = nodes_of(rows) if method != "transition" else symbols(rows, params.get("n_bins", 10), params.get("ordinal")).groupBy("g").agg((F.max("s") + 1).cast("long").alias("n"))
    out = features(build(rows, method, **params), nodes)
    return out.select(F.substring_index("g", "#", 1).alias(ID), F.substring_index("g", "#", -1).cast("long").alias("window"), *[c for c in out.columns if c != "g"])


def visibility(df: DataFrame, weight: str | None = None, limit: int | None = None, horizontal: bool = False) -> DataFrame:
    """Edges between values that see each other.

    Natural: the slope from i to j exceeds all slopes from i to values between. Horizontal: all
    values between lie below both. ``limit`` bounds j - i and looks at that many rows; without
    it, ``sight`` opens only blocks of a series that hold an edge or nearly so. Rows without a
    value neither see nor hide. weight: None, "difference" (abs(y_j - y_i)) or "length" (of the
    line of sight).
    """
    if limit is None:
        out = sight.edges(df, horizontal)
    else:
        near = F.collect_list(F.struct(position().alias("dst"), value().alias("yj"))).over(W.rowsBetween(1, limit))
        pairs = df.select(F.col(ID).alias("g"), position().alias("src"), value().alias("yi"), near.alias("near")).select("g", "src", "yi", F.explode("near").alias("x")).select("g", "src", "yi", "x.dst", "x.yj")
        between = Window.partitionBy("g", "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
        if horizontal:
            seen, ok = F.max("yj").over(between), F.col("__top") < F.least("yi", "yj")
        else:
            slope = (F.col("yj") - F.col("yi")) / (F.col("dst") - F.col("src"))
            seen, ok = F.max(slope).over(between), slope > F.col("__top")
        out = pairs.filter(F.col("yi").isNotNull() & F.col("yj").isNotNull()).withColumn("__top", seen).filter(F.col("__top").isNull() | ok)
    weights = {None: F.lit(1.0), "difference": F.abs(F.col("yj") - F.col("yi")), "length": F.sqrt(F.pow(F.col("dst") - F.col("src"), 2) + F.pow(F.col("yj") - F.col("yi"), 2))}
    return out.select("g", "src", "dst", weights[weight].alias("weight"))


def build_hvg(df: DataFrame, weighted: bool = False, limit: int | None = None, horizontal: bool = False) -> DataFrame:
    """Edges of the graph named horizontal: the natural test by default, weights are differences of values."""
    return visibility(df, "difference" if weighted else None, limit, horizontal)


def build_nvg(df: DataFrame, weighted: bool = False, limit: int | None = None) -> DataFrame:
    """Edges of the natural visibility graph; weights are lengths of the lines of sight."""
    return visibility(df, "length" if weighted else None, limit)


def recurrence(df: DataFrame, threshold: float | None = None, dimension: int = 1, delay: int = 1, metric: str = "euclidean", k: int | None = None, mode: str = "mutual") -> DataFrame:
    """Edges between near states of the delay embedding: within ``threshold`` (default the 10th
    percentile of all nonzero distances), or among the k nearest, of both states or of one.

    States meet through a grid, so distant states are never paired.
    """
    lagged = df.select(F.col(ID).alias("g"), position().alias("p"), F.array(*[F.lead(value(), d * delay).over(W) for d in range(dimension)]).alias("e"))
    states = stored(lagged.filter(~F.exists("e", lambda x: x.isNull())))
    if k is None:
        if threshold is None:
            near = grid.low_percentile(states, dimension, metric)
        else:
            near = grid.met(states.withColumn("radius", F.lit(float(threshold))), states, metric, dimension, True).select("g", F.col("p").alias("src"), F.col("q").alias("dst"), "d")
        return near.select("g", "src", "dst", F.col("d").alias("weight"))
    near = grid.nearest(states, dimension, metric, k)
    ends = near.groupBy("g", F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).agg(F.count(F.lit(1)).alias("c"), F.max("d").alias("weight"))
    return ends.filter(F.col("c") >= (2 if mode == "mutual" else 1)).select("g", "src", "dst", "weight")


def symbols(df: DataFrame, n_bins: int = 10, ordinal: int | None = None) -> DataFrame:
    """(g, t, s): equal-width bins, or ordinal patterns of ``ordinal`` values, numbered densely."""
    if ordinal:
        window = F.collect_list(F.struct(value().alias("v"), position().alias("k"))).over(W.rowsBetween(0, ordinal - 1))
        rows = df.select(F.col(ID).alias("g"), position().alias("t"), window.alias("w")).filter(F.size("w") == ordinal)
        s = F.array_join(F.transform(F.array_sort("w"), lambda x: (x["k"] - F.col("t")).cast("string")), ",")
    else:
        ends = Window.partitionBy(ID)
        lo, hi = F.min(value()).over(ends), F.max(value()).over(ends)
        bin_ = F.when(hi == lo, 0).otherwise(F.least(F.lit(n_bins - 1), F.floor((value() - lo) / F.nullif((hi - lo) / n_bins, F.lit(0.0)))))
        rows, s = df.select(F.col(ID).alias("g"), position().alias("t"), bin_.alias("b")), F.col("b")
    named = rows.select("g", "t", s.alias("raw"))
    return named.select("g", "t", "raw", (F.dense_rank().over(Window.partitionBy("g").orderBy("raw")) - 1).alias("s"))


def transitions(df: DataFrame, n_bins: int = 10, order: int = 1, ordinal: int | None = None) -> DataFrame:
    """Directed counts (g, src, dst, weight) of symbols ``order`` rows apart."""
    s = symbols(df, n_bins, ordinal)
    rows = s.withColumn("to", F.lead("s", order).over(Window.partitionBy("g").orderBy("t"))).filter(F.col("to").isNotNull())
    return rows.groupBy("g", F.col("s").alias("src"), F.col("to").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("g", "src", "dst").unionByName(edges.select("g", F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node, degree) of all nodes, isolated ones included."""
    all_nodes = nodes.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("node"))
    count = both_ways(edges).groupBy("g", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return all_nodes.join(count, ["g", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def directed_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    all_nodes = nodes.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("node"))
    out = edges.groupBy("g", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy("g", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return all_nodes.join(out, ["g", "node"], "left").join(into, ["g", "node"], "left").na.fill(0, ["in_degree", "out_degree"])


def features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a graph: n_nodes, n_edges, density and degree statistics (population std)."""
    d = degrees(edges, nodes).groupBy("g").agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("avg_degree"), F.stddev_pop("degree").alias("std_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    return d.withColumn("density", F.when(F.col("n_nodes") > 1, 2 * F.col("n_edges") / F.nullif(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(0))).otherwise(0.0))


def degree_arrays(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(edges, nodes).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "degree"))), lambda x: x["degree"]).alias("degrees"))


def irreversibility(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = directed_degrees(edges, nodes).withColumn("total", F.col("in_degree") + F.col("out_degree"))
    return d.groupBy("g").agg(F.avg(F.when(F.col("total") > 0, F.abs(F.col("in_degree") - F.col("out_degree")) / F.nullif("total", F.lit(0)))).alias("irreversibility"))


def triangles(edges: DataFrame) -> DataFrame:
    """(g, a, b, c), each triangle of an undirected graph once: wedges open at their end of lowest degree."""
    return networks.triangles_of(networks.upward(networks.simple(edges))).toDF("g", "a", "b", "c")


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, average, transitivity, std): local clustering over all nodes, isolated ones count 0."""
    corners = triangles(edges).select("g", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("g", "node").agg(F.count(F.lit(1)).alias("tri"))
    rows = degrees(edges, nodes).join(corners, ["g", "node"], "left").withColumn("tri", F.coalesce("tri", F.lit(0)))
    wedges = F.col("degree") * (F.col("degree") - 1) / 2
    local = F.when(F.col("degree") > 1, F.col("tri") / F.nullif(wedges, F.lit(0.0))).otherwise(0.0)
    return rows.groupBy("g").agg(F.avg(local).alias("average"), F.coalesce(F.sum("tri") / F.nullif(F.sum(wedges), F.lit(0.0)), F.lit(0.0)).alias("transitivity"), F.stddev_pop(local).alias("std"))


def assortativity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degrees(edges, nodes)
    ends = both_ways(edges).join(d.select("g", F.col("node").alias("src"), F.col("degree").alias("x")), ["g", "src"]).join(d.select("g", F.col("node").alias("dst"), F.col("degree").alias("y")), ["g", "dst"])
    return ends.groupBy("g").agg(correlation("x", "y").alias("assortativity"))


def knn(distances: DataFrame, k: int, mutual: bool = False, weighted: bool = False) -> DataFrame:
    """Edges (src, dst, weight) to the k nearest of (i, j, d): either direction, or both (mutual).

    One-sided edges of the plain graph have half the weight; mutual ones the smaller weight.
    """
    order = Window.partitionBy("i").orderBy("d", "j")
    near = distances.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("i", "j", (F.col("d") if weighted else F.lit(1.0)).alias("w"))
    ends = near.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "w").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("s"), F.min("w").alias("m"))
    if mutual:
        return ends.filter((F.col("c") == 2) & (F.col("m") > 0)).select("src", "dst", F.col("m").alias("weight"))
    return ends.filter(F.col("s") > 0).select("src", "dst", (F.col("s") / 2).alias("weight"))


def enn(distances: DataFrame, epsilon: float, weighted: bool = False) -> DataFrame:
    """Edges within epsilon of (i, j, d)."""
    near = distances.filter((F.col("i") < F.col("j")) & (F.col("d") <= epsilon))
    near = near.filter(F.col("d") > 0) if weighted else near
    return near.select(F.col("i").alias("src"), F.col("j").alias("dst"), (F.col("d") if weighted else F.lit(1.0)).alias("weight"))


def net_knn(vectors: DataFrame, id_col: str, vector_col: str, k: int, mutual: bool = False, weighted: bool = False) -> DataFrame:
    """The k-nearest-neighbour graph of a table of vectors, by an exact index."""
    return knn(neighbours.nearest(vectors, id_col, vector_col, k), k, mutual, weighted)


def net_enn(vectors: DataFrame, id_col: str, vector_col: str, epsilon: float | None = None, percentile: float | None = None, weighted: bool = False) -> DataFrame:
    """The graph of vectors within epsilon, or within a percentile of all pair distances, by an exact index."""
    index = None
    if epsilon is None:
        if percentile is None:
            raise ValidationError("epsilon or percentile is needed")
        epsilon, index = neighbours.percentile(vectors, id_col, vector_col, percentile)
    epsilon = 0.0 if epsilon is None else epsilon
    index = index or neighbours.build(vectors, id_col, vector_col)
    near = vectors.sparkSession.createDataFrame([], neighbours.PAIRS) if index is None else neighbours.pairs_within(index, epsilon)
    return enn(near, epsilon, weighted)


def in_windows(df: DataFrame, width: int, step: int = 1) -> DataFrame:
    """A panel of sliding windows: series ids ``id#window``, positions from 0."""
    from .clean import sliding_windows

    w = sliding_windows(df, width, step)
    return w.select(F.concat_ws("#", ID, "window").alias(ID), F.posexplode("values").alias(POS, VALUE)).withColumn(POS, F.col(POS).cast("long"))


def multiscale(df: DataFrame, scales: list[int], method: str = "mean") -> DataFrame:
    """A panel of coarse-grained series: ids ``id@scale``; those under 10 rows are left out."""
    agg = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "std": F.stddev_samp}[method]
    rows = df.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).groupBy(ID, "scale", F.floor(position() / F.col("scale")).alias("b")).agg(F.count(F.lit(1)).alias("c"), agg(VALUE).alias(VALUE)).filter(F.col("c") == F.col("scale"))
    out = rows.select(F.concat_ws("@", ID, F.col("scale").cast("string")).alias(ID), F.col("b").cast("long").alias(POS), VALUE)
    long = out.groupBy(ID).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= 10).select(ID)
    return out.join(long, ID, "left_semi")


def small_world(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """sigma from clustering and path length against those of a random graph of equal density."""
    f = features(edges, nodes).join(clustering(edges, nodes), "g").join(paths, "g").join(assortativity(edges, nodes), "g", "left")
    k: Column = F.col("avg_degree")
    c_er, l_er = F.col("density"), F.log("n_nodes") / F.nullif(F.when(k > 1, F.log(k)), F.lit(0.0))
    sigma = (F.col("average") / F.nullif(c_er, F.lit(0.0))) / F.nullif(F.col("avg_path") / l_er, F.lit(0.0))
    return f.withColumn("c_er", c_er).withColumn("l_er", l_er).withColumn("sigma", sigma)


class Graph:
    """One or many graphs with their measures: edges (g, src, dst, weight) and nodes (g, n)."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, directed: bool = False, weighted: bool = False):
        self.edges, self.nodes, self.directed, self.weighted = edges, nodes, directed, weighted

    def n_edges(self) -> DataFrame:
        return self.edges.groupBy("g").agg(F.count(F.lit(1)).alias("n_edges"))

    def degree_sequence(self) -> DataFrame:
        return degrees(self.edges, self.nodes)

    def in_degree_sequence(self) -> DataFrame:
        return directed_degrees(self.edges, self.nodes).select("g", "node", "in_degree")

    def out_degree_sequence(self) -> DataFrame:
        return directed_degrees(self.edges, self.nodes).select("g", "node", "out_degree")

    def adjacency_matrix(self, dense: bool = False, limit: int = 50_000) -> DataFrame:
        """(g, i, j, w), both directions of undirected edges; rows as arrays if dense, up to ``limit`` nodes."""
        one = self.edges.select("g", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("w"))
        long = one if self.directed else one.unionByName(one.select("g", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
        if not dense:
            return long
        if not self.nodes.filter(F.col("n") > limit).isEmpty():
            raise ValidationError("too many nodes for a dense matrix", {"limit": limit})
        rows = long.groupBy("g", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("m"))
        cells = self.nodes.select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).join(rows, ["g", "i"], "left")
        return cells.select("g", "i", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.coalesce(F.try_element_at(F.coalesce("m", F.create_map().cast("map<bigint,double>")), k), F.lit(0.0))).alias("row"))

    def summary(self) -> DataFrame:
        """Features, with irreversibility of directed graphs and triangles of undirected ones."""
        out = features(self.edges, self.nodes)
        return out.join(irreversibility(self.edges, self.nodes), "g") if self.directed else out.join(self.triangle_counts(), "g")

    def triangle_counts(self) -> DataFrame:
        found = triangles(self.edges).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
        return self.nodes.join(found, "g", "left").select("g", F.coalesce("c", F.lit(0)).alias("triangles"))
