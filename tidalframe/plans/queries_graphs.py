"""Queries over distances, series graphs and transfer entropy."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frame
from ..operators import causal, distances, graph
from .catalog import TYPES, USERS, query
from .queries_series import r

ID, POS, VALUE = frame.ID, frame.POS, frame.VALUE
PAIRS = f"{TYPES}, p AS (SELECT a.series_id AS i, b.series_id AS j, a.t, a.value AS x, b.value AS y FROM e a JOIN e b ON a.t = b.t AND a.series_id < b.series_id)"


def typed(spark, d):
    e = frame.events_by_type_day(spark, d)
    return e, distances.all_pairs(e)


@query(f"WITH {PAIRS} SELECT i, j, {r('sqrt(sum((x - y) * (x - y)))', 'euclidean')}, {r('sum(abs(x - y))', 'manhattan')}, {r('sqrt(2 * (1 - corr(x, y)))', 'pearson')}, {r('sqrt(2 * (1 - abs(corr(x, y))))', 'absolute')} FROM p GROUP BY 1, 2")
def series_distances(spark, d):
    e, pairs = typed(spark, d)
    out = distances.euclidean(e, pairs).withColumnRenamed("distance", "euclidean")
    for name, made in (("manhattan", distances.manhattan(e, pairs)), ("pearson", distances.correlation(e, pairs)), ("absolute", distances.correlation(e, pairs, absolute=True))):
        out = out.join(made.withColumnRenamed("distance", name), ["i", "j"])
    return out


@query(f"WITH {TYPES}, k AS (SELECT series_id, t, rank() OVER (PARTITION BY series_id ORDER BY value) + (count(*) OVER (PARTITION BY series_id, value) - 1) / 2.0 AS v FROM e) SELECT a.series_id AS i, b.series_id AS j, {r('sqrt(2 * (1 - corr(a.v, b.v)))', 'distance')} FROM k a JOIN k b ON a.t = b.t AND a.series_id < b.series_id GROUP BY 1, 2")
def spearman_distance(spark, d):
    e, pairs = typed(spark, d)
    return distances.correlation(e, pairs, "spearman")


@query(f"WITH {TYPES}, z AS (SELECT series_id, t, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS v, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY series_id)), c AS (SELECT a.series_id AS i, b.series_id AS j, b.t - a.t AS k, sum(a.v * b.v) / any_value(a.n) AS c FROM z a JOIN z b ON a.series_id < b.series_id AND abs(b.t - a.t) <= 10 GROUP BY 1, 2, 3) SELECT i, j, {r('sqrt(2 * (1 - max(abs(c))))', 'distance')} FROM c GROUP BY 1, 2")
def cross_correlation_distance(spark, d):
    e, pairs = typed(spark, d)
    return distances.cross_correlation(e, pairs)


@query(f"""WITH RECURSIVE {TYPES}, a AS (SELECT series_id, list(value ORDER BY t) AS v FROM e GROUP BY 1), p AS (SELECT x.series_id AS i, y.series_id AS j, x.v AS x, y.v AS y FROM a x JOIN a y ON x.series_id < y.series_id),
dp AS (SELECT i, j, x, y, 1 AS k, list_transform(range(1, len(y) + 2), lambda c: CASE WHEN c = 1 THEN 0.0 ELSE 1e300 END) AS line FROM p
UNION ALL SELECT i, j, x, y, k + 1, list_reduce(range(1, len(y) + 1).list_transform(lambda c: [CAST(c AS DOUBLE)]), lambda done, c: list_append(done, pow(x[k] - y[len(done)], 2) + least(done[len(done)], line[len(done)], line[len(done) + 1])), [CAST(1e300 AS DOUBLE)]) FROM dp WHERE k <= len(x))
SELECT i, j, round(sqrt(line[len(line)]), 6) AS distance FROM dp WHERE k = len(x) + 1""")
def dtw_distance(spark, d):
    e, pairs = typed(spark, d)
    return distances.dtw(e, pairs)


def _visible(view: str, weight: str, horizontal: bool = False) -> str:
    test = "max(b.value) OVER w < least(a.value, b.value)" if horizontal else "(b.value - a.value) / (b.t - a.t) > max((b.value - a.value) / (b.t - a.t)) OVER w"
    return f"{view}, v AS (SELECT a.series_id AS g, a.t AS src, b.t AS dst, {weight} AS weight, b.t = a.t + 1 OR {test} AS ok FROM e a JOIN e b ON a.series_id = b.series_id AND a.t < b.t WINDOW w AS (PARTITION BY a.series_id, a.t ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), ed AS (SELECT g, src, dst, weight FROM v WHERE ok)"


@query(f"WITH {_visible(USERS, 'abs(b.value - a.value)')} SELECT g, count(*) AS edges, {r('sum(weight)', 'weight')} FROM ed GROUP BY 1")
def visibility_difference(spark, d):
    return graph.visibility(frame.events_by_user(spark, d), "difference").groupBy("g").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


@query(f"WITH {_visible(TYPES, 'sqrt(pow(b.t - a.t, 2) + pow(b.value - a.value, 2))')} SELECT g, src, dst, {r('weight', 'weight')} FROM ed")
def visibility_length(spark, d):
    return graph.visibility(frame.events_by_type_day(spark, d), "length")


@query(f"WITH {_visible(USERS, '1', True)} SELECT g, count(*) AS edges FROM ed GROUP BY 1")
def visibility_horizontal(spark, d):
    return graph.visibility(frame.events_by_user(spark, d), horizontal=True).groupBy("g").agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH {_visible(USERS, '1')} SELECT g, count(*) AS edges FROM ed WHERE dst - src <= 10 GROUP BY 1")
def visibility_limited(spark, d):
    return graph.visibility(frame.events_by_user(spark, d), limit=10).groupBy("g").agg(F.count(F.lit(1)).alias("edges"))


_DEGREES = "nd AS (SELECT series_id AS g, t AS node FROM e), bo AS (SELECT g, src AS node, dst AS other FROM ed UNION ALL SELECT g, dst, src FROM ed), dg AS (SELECT nd.g, nd.node, count(bo.other) AS k FROM nd LEFT JOIN bo ON bo.g = nd.g AND bo.node = nd.node GROUP BY 1, 2)"


@query(f"WITH {_visible(USERS, '1')}, {_DEGREES} SELECT g, count(*) AS n_nodes, CAST(sum(k) / 2 AS BIGINT) AS n_edges, {r('avg(k)', 'avg_degree')}, {r('stddev_pop(k)', 'std_degree')}, min(k) AS min_degree, max(k) AS max_degree, {r('sum(k) / (count(*) * (count(*) - 1))', 'density')} FROM dg GROUP BY 1")
def graph_features(spark, d):
    e = frame.events_by_user(spark, d)
    return graph.features(graph.visibility(e), graph.nodes_of(e))


@query(f"WITH {_visible(TYPES, '1')}, {_DEGREES}, tr AS (SELECT x.g, x.src AS a, x.dst AS b, y.dst AS c FROM ed x JOIN ed y ON y.g = x.g AND y.src = x.dst JOIN ed z ON z.g = x.g AND z.src = x.src AND z.dst = y.dst), co AS (SELECT g, unnest([a, b, c]) AS node FROM tr), tc AS (SELECT dg.g, dg.node, any_value(k) AS k, count(co.node) AS tri FROM dg LEFT JOIN co ON co.g = dg.g AND co.node = dg.node GROUP BY 1, 2) SELECT g, {r('avg(CASE WHEN k > 1 THEN 2.0 * tri / (k * (k - 1)) ELSE 0 END)', 'average')}, {r('sum(tri) / sum(k * (k - 1) / 2.0)', 'transitivity')}, {r('stddev_pop(CASE WHEN k > 1 THEN 2.0 * tri / (k * (k - 1)) ELSE 0 END)', 'std')} FROM tc GROUP BY 1")
def clustering(spark, d):
    e = frame.events_by_type_day(spark, d)
    return graph.clustering(graph.visibility(e), graph.nodes_of(e))


@query(f"WITH {_visible(TYPES, '1')}, {_DEGREES} SELECT bo.g, {r('corr(x.k, y.k)', 'assortativity')} FROM bo JOIN dg x ON x.g = bo.g AND x.node = bo.node JOIN dg y ON y.g = bo.g AND y.node = bo.other GROUP BY 1")
def assortativity(spark, d):
    e = frame.events_by_type_day(spark, d)
    return graph.assortativity(graph.visibility(e), graph.nodes_of(e))


@query(f"WITH {_visible(TYPES, '1')}, nd AS (SELECT series_id AS g, t AS p FROM e) SELECT a.g, concat(CAST(x.src IS NOT NULL AS INT), CAST(y.src IS NOT NULL AS INT), CAST(z.src IS NOT NULL AS INT)) AS code, count(*) AS n FROM nd a JOIN nd b ON a.g = b.g AND a.p < b.p JOIN nd c ON c.g = b.g AND b.p < c.p LEFT JOIN ed x ON x.g = a.g AND x.src = a.p AND x.dst = b.p LEFT JOIN ed y ON y.g = a.g AND y.src = a.p AND y.dst = c.p LEFT JOIN ed z ON z.g = a.g AND z.src = b.p AND z.dst = c.p GROUP BY 1, 2")
def motifs_3(spark, d):
    e = frame.events_by_type_day(spark, d)
    return graph.motifs3(graph.visibility(e), graph.nodes_of(e))


_STATES = f"{TYPES}, s AS (SELECT series_id AS g, t AS p, value AS x1, lead(value) OVER (PARTITION BY series_id ORDER BY t) AS x2 FROM e), q AS (SELECT a.g, a.p AS src, b.p AS dst, sqrt(pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)) AS d FROM s a JOIN s b ON a.g = b.g AND a.p < b.p WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL)"


@query(f"WITH {_STATES}, l AS (SELECT g, quantile_cont(d, 0.1) AS eps FROM (SELECT g, d FROM q WHERE d > 0 UNION ALL SELECT g, d FROM q WHERE d > 0) GROUP BY 1) SELECT q.g, src, dst, {r('d', 'weight')} FROM q JOIN l ON l.g = q.g WHERE d <= eps")
def recurrence_epsilon(spark, d):
    return graph.recurrence(frame.events_by_type_day(spark, d), dimension=2)


@query(f"WITH {_STATES}, u AS (SELECT g, src AS p, d FROM q UNION ALL SELECT g, dst, d FROM q), k AS (SELECT g, p, d AS lim FROM (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY d) AS n FROM u) WHERE n = 3) SELECT q.g, src, dst, {r('d', 'weight')} FROM q JOIN k a ON a.g = q.g AND a.p = src JOIN k b ON b.g = q.g AND b.p = dst WHERE d <= least(a.lim, b.lim)")
def recurrence_knn(spark, d):
    return graph.recurrence(frame.events_by_type_day(spark, d), dimension=2, k=3)


@query(f"WITH {USERS}, m AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1), b AS (SELECT e.series_id AS g, t, CASE WHEN hi = lo THEN 0 ELSE least(4, floor((value - lo) / ((hi - lo) / 5))) END AS raw FROM e JOIN m USING (series_id)), s AS (SELECT g, t, dense_rank() OVER (PARTITION BY g ORDER BY raw) - 1 AS s FROM b), w AS (SELECT g, s AS src, lead(s) OVER (PARTITION BY g ORDER BY t) AS dst FROM s) SELECT g, CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM w WHERE dst IS NOT NULL GROUP BY 1, 2, 3")
def transition_network(spark, d):
    return graph.transitions(frame.events_by_user(spark, d), 5)


_VECTORS = "q AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@query(f"WITH {_VECTORS}, k AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM q) WHERE n <= 5), u AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, count(*) AS c FROM k GROUP BY 1, 2) SELECT src, dst, c / 2.0 AS weight, c = 2 AS mutual FROM u")
def knn_graph(spark, d):
    both = graph.net_knn(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", 5)
    return both.withColumn("mutual", F.col("weight") == 1.0)


@query(f"WITH {_VECTORS}, h AS (SELECT * FROM q WHERE i < j), l AS (SELECT quantile_cont(d, 0.01) AS eps FROM h) SELECT i AS src, j AS dst, {r('d', 'weight')} FROM h, l WHERE d <= eps")
def enn_graph(spark, d):
    return graph.net_enn(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", percentile=1.0, weighted=True)


_BINS = f"{TYPES}, m AS (SELECT series_id, min(value) AS lo, max(value) + 1e-10 AS hi FROM e GROUP BY 1), b AS (SELECT e.series_id, t, least(3, floor((value - lo) / ((hi - lo) / 4))) AS b, lag(least(3, floor((value - lo) / ((hi - lo) / 4)))) OVER (PARTITION BY e.series_id ORDER BY t) AS p FROM e JOIN m USING (series_id)), k AS (SELECT x.series_id AS x, y.series_id AS y, y.b AS yt, y.p AS yp, x.p AS xp FROM b x JOIN b y ON x.t = y.t AND x.series_id <> y.series_id WHERE x.p IS NOT NULL)"


def _h(name: str, keys: str, table: str = "k", by: str = "x, y") -> str:
    return f"{name} AS (SELECT {by}, sum(-c / n * log2(c / n)) AS h FROM (SELECT {by}, count(*) AS c, sum(count(*)) OVER (PARTITION BY {by}) AS n FROM {table} GROUP BY {by}, {keys}) GROUP BY {by})"


@query(f"WITH {_BINS}, {_h('h0', 'yt, yp')}, {_h('h1', 'yp')}, {_h('h2', 'yt, yp, xp')}, {_h('h3', 'yp, xp')} SELECT x, y, round(greatest(0, h0.h - h1.h - h2.h + h3.h), 6) AS te FROM h0 JOIN h1 USING (x, y) JOIN h2 USING (x, y) JOIN h3 USING (x, y) WHERE h0.h - h1.h - h2.h + h3.h > 0")
def transfer_entropy(spark, d):
    return causal.transfer_entropy_network(frame.events_by_type_day(spark, d), 1, 4)


_THREE = f"{_BINS}, c3 AS (SELECT k.x, k.y, z.series_id AS z, k.yt, k.yp, k.xp, z.p AS zp FROM (SELECT x.series_id AS x, y.series_id AS y, y.t, y.b AS yt, y.p AS yp, x.p AS xp FROM b x JOIN b y ON x.t = y.t AND x.series_id = 'view' AND y.series_id = 'click' WHERE x.p IS NOT NULL) k JOIN b z ON z.t = k.t AND z.series_id NOT IN ('view', 'click'))"


@query(f"WITH {_THREE}, {_h('h0', 'yt, yp, zp', 'c3', 'x, y, z')}, {_h('h1', 'yp, zp', 'c3', 'x, y, z')}, {_h('h2', 'yt, yp, xp, zp', 'c3', 'x, y, z')}, {_h('h3', 'yp, xp, zp', 'c3', 'x, y, z')} SELECT x, y, z, round(greatest(0, h0.h - h1.h - h2.h + h3.h), 6) AS te FROM h0 JOIN h1 USING (x, y, z) JOIN h2 USING (x, y, z) JOIN h3 USING (x, y, z)")
def conditional_transfer_entropy(spark, d):
    e = frame.events_by_type_day(spark, d)
    others = e.select(F.col(ID).alias("z")).distinct().filter(~F.col("z").isin("view", "click"))
    return causal.conditional_transfer_entropy(e, others.select(F.lit("view").alias("x"), F.lit("click").alias("y"), "z"), 1, 4)


@query(f"WITH {TYPES}, w AS (SELECT series_id, CAST(t // 5 AS BIGINT) AS win, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l, t FROM e), f AS (SELECT concat(series_id, '#', win) AS series_id, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS t FROM w WHERE t % 5 = 0 AND len(l) = 10), v AS (SELECT a.series_id AS g, b.t = a.t + 1 OR (b.value - a.value) / (b.t - a.t) > max((b.value - a.value) / (b.t - a.t)) OVER (PARTITION BY a.series_id, a.t ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ok FROM f a JOIN f b ON a.series_id = b.series_id AND a.t < b.t) SELECT g, count(*) AS n_edges FROM v WHERE ok GROUP BY 1")
def window_graphs(spark, d):
    out = graph.build_windows(frame.events_by_type_day(spark, d), 10, 5)
    return out.select(F.concat_ws("#", ID, "window").alias("g"), "n_edges")


_FEATURES = f"count(*) AS n_nodes, CAST(sum(k) / 2 AS BIGINT) AS n_edges, {r('avg(k)', 'avg_degree')}, {r('stddev_pop(k)', 'std_degree')}, min(k) AS min_degree, max(k) AS max_degree, {r('CASE WHEN count(*) > 1 THEN sum(k) / nullif(count(*) * (count(*) - 1), 0) ELSE 0 END', 'density')}"
_COARSE = f"WITH {TYPES.replace('e AS (', 'f AS (', 1)}, s AS (SELECT series_id, unnest([1, 2, 3]) AS scale, t, value FROM f), c AS (SELECT series_id, scale, CAST(t // scale AS BIGINT) AS t, avg(value) AS value, count(*) AS m FROM s GROUP BY 1, 2, 3), e AS (SELECT concat(series_id, '@', scale) AS series_id, t, value FROM c WHERE m = scale AND (SELECT count(*) FROM c o WHERE o.series_id = c.series_id AND o.scale = c.scale AND o.m = o.scale) >= 10)"


@query(f"{_visible(_COARSE, '1')}, {_DEGREES} SELECT split_part(g, '@', 1) AS series_id, CAST(split_part(g, '@', 2) AS INT) AS scale, {_FEATURES} FROM dg GROUP BY g")
def multiscale_graphs(spark, d):
    from ..estimators import MultiscaleGraphs

    return MultiscaleGraphs(scales=[1, 2, 3]).transform(frame.events_by_type_day(spark, d))


@query(f"WITH {USERS}, m AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1), b AS (SELECT e.series_id AS g, t, CASE WHEN hi = lo THEN 0 ELSE least(4, floor((value - lo) / ((hi - lo) / 5))) END AS raw FROM e JOIN m USING (series_id)), s AS (SELECT g, t, dense_rank() OVER (PARTITION BY g ORDER BY raw) - 1 AS s FROM b), w AS (SELECT g, s AS src, lead(s) OVER (PARTITION BY g ORDER BY t) AS dst FROM s), ed AS (SELECT DISTINCT g, src, dst FROM w WHERE dst IS NOT NULL), nd AS (SELECT DISTINCT g, s AS node FROM s), bo AS (SELECT g, src AS node, dst AS other FROM ed UNION ALL SELECT g, dst, src FROM ed), dg AS (SELECT nd.g, nd.node, count(bo.other) AS k FROM nd LEFT JOIN bo ON bo.g = nd.g AND bo.node = nd.node GROUP BY 1, 2) SELECT g, {_FEATURES} FROM dg GROUP BY g")
def transition_features(spark, d):
    from ..estimators import TransitionNetworkFeaturizer

    y = frame.events_by_user(spark, d)
    return TransitionNetworkFeaturizer(5, include_degrees=False).fit(y).transform(y)


@query(f"WITH {_STATES}, l AS (SELECT g, quantile_cont(d, 0.1) AS eps FROM (SELECT g, d FROM q WHERE d > 0 UNION ALL SELECT g, d FROM q WHERE d > 0) GROUP BY 1), ed AS (SELECT q.g, src, dst FROM q JOIN l ON l.g = q.g WHERE d <= eps), {_DEGREES} SELECT g, {_FEATURES} FROM dg GROUP BY g")
def recurrence_features(spark, d):
    from ..estimators import RecurrenceNetworkFeaturizer

    y = frame.events_by_type_day(spark, d)
    return RecurrenceNetworkFeaturizer(embedding_dimension=2, include_degrees=False).fit(y).transform(y)
