"""Operators over long series and large graphs: equal results to brute force, and work that follows the results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidalframe.operators import graph, neighbours, sight


def brute_sight(y: np.ndarray, horizontal: bool) -> set[tuple[int, int]]:
    out = set()
    for i in np.flatnonzero(~np.isnan(y)):
        top = -np.inf
        for j in range(i + 1, len(y)):
            if np.isnan(y[j]):
                continue
            met = y[j] if horizontal else (y[j] - y[i]) / (j - i)
            if top == -np.inf or top < (min(y[i], y[j]) if horizontal else met):
                out.add((int(i), j))
            top = max(top, met)
    return out


@pytest.mark.parametrize("horizontal", [False, True])
def test_sight_across_blocks(make, monkeypatch, horizontal):
    """Blocks of 7 rows in a tree of three levels; trends, ties, gaps, curves and short series."""
    monkeypatch.setattr(sight, "BLOCK", 7)
    monkeypatch.setattr(sight, "FANOUT", 3)
    random, n = np.random.default_rng(0), 150
    at = np.arange(n)
    cases = {"noise": random.standard_normal(n), "ties": random.integers(0, 4, n).astype(float), "line": at * 3.0, "trend": at * 0.5 + random.standard_normal(n), "cup": (at - 70.0) ** 2, "hill": -((at - 70.0) ** 2), "flat": np.zeros(n), "walk": random.standard_normal(n).cumsum(), "short": random.standard_normal(5), "one": np.ones(1)}
    cases["gaps"] = np.where(random.random(n) < 0.3, np.nan, random.standard_normal(n))
    panel = make({k: [None if np.isnan(x) else x for x in v] for k, v in cases.items()})
    got = {k: [] for k in cases}
    for r in graph.visibility(panel, horizontal=horizontal).collect():
        got[r["g"]].append((r["src"], r["dst"]))
    for k, v in cases.items():
        assert len(got[k]) == len(set(got[k])) and set(got[k]) == brute_sight(v, horizontal), k


def test_sight_of_one_long_series(spark):
    """100,000 rows in one series beside a short one: what is looked at beyond blocks follows the edges."""
    n = 100_000
    y = np.random.default_rng(1).standard_normal(n).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "t": np.arange(n), "value": y}))
    df = df.unionByName(spark.createDataFrame([("b", k, float(k % 3)) for k in range(4)], "series_id string, t long, value double"))
    near, far = sight.candidates(df)
    looked_at = far.count()
    edges = graph.visibility(df).toPandas()
    a = edges[edges["g"] == "a"]
    assert looked_at <= 4 * len(a) and sorted(zip(*[edges[edges["g"] == "b"][c] for c in ("src", "dst")], strict=True)) == [(0, 1), (1, 2), (2, 3)]
    for i in (0, 511, 512, 40_000, n - 2):
        slope = (y[i + 1 :] - y[i]) / np.arange(1, n - i)
        top = np.maximum.accumulate(np.append(-np.inf, slope[:-1]))
        assert sorted(a[a["src"] == i]["dst"]) == list(i + 1 + np.flatnonzero(slope > top))
    # A stack gives the horizontal edges of a series in one pass.
    stack, count = [], 0
    for v in y:
        while stack and stack[-1] < v:
            stack.pop()
            count += 1
        count += bool(stack)
        if stack and stack[-1] == v:
            stack.pop()
        stack.append(v)
    assert graph.visibility(df.filter("series_id = 'a'"), horizontal=True).count() == count


def test_neighbours_open_few_boxes(spark):
    """Clusters, a third of all rows one vector, rows without a vector: exact, and few copies of queries."""
    random = np.random.default_rng(4)
    centres = random.normal(size=(30, 6)) * 100
    x = np.vstack([centres[random.integers(0, 30, 2000)] + random.normal(size=(2000, 6)), np.tile(centres[0], (1000, 1))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(-1, None), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    index = neighbours.build(df, "id", "vec", 100)
    asks = neighbours.asked(index, index.rows.selectExpr("id", "v", "1.0D tau"), lambda low, up, _: low <= 3.0)
    assert asks.count() < 0.4 * len(x) * (index.count > 0).sum()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = neighbours.nearest(df, "id", "vec", 3, box_rows=100).toPandas().sort_values(["i", "d", "j"])
    want = np.sort(d, axis=1)[:, :3]
    assert np.allclose(got["d"].to_numpy().reshape(-1, 3), want)
    ties = got[got["i"] == 2999]["j"].tolist()
    assert ties == [2000, 2001, 2002]
    pairs = neighbours.within(df, "id", "vec", 3.0, box_rows=100).toPandas()
    assert len(pairs) == (d <= 3).sum()
    assert neighbours.percentile(df, "id", "vec", 20.0, box_rows=100)[0] == pytest.approx(np.percentile(d[np.triu_indices(len(x), 1)], 20.0))
    assert neighbours.nearest(df.limit(0), "id", "vec", 3).isEmpty() and neighbours.percentile(df.limit(0), "id", "vec", 5.0)[0] is None


def states_of(y: np.ndarray, dimension: int) -> np.ndarray:
    return np.stack([y[k : len(y) - dimension + 1 + k] for k in range(dimension)], axis=1)


@pytest.mark.parametrize(("dimension", "metric"), [(2, "manhattan"), (4, "euclidean")])
def test_recurrence_by_grid(make, dimension, metric):
    """Thresholds, percentiles and neighbours against all pairs; ties, a constant series and a short one."""
    random = np.random.default_rng(5)
    cases = {"noise": random.standard_normal(150), "ties": random.integers(0, 3, 90).astype(float), "flat": np.zeros(12), "far": np.append(random.standard_normal(60), [1e3, -1e3, 2e3]), "short": np.ones(2)}
    panel = make(cases)
    edges = {name: graph.recurrence(panel, dimension=dimension, metric=metric, **how).toPandas() for name, how in {"threshold": {"threshold": 0.5}, "percentile": {}, "mutual": {"k": 3}, "either": {"k": 3, "mode": "either"}}.items()}
    for g, y in cases.items():
        if len(y) < dimension:
            continue
        x = states_of(y, dimension)
        diff = x[:, None] - x[None]
        d = np.abs(diff).sum(2) if metric == "manhattan" else np.sqrt((diff * diff).sum(2))
        upper = np.triu(np.ones_like(d, bool), 1)
        kth = np.array([np.sort(np.delete(row, i))[2] if len(row) > 3 else -1.0 for i, row in enumerate(d)])
        eps = np.percentile(d[d > 0], 10) if (d > 0).any() else -1.0
        want = {"threshold": d <= 0.5, "percentile": d <= eps * (1 + 1e-12), "mutual": (d <= kth[:, None]) & (d <= kth[None]), "either": (d <= kth[:, None]) | (d <= kth[None])}
        for name, near in want.items():
            own = edges[name][edges[name]["g"] == g]
            assert sorted(zip(own["src"], own["dst"], strict=True)) == sorted(zip(*map(lambda v: v.tolist(), np.nonzero(near & upper)), strict=True)), (g, name)


def test_recurrence_looks_at_near_states_only(spark):
    """20,000 rows in one series: pairs that meet follow the pairs that are near, and no join is on the series alone."""
    from pyspark.sql import functions as F

    from tidalframe.operators import grid

    n = 20_000
    y = np.random.default_rng(6).uniform(0, 1, n)
    states = spark.createDataFrame(pd.DataFrame({"g": "a", "p": np.arange(n), "v": y})).select("g", "p", F.array("v").alias("e"))
    near = grid.met(states.withColumn("radius", F.lit(1e-4)), states, "euclidean", 1, True)
    s = np.sort(y)
    assert near.count() == (np.searchsorted(s, s + 1e-4, "right") - np.arange(n) - 1).sum()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "c0" in plan


def test_theil_sen_by_counts(make, monkeypatch):
    """Small blocks, buckets and lists: medians of all slopes of noise, ties, lines, walks, gaps and short series."""
    from tidalframe.operators import slopes, stats

    for name, value in (("SHORT", 20), ("BLOCK_ROWS", 40), ("LISTED", 150), ("SAMPLED", 40)):
        monkeypatch.setattr(slopes, name, value)
    random, n = np.random.default_rng(7), 300
    cases = {"noise": random.standard_normal(n), "ties": random.integers(0, 3, n).astype(float), "line": np.arange(n) * 2.5, "trend": np.arange(n) * 0.1 + random.standard_normal(n), "walk": random.standard_normal(n).cumsum() * 1e4, "flat": np.ones(n), "short": np.array([3.0, 1.0, 7.0])}
    cases["gaps"] = np.where(random.random(n) < 0.3, np.nan, random.standard_normal(n))
    got = {r["series_id"]: r["slope"] for r in stats.detect_trend(make({k: [None if np.isnan(x) else x for x in v] for k, v in cases.items()}), "theil_sen").collect()}
    for k, y in cases.items():
        t = np.flatnonzero(~np.isnan(y))
        i, j = np.triu_indices(len(t), 1)
        want = np.median((y[t[j]] - y[t[i]]) / (t[j] - t[i]))
        assert got[k] == pytest.approx(want, rel=1e-9, abs=1e-11), k


def test_theil_sen_of_one_long_series(spark):
    """100,000 rows in one series, five billion slopes: the median has half of them on either side."""
    from tidalframe.operators import slopes, stats

    n = 100_000
    y = 0.001 * np.arange(n) + np.random.default_rng(8).standard_normal(n)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "t": np.arange(n), "value": y}))
    slope = stats.detect_trend(df, "theil_sen").first()["slope"]
    at_most = slopes.inversions(y - np.nextafter(slope, 1) * np.arange(n))
    assert abs(at_most - n * (n - 1) // 4) <= 2 and abs(slope - 0.001) < 1e-6
    few = np.random.default_rng(9).integers(0, 5, 60).astype(float)
    assert slopes.inversions(few) == sum(few[j] <= few[i] for i in range(60) for j in range(i + 1, 60))


def test_vector_autoregression_with_gaps(make):
    """Moments are taken where both values exist; a short series and gaps take nothing else away."""
    from tidalframe.operators import moments

    random, n, k = np.random.default_rng(10), 200, 3
    y = np.zeros((n, k))
    for t in range(1, n):
        y[t] = [1, 2, 3] + y[t - 1] @ np.array([[0.5, 0.2, 0], [0, 0.4, 0.3], [0.1, 0, 0.3]]) + random.standard_normal(k)
    y[random.random((n, k)) < 0.1] = np.nan
    y[150:, 2] = np.nan
    y[-1, :2] = [1.5, 2.5]
    got = moments.vector_autoregression(make({f"s{i}": [None if np.isnan(v) else v for v in y[:, i]] for i in range(k)}), 3, difference=False, lag=1).toPandas().sort_values(["h", "series_id"])
    mean = np.nanmean(y, axis=0)
    z = y - mean
    x = np.column_stack([np.ones(n - 1), z[1:], z[:-1]])
    m = np.array([[np.nanmean(x[:, a] * x[:, b]) for b in range(7)] for a in range(7)])
    at = [0, 4, 5, 6]
    coef = np.linalg.solve(m[np.ix_(at, at)], m[np.ix_(at, [1, 2, 3])])
    state, made = np.nan_to_num(z[-1]), []
    for _ in range(3):
        state = np.append(1.0, state) @ coef
        made.append(state + mean)
    assert np.allclose(got["y_pred"].to_numpy().reshape(3, k), made)
    spread = np.sqrt(np.diag(m[1:4, 1:4] - coef.T @ m[np.ix_(at, [1, 2, 3])]))
    assert np.allclose((got["upper"] - got["y_pred"]).to_numpy().reshape(3, k), 1.6448536 * spread)


def test_unit_roots_by_moments(make):
    """Dickey-Fuller by regression of each series, nulls left out; too short a series is said to be so."""
    from tidalframe.operators import moments

    random = np.random.default_rng(11)
    cases = {"noise": random.standard_normal(150) + 1e4, "walk": random.standard_normal(150).cumsum(), "short": np.ones(5)}
    rows = {r["series_id"]: r for r in moments.stationarity(make({k: [*v.tolist(), None] for k, v in cases.items()})).collect()}
    assert rows["short"]["conclusion"] == "insufficient_data" and rows["noise"]["conclusion"] == "stationary" and rows["walk"]["adf_p"] > 0.05
    for k in ("noise", "walk"):
        y, best = cases[k] - cases[k].mean(), None
        dy, top = np.diff(y), int(12 * (len(y) / 100) ** 0.25)
        for lag in range(top + 1):
            x = np.column_stack([np.ones(len(dy) - top), y[top:-1], *[dy[top - i : len(dy) - i] for i in range(1, lag + 1)]])
            coef, r = np.linalg.lstsq(x, dy[top:], rcond=None)[0], None
            r = dy[top:] - x @ coef
            aic = len(r) * np.log(r @ r / len(r)) + 2 * x.shape[1]
            if best is None or aic < best[0]:
                best = (aic, coef[1] / np.sqrt(r @ r / (len(r) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]))
        assert rows[k]["adf"] == pytest.approx(best[1], rel=1e-6)


@pytest.mark.parametrize("width", [None, 6])
def test_backtest_by_running_states(make, width):
    """The state at each cutoff equals a fit on the joined training rows, with gaps, for expanding and sliding folds."""
    from tidalframe.operators import forecast
    from tidalframe.plans import backtest as bt

    random = np.random.default_rng(12)
    panel = make({"a": [None if random.random() < 0.25 else float(v) for v in random.standard_normal(70) * 5], "b": [1.0, None, None, None, None, None, None, None, 2.0, 3.0], "short": [1.0]})
    split = bt.ExpandingWindowSplit(4, 3, 2) if width is None else bt.SlidingWindowSplit(width, 2, 3)
    models = [forecast.naive(), forecast.moving_average(4), forecast.exponential_average(0.3), forecast.exponential_average(0.99), forecast.exponential_average(1.0), forecast.weighted_average([0.1, 0.2, 0.3, 0.4]), forecast.linear_trend(False)]
    for m in models:
        key = ["series_id", "fold_id", "h"]
        got, want = (f(panel, m, split).toPandas().sort_values(key).reset_index(drop=True) for f in (bt.backtest, bt._backtest_joined))
        assert got[[*key, "cutoff"]].equals(want[[*key, "cutoff"]].astype(got[[*key, "cutoff"]].dtypes)), m.name
        assert np.allclose(got["y_pred"].astype(float), want["y_pred"].astype(float), equal_nan=True, atol=1e-9), m.name
        assert np.allclose(got["y_true"].astype(float), want["y_true"].astype(float), equal_nan=True), m.name


def test_backtest_copies_no_rows(spark):
    """A long series: rows that the plan handles follow its length, not folds times rows; the average of 50,000 rows is exact."""
    from tidalframe.operators import forecast
    from tidalframe.plans import backtest as bt

    n = 50_000
    y = np.random.default_rng(13).standard_normal(n)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "t": np.arange(n), "value": y}))
    made = bt.backtest(df, forecast.exponential_average(0.02), bt.ExpandingWindowSplit(10, 1, 1))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    want, rows = y[0], made.toPandas().sort_values("fold_id")["y_pred"].to_numpy()
    fold = {}
    for t in range(1, n):
        want = 0.98 * want + 0.02 * y[t]
        fold[t] = want
    assert len(rows) == n - 10 and np.allclose(rows, [fold[t] for t in range(9, n - 1)], atol=1e-12)


def random_graphs(spark, seed: int):
    """Edges and nodes of random graphs, sparse to full, with loops, double and reversed edges and lone nodes; and neighbour sets."""
    random, edges, nodes, sets = np.random.default_rng(seed), [], [], {}
    for k, (n, p) in enumerate([(14, 0.1), (13, 0.3), (12, 0.6), (8, 1.0), (1, 0.0), (6, 0.0), (10, 0.25)]):
        own = [(int(i), int(j)) for i in range(n) for j in range(i + 1, n) if random.random() < p]
        edges += [(f"g{k}", i, j, 1.0) for i, j in own] + [(f"g{k}", i, j, 1.0) for i, j in own[:2]]
        nodes.append((f"g{k}", n))
        sets[f"g{k}"] = (n, {frozenset(x) for x in own})
    return spark.createDataFrame(edges, "g string, src long, dst long, weight double"), spark.createDataFrame(nodes, "g string, n long"), sets


def test_small_subgraphs_by_counting(spark):
    from collections import Counter
    from itertools import combinations

    from tidalframe.operators import networks

    edges, nodes, sets = random_graphs(spark, 14)
    three, four, triples = Counter(), Counter(), Counter()
    for g, (n, e) in sets.items():
        for i, j, k in combinations(range(n), 3):
            code = "".join(str(int(frozenset(x) in e)) for x in ((i, j), (i, k), (j, k)))
            three[g, code] += 1
            triples[g] += code == "111"
        for q in combinations(range(n), 4):
            d = sorted(sum(frozenset((a, b)) in e for b in q if b != a) for a in q)
            m = sum(d) // 2
            four[g, {6: "clique", 5: "diamond", 4: "square" if d[3] == 2 else "triangle_tail", 3: "triangle_isolated" if d[0] == 0 else "star" if d[3] == 3 else "chain"}.get(m, "other")] += 1
    assert {(r["g"], r["code"]): r["n"] for r in networks.motifs3(edges, nodes).collect()} == dict(three)
    assert {(r["g"], r["motif"]): r["n"] for r in networks.motifs4(edges, nodes).collect()} == dict(four)
    assert {r["g"]: r["count"] for r in graph.triangles(edges).groupBy("g").count().collect()} == {g: c for g, c in triples.items() if c}


def test_subgraphs_and_paths_around_a_hub(spark):
    """30,000 leaves at one node and a triangle of leaves: the hub's wedges are not listed; stated sources give its paths."""
    from pyspark.sql import functions as F

    from tidalframe.operators import networks

    n = 30_001
    edges = spark.range(1, n).select(F.lit("g").alias("g"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    edges = edges.unionByName(spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 1, 3)], "g string, src long, dst long"))
    nodes = spark.createDataFrame([("g", n)], "g string, n long")
    got = {r["motif"]: r["n"] for r in networks.motifs4(edges, nodes).collect()}
    rest = n - 4
    assert got["clique"] == 1 and got["triangle_tail"] == 3 * rest and got["triangle_isolated"] == rest
    assert got["star"] == (n - 1) * (n - 2) * (n - 3) // 6 - 3 * rest - 1 and "square" not in got and "chain" not in got
    paths = networks.path_lengths(edges, nodes, spark.createDataFrame([("g", 0), ("g", 5)], "g string, node long")).first()
    assert paths["diameter"] == 2 and paths["radius"] == 1 and paths["avg_path"] == pytest.approx(((n - 1) + (1 + 2 * (n - 2))) / (2 * (n - 1)))


def test_path_lengths_by_frontiers(spark):
    from tidalframe.operators import networks

    edges, nodes, sets = random_graphs(spark, 15)
    got = {r["g"]: r for r in networks.path_lengths(edges, nodes).collect()}
    for g, (n, e) in sets.items():
        hops = {}
        for s in range(n):
            seen, queue = {s: 0}, [s]
            for u in queue:
                for v in range(n):
                    if v not in seen and frozenset((u, v)) in e:
                        seen[v] = seen[u] + 1
                        queue.append(v)
            hops[s] = seen
        best = max(range(n), key=lambda s: (len(hops[s]), -min(hops[s])))
        if len(hops[best]) < 2:
            assert got[g]["avg_path"] is None and got[g]["diameter"] is None
            continue
        far = [max(hops[s].values()) for s in hops[best]]
        total = sum(sum(hops[s].values()) for s in hops[best])
        assert got[g]["avg_path"] == pytest.approx(total / (len(far) * (len(far) - 1)))
        assert (got[g]["diameter"], got[g]["radius"]) == (max(far), min(far)) and got[g]["eccentricity_std"] == pytest.approx(np.std(far))


def test_communities_by_moves(spark):
    """Planted groups are found, modularity is that of the definition, lone nodes stay alone and reruns agree."""
    from tidalframe.operators import communities

    random, edges, sets = np.random.default_rng(16), [], {}
    planted = [k // 12 for k in range(48)]
    own = [(i, j) for i in range(48) for j in range(i + 1, 48) if random.random() < (0.7 if planted[i] == planted[j] else 0.03)]
    ring = [(6 * c + i, 6 * c + j) for c in range(8) for i in range(6) for j in range(i + 1, 6)] + [(6 * c, (6 * c + 9) % 48) for c in range(8)]
    for g, found in (("planted", own), ("ring", ring)):
        edges += [(g, i, j) for i, j in found]
        sets[g] = {frozenset(x) for x in found}
    nodes = spark.createDataFrame([("planted", 50), ("ring", 48), ("none", 3)], "g string, n long")
    df = spark.createDataFrame(edges, "g string, src long, dst long")

    def quality(e, label):
        m = len(e)
        degree = {c: sum(label[v] == c for x in e for v in x) for c in set(label.values())}
        return sum(sum(all(label[v] == c for v in x) for x in e) / m - (degree[c] / (2 * m)) ** 2 for c in degree)

    for method in ("louvain", "label_propagation"):
        labels = communities.communities(df, nodes, method).cache()
        rows = {(r["g"], r["node"]): r["label"] for r in labels.collect()}
        assert len(rows) == 101 and all(rows["none", k] == k for k in range(3)) and rows["planted", 48] == 48
        got = {r["g"]: r for r in communities.modularity_of(df, labels).collect()}
        for g, e in sets.items():
            assert got[g]["modularity"] == pytest.approx(quality(e, {k: v for (h, k), v in rows.items() if h == g}))
        assert got["none"]["modularity"] == 0 and got["none"]["n_communities"] == 3
        if method == "louvain":
            assert got["planted"]["modularity"] >= quality(sets["planted"], dict(enumerate(planted))) - 1e-9
            assert got["ring"]["modularity"] >= quality(sets["ring"], {k: k // 6 for k in range(48)}) - 0.02
            assert {(r["g"], r["node"]): r["label"] for r in communities.communities(df, nodes).collect()} == rows


def test_centralities_by_joins(spark):
    """Against direct computations on small graphs: ranks, cores, betweenness and closeness, with lone nodes; roles rise with degree."""
    from tidalframe.operators import roles

    edges, nodes, sets = random_graphs(spark, 17)
    table = roles.roles(edges, nodes, 3).toPandas()
    for g, (n, e) in sets.items():
        own = table[table["g"] == g].sort_values("node")
        assert list(own["node"]) == list(range(n))
        a = np.array([[float(frozenset((i, j)) in e) for j in range(n)] for i in range(n)])
        degree = a.sum(axis=1)
        flow = np.divide(a, degree[:, None], out=np.full((n, n), 1 / n), where=degree[:, None] > 0)
        rank, vector = np.full(n, 1 / n), np.full(n, 1 / np.sqrt(n))
        for _ in range(100):
            rank, vector = 0.15 / n + 0.85 * rank @ flow, vector + a @ vector
            vector /= np.linalg.norm(vector)
        core, left = np.zeros(n), set(range(n))
        for level in range(1, n):
            while low := {v for v in left if sum(a[v, w] for w in left) < level}:
                left -= low
            core[list(left)] = level
        hops = np.where(a > 0, 1.0, np.inf)
        np.fill_diagonal(hops, 0)
        for k in range(n):
            hops = np.minimum(hops, hops[:, [k]] + hops[[k]])
        paths = np.eye(n)
        for d in range(1, n):
            paths = np.where(hops == d, np.where(hops == d - 1, paths, 0) @ a, paths)
        between = [sum(paths[s, v] * paths[v, t] / paths[s, t] for s in range(n) for t in range(s) if v not in (s, t) and np.isfinite(hops[s, t]) and hops[s, v] + hops[v, t] == hops[s, t]) for v in range(n)]
        met = np.isfinite(hops)
        close = [(met[v].sum() - 1) ** 2 / (hops[v][met[v]].sum() * (n - 1)) if met[v].sum() > 1 else 0.0 for v in range(n)]
        for name, want in (("degree", degree), ("pagerank", rank), ("eigenvector", vector), ("core", core), ("betweenness", between), ("closeness", close)):
            assert np.allclose(own[name], want, atol=1e-6), (g, name)
    means = table.groupby("role")["degree"].mean()
    assert set(table["role"]) == {0, 1, 2} and means[0] < means[2]


def test_ranks_take_few_rounds(spark, monkeypatch):
    """A hundred steps are ten rounds (25 before), and a step has no window over its graph."""
    from tidalframe.operators import networks, roles

    edges, nodes, _ = random_graphs(spark, 5)
    asked, plain = [], roles.stored
    monkeypatch.setattr(roles, "stored", lambda df: asked.append(df._jdf.queryExecution().optimizedPlan().toString().count("Window ")) or plain(df))
    roles.ranks(plain(networks.both_ends(networks.simple(edges))), plain(roles._all_nodes(nodes)))
    assert len(asked) <= 12 and max(asked) == 1


def test_sight_sends_bounded_frames(monkeypatch):
    """A task holds some edges at a time, not those of a whole batch of blocks."""
    import numpy as np
    import pandas as pd

    from tidalframe.operators import sight

    monkeypatch.setattr(sight, "HELD", 500)
    rng = np.random.default_rng(4)
    blocks = pd.DataFrame([{"g": str(k), "t": np.arange(60), "y": rng.normal(size=60), "tilt": 0.0, "scale": 0.0, "ahead": None} for k in range(100)])
    frames = list(sight._near(False)(iter([blocks])))
    edges = [sum(len(x) for x in f["src"]) for f in frames]
    assert sum(len(f) for f in frames) == 100 and len(frames) > 10 and max(edges) < 1000


def test_nearest_looks_at_distances_once(monkeypatch):
    """A box is one product of matrices, and only pairs under the bound are taken exactly."""
    asked = []
    plain = neighbours.exact
    monkeypatch.setattr(neighbours, "exact", lambda a, b: asked.append(len(a)) or plain(a, b))
    monkeypatch.setattr(neighbours, "distances", None)
    rng = np.random.default_rng(9)
    v, w = rng.normal(size=(40, 6)), np.concatenate([rng.normal(size=(300, 6)), np.zeros((2, 6))])
    v[0] = 0.0
    ids, other = np.arange(40), np.arange(20, 322)
    want = np.sqrt(((v[:, None] - w[None]) ** 2).sum(2))
    want[ids[:, None] == other[None]] = np.inf
    for tau in (np.full(40, np.inf), np.full(40, 1.5)):
        got = neighbours._nearest(3)(ids, v, tau, other, w)
        for i in ids:
            order = [k for k in np.lexsort((other, want[i])) if want[i, k] <= tau[i]][:3]
            assert got[got["i"] == i]["j"].tolist() == other[order].tolist()
    assert sum(asked) < 40 * 302


def noise(spark, n: int, dimension: int, kind: str = "float"):
    """Vectors whose distances tell nothing, thirty of them equal, and all distances."""
    x = np.random.default_rng(12).normal(size=(n, dimension)).astype("f4").astype(float) + 3.0
    x[40:70] = x[40]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"id long, vec array<{kind}>")
    x = np.array(df.orderBy("id").toPandas()["vec"].tolist(), dtype=float)
    return df, np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def count_copies(monkeypatch) -> list[int]:
    """How many copies of queries are stored, call by call."""
    copies, plain = [], neighbours.asked

    def asked(*args):
        out = plain(*args)
        copies.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "asked", asked)
    return copies


@pytest.mark.parametrize("q", [1.0, 60.0])
def test_pairs_within_copy_no_queries(spark, monkeypatch, q):
    """The graph within a percentile of vectors that no bound parts: boxes meet, nothing is stored for pairs of boxes, and a pair is looked at once."""
    df, d = noise(spark, 500, 24, "float" if q == 1.0 else "double")
    copies = count_copies(monkeypatch)
    epsilon, index = neighbours.percentile(df, "id", "vec", q, box_rows=40)
    assert (index.count > 0).sum() > 10
    upper = d[np.triu_indices(len(d), 1)]
    assert epsilon == pytest.approx(np.percentile(upper, q), rel=1e-12)
    got = neighbours.pairs_within(index, epsilon).toPandas()
    assert sorted(zip(got["i"], got["j"], strict=True)) == sorted((i, j) for i in range(500) for j in range(i + 1, 500) if d[i, j] <= epsilon)
    assert np.allclose(got["d"], d[got["i"], got["j"]])
    assert sum(copies) <= neighbours.COPIES * 500


def test_percentile_of_equal_distances(spark):
    """Corners of a simplex and two copies of each: two distances in all, and the percentile lies between them."""
    x = np.repeat(np.eye(60), 3, axis=0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    upper = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(180, 1)]
    for q in (0.0, 100 * (180 - 0.5) / (len(upper) - 1), 50.0):
        assert neighbours.percentile(df, "id", "vec", q, box_rows=40)[0] == pytest.approx(np.percentile(upper, q), abs=1e-12)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e-15, 1e15])
def test_squares_keep_their_bound(scale):
    """Products in single precision stay within the error that they tell, far from the origin as well."""
    rng = np.random.default_rng(7)
    a, b = (rng.normal(size=(n, 30)) * scale + 50 * scale for n in (300, 200))
    a[:20] = b[:20]
    want = ((a[:, None] - b[None]) ** 2).sum(2)
    for part, near, error in neighbours.squares(a, b):
        assert (np.abs(near.astype(float) - want[part]) <= error).all() and error < 1e-3 * want.max()


def test_nearest_copies_no_queries(spark, monkeypatch):
    """Nearest vectors where no bound parts them: a copy of a query for its home box and no more; of equal vectors the smaller ids."""
    df, d = noise(spark, 500, 24)
    np.fill_diagonal(d, np.inf)
    copies = count_copies(monkeypatch)
    got = neighbours.nearest(df, "id", "vec", 4, box_rows=40).toPandas().sort_values(["i", "d", "j"])
    want = [np.lexsort((np.arange(500), row))[:4].tolist() for row in d]
    assert got["j"].to_numpy().reshape(-1, 4).tolist() == want
    assert sum(copies) <= (1 + neighbours.COPIES) * 500


def test_nearest_compares_few_copies(monkeypatch):
    """Two thousand equal vectors: a query looks at a few of them, those with the smallest ids."""
    asked, plain = [], neighbours.exact
    monkeypatch.setattr(neighbours, "exact", lambda a, b: asked.append(len(a)) or plain(a, b))
    v = np.vstack([np.ones((2000, 5)), np.random.default_rng(3).normal(size=(100, 5))])
    ids = np.arange(2100)
    got = neighbours._nearest(3)(ids[:200], v[:200], np.full(200, np.inf), ids, v)
    assert got.groupby("i")["j"].apply(list).tolist() == [[j for j in range(4) if j != i][:3] for i in range(200)]
    assert sum(asked) < 20 * 200
