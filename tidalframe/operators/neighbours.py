"""Exact nearest vectors by a pivot index: cells that the triangle inequality rules out are never opened.

Vectors go to the nearest of up to ``PIVOTS`` pivots, and a cell's rows to boxes by their distance
from the pivot; a box keeps the least and greatest of those distances and its count. From a
query's distances to the pivots follow bounds of its distances to all rows of a box. A query
first asks its home box, which bounds the distance of its k-th neighbour, and then each box
whose lower bound does not exceed that.

Where bounds leave a query few boxes, box rows stay where they are and a copy of the query goes to
each. Where they tell nothing (independent noise in many dimensions) copies would grow with the
square of the table, beyond ``COPIES`` a query nothing is copied: a box is packed into one row, and
pairs of such rows meet in a cartesian product, which reads them again instead of shuffling them.
The work is still that of all pairs; on disk lies a multiple of the table.

The driver holds pivots and boxes alone: ``BOXES`` of them at most, as boxes grow with the table.
A box that many queries open is answered in several groups, each with a copy of the box.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..stages import discard, stored

PIVOTS, BOXES, BOX_ROWS, ASK_ROWS, SLICE = 256, 100_000, 4096, 8192, 256
#: Copies of a query, on average, beyond which boxes meet as packed rows.
COPIES = 4
#: Rows of a packed box that look at another box at once, rows of a result sent at once, and bytes of packed boxes that a task holds.
ROUND, HELD, ROOM = 1024, 100_000, 64 << 20
#: Vectors of the sample that proposes a range for a percentile; the range is then counted.
SAMPLE = 1000
#: Distances that the driver looks at to interpolate a percentile; distances listed for it by the tasks, a row of the table.
LISTED, LISTED_PER_ROW = 100_000, 16
#: Pairs whose distances are taken exactly at once.
PAIRS_AT_ONCE = 500
#: Relative slack of bounds, for rounding; distances themselves are exact.
SLACK = 1e-9
PAIRS = "i long, j long, d double"


@dataclass
class Index:
    """``rows``: (id, v, box), stored. Boxes by number: pivot, least and greatest distance from it, rows."""

    rows: DataFrame
    pivots: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    most: np.ndarray
    count: np.ndarray


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a whole vector."""
    v = F.col(vector_col)
    return table.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda c: c.isNull())).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by products of matrices: near enough for bounds."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def build(table: DataFrame, id_col: str, vector_col: str, box_rows: int = BOX_ROWS, pivots: int = PIVOTS) -> Index | None:
    """An index of all rows; None for an empty table."""
    rows = stored(vectors_of(table, id_col, vector_col))
    n = rows.count()
    if not n:
        return None
    box_rows = max(box_rows, -(-n // BOXES))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(min(pivots, -(-n // box_rows))).toPandas()
    centre = stacked(chosen["v"])

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                d = distances(stacked(part["v"]), centre)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype("int32"), r=d[np.arange(len(d)), cell])

    placed = stored(rows.mapInPandas(place, f"id long, v {rows.schema['v'].dataType.simpleString()}, cell int, r double"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.max("r").alias("top"))
    bands = F.ceil(F.col("c") / box_rows)
    banded = placed.join(F.broadcast(cells), "cell").withColumn("band", F.least(bands - 1, F.floor(F.coalesce(F.col("r") / F.nullif("top", F.lit(0.0)), F.lit(0.0)) * bands)).cast("int"))
    sizes = banded.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("c2"), F.min("r").alias("least"), F.max("r").alias("most"))
    # Bands of equal distances are split by a hash of the id.
    sizes = stored(sizes.withColumn("first", F.sum(F.ceil(F.col("c2") / box_rows)).over(Window.orderBy("cell", "band").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["first"]))
    box = (F.col("first") + F.pmod(F.xxhash64("id"), F.ceil(F.col("c2") / box_rows))).cast("int")
    boxed = stored(banded.join(F.broadcast(sizes.select("cell", "band", "c2", "first")), ["cell", "band"]).select("id", "v", "cell", "r", box.alias("box")))
    got = boxed.groupBy("box").agg(F.first("cell").alias("cell"), F.min("r").alias("least"), F.max("r").alias("most"), F.count(F.lit(1)).alias("n")).toPandas()
    discard(rows)
    discard(placed)
    # A number that no row has is a box without rows.
    got = got.set_index("box").reindex(range(int(got["box"].max()) + 1), fill_value=0)
    return Index(boxed.select("id", "v", "box"), centre, got["cell"].to_numpy(int), got["least"].to_numpy(float), got["most"].to_numpy(float), got["n"].to_numpy(np.int64))


def bounds(index: Index, d: np.ndarray, at=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances to the rows of each box (of those ``at``), from the distances to the pivots; infinite for empty boxes."""
    d, least, most = d[:, index.pivot[at]], index.least[at], index.most[at]
    slack = SLACK * (1 + d + most)
    low = np.maximum(np.maximum(d - most, least - d), 0) - slack
    empty = index.count[at] == 0
    return np.where(empty, np.inf, low), np.where(empty, np.inf, d + most + slack)


def _light(index: Index) -> Index:
    """What tasks need: no table."""
    return Index(None, index.pivots, index.pivot, index.least, index.most, index.count)


Choose = Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray]


def _choices(index: Index, choose: Choose) -> Callable[[pd.DataFrame], Iterator[tuple[pd.DataFrame, np.ndarray]]]:
    """Slices of a frame of queries, and which boxes ``choose`` opens for them."""
    light = _light(index)

    def run(whole: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for at in range(0, len(whole), SLICE):
            part = whole.iloc[at : at + SLICE]
            yield part, choose(*bounds(light, distances(stacked(part["v"]), light.pivots)), part)

    return run


def asked(index: Index, queries: DataFrame, choose: Choose) -> DataFrame:
    """(box, id, v, tau, own), stored: a copy of a query for each box that ``choose`` (lower, upper, rows) opens; ``own`` is a query's box, if it tells."""
    choices = _choices(index, choose)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for part, opened in choices(whole):
                row, box = np.nonzero(opened)
                yield part.iloc[row].assign(box=box.astype("int32"))[["box", "id", "v", "tau", "own"]]

    kind = queries.schema["v"].dataType.simpleString()
    own = F.col("box") if "box" in queries.columns else F.lit(-1)
    return stored(queries.select("id", "v", "tau", own.alias("own")).mapInPandas(run, f"box int, id long, v {kind}, tau double, own int"))


def few(index: Index, queries: DataFrame, choose: Choose) -> bool:
    """Whether ``asked`` makes few copies: ``COPIES`` a query at most."""
    choices = _choices(index, choose)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            yield pd.DataFrame({"copies": [sum(int(opened.sum()) for _, opened in choices(whole))], "rows": [len(whole)]})

    own = F.col("box") if "box" in queries.columns else F.lit(-1)
    got = queries.select("id", "v", "tau", own.alias("own")).mapInPandas(run, "copies long, rows long").agg(F.sum("copies"), F.sum("rows")).first()
    return (got[0] or 0) <= COPIES * (got[1] or 0)


#: Of query ids, vectors, taus, box ids, vectors, and whether the box is the query's own, where a pair is wanted once.
Answer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def answered(index: Index, asks: DataFrame, answer: Answer, schema: str) -> DataFrame:
    """``answer`` of every box and the queries that ask it, some at a time."""
    many = asks.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("int").alias("groups"))
    side = lambda df, asks: df.select("box", "group", "id", "v", *[(F.col(c) if asks else F.lit(None).cast(t)).alias(c) for c, t in (("tau", "double"), ("own", "int"))], F.lit(asks).alias("asks"))
    own = index.rows.join(F.broadcast(many), "box").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    other = asks.join(F.broadcast(many), "box").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, r = rows[rows["asks"]].sort_values("id"), rows[~rows["asks"]].sort_values("id")
        if q.empty or r.empty:
            return answer(np.zeros(0, int), np.zeros((0, 1)), np.zeros(0), np.zeros(0, int), np.zeros((0, 1)), np.zeros(0, bool))
        ids, vectors = r["id"].to_numpy(), stacked(r["v"])
        out = []
        for at in range(0, len(q), ROUND):
            part = q.iloc[at : at + ROUND]
            out.append(answer(part["id"].to_numpy(), stacked(part["v"]), part["tau"].to_numpy(float), ids, vectors, (part["own"] == part["box"]).to_numpy(bool)))
        return pd.concat(out)

    return side(own, False).unionByName(side(other, True)).groupBy("box", "group").applyInPandas(run, schema)


def packed(rows: DataFrame) -> DataFrame:
    """(box, ids, v, tau, size), stored: the rows (id, v, tau) of a box as one row of bytes, by id."""
    kind = "f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "f8"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        parts = rows["id"].to_numpy("i8").tobytes(), stacked(rows["v"]).astype(kind).tobytes(), rows["tau"].to_numpy("f8").tobytes()
        return pd.DataFrame([(key[0], *parts, kind, sum(map(len, parts)))], columns=["box", "ids", "v", "tau", "kind", "size"])

    # Small groups of rows in a file, as a reader takes a whole group at once.
    return stored(rows.select("box", "id", "v", "tau").groupBy("box").applyInPandas(run, "box int, ids binary, v binary, tau binary, kind string, size long"), **{"parquet.block.size": 16 << 20})


def unpacked(ids: bytes, v: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    out = np.frombuffer(ids, "i8")
    return out, np.frombuffer(v, kind).reshape(len(out), -1).astype(float)


Fold = Callable[[pd.DataFrame, np.ndarray, np.ndarray], tuple[pd.DataFrame, np.ndarray]]


def met(index: Index, queries: DataFrame, answer: Answer, schema: str, floor: float = -math.inf, once: bool = False, fold: Fold | None = None) -> DataFrame:
    """``answer`` of every box and all queries (id, v, tau, box) that it may hold rows for, from ``floor`` to tau.

    Nothing is copied: boxes meet as packed rows. ``once``: queries are the rows of the index and a
    pair of boxes meets once. ``fold`` (result so far, query ids, taus) makes a packed row's result smaller and its taus lower.
    """
    light, left = _light(index), packed(queries)
    right = left if once else packed(index.rows.withColumn("tau", F.lit(0.0)))
    boxes, held = left.count(), right.agg(F.sum("size")).first()[0] or 0
    # A task looks at one packed row of queries, or a few, and some boxes.
    ask = left.select(F.col("box").alias("q"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), "tau", F.col("kind").alias("q_kind")).repartition(max(boxes, 1))
    other = right.select("box", "ids", "v", "kind").coalesce(-(-held // ROOM) or 1).hint("shuffle_replicate_nl")
    pairs = ask.crossJoin(other)
    if once:
        pairs = pairs.filter(F.col("q") <= F.col("box"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, rows = None, [], 0
        for part in parts:
            for pair in part.itertuples(index=False):
                if pair.q != at:
                    if held:
                        yield pd.concat(held)
                    at, held, rows = pair.q, [], 0
                    ids, v = unpacked(pair.q_ids, pair.q_v, pair.q_kind)
                    tau, far = np.frombuffer(pair.tau, "f8"), distances(v, light.pivots)
                other, w = unpacked(pair.ids, pair.v, pair.kind)
                low, up = (b[:, 0] for b in bounds(light, far, [pair.box]))
                own = once and pair.q == pair.box
                opened = np.flatnonzero(np.full(len(ids), True) if own else (low <= tau) & (up >= floor))
                for k in range(0, len(opened), ROUND):
                    some = opened[k : k + ROUND]
                    held.append(answer(ids[some], v[some], tau[some], other, w, np.full(len(some), own)))
                    rows += len(held[-1])
                    if fold is None and rows >= HELD:
                        yield pd.concat(held)
                        held, rows = [], 0
                if fold is not None and held:
                    folded, tau = fold(pd.concat(held), ids, tau)
                    held = [folded]
        if held:
            yield pd.concat(held)

    return pairs.mapInPandas(run, schema)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, dimension by dimension."""
    apart = np.ascontiguousarray((a - b).T)
    apart *= apart
    # Sums across many columns run row by row; those of few may take halves first, which rounds otherwise.
    return np.sqrt(apart.sum(axis=0) if len(a) >= 64 else sum(apart, np.zeros(len(a))))


def exact_at(v: np.ndarray, w: np.ndarray, row: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``exact`` of v[row] and w[to], ``PAIRS_AT_ONCE`` at a time."""
    parts = [exact(v[row[k : k + PAIRS_AT_ONCE]], w[to[k : k + PAIRS_AT_ONCE]]) for k in range(0, len(row), PAIRS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def squares(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray, float]]:
    """Squares of all distances by products of matrices, some rows of ``a`` at a time, and a bound of their error.

    Single precision decides nothing: what lies within the bound is taken exactly.
    """
    centre = b.mean(axis=0) if len(b) else 0.0
    a, b = a - centre, b - centre
    own, other = (a * a).sum(1), (b * b).sum(1)
    top = math.sqrt(own.max(initial=0)) + math.sqrt(other.max(initial=0))
    # Far from these, squares leave the range of single precision.
    single = 1e-12 < top < 1e12
    kind, unit = (np.float32, 6.2e-8) if single else (float, 1.2e-16)
    right = np.column_stack([b, np.ones(len(b)), other]).astype(kind).T
    error = unit * (a.shape[1] + 16) * top * top + 1e-300
    left = np.column_stack([-2 * a, own, np.ones(len(a))]).astype(kind)
    out = np.empty((min(SLICE, len(a)), len(b)), kind)
    for at in range(0, len(a), SLICE):
        part = slice(at, min(at + SLICE, len(a)))
        # One buffer for all slices: fresh memory costs as much as the product.
        yield part, np.matmul(left[part], right, out=out[: part.stop - at]), error


def up_to(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Numbers as ``kind``, rounded up."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(kind), kind.type(np.inf))


def _single(near: np.ndarray, ids, other, own) -> None:
    """Puts pairs of one id out of reach, and of a box with itself all but one of each pair's two; box ids are in order."""
    if own.any():
        rows = np.flatnonzero(own)
        near[rows] = np.where(ids[rows][:, None] >= other[None], np.inf, near[rows])
    if len(other):
        for row in np.flatnonzero((other[np.searchsorted(other, ids).clip(max=len(other) - 1)] == ids) & ~own):
            near[row, other == ids[row]] = np.inf


def _found(ids, v, tau, other, w, near: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs at tau or nearer among those whose squares say so."""
    close = near <= up_to(tau * tau * (1 + SLACK) + error, near.dtype)[:, None]
    # Few rows have any, most often.
    some = np.flatnonzero(close.any(axis=1))
    row, to = np.divmod(np.flatnonzero(close[some]), max(near.shape[1], 1))
    row = some[row]
    apart = ids[row] != other[to]
    row, to = row[apart], to[apart]
    d = exact_at(v, w, row, to)
    ok = d <= tau[row]
    return ids[row][ok], other[to][ok], d[ok]


def _framed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pd.DataFrame({"i": i, "j": j, "d": d})


def _within(ids, v, tau, other, w, own) -> pd.DataFrame:
    """Other rows at tau or nearer."""
    found = []
    for part, near, error in squares(v, w):
        if own.any():
            _single(near, ids[part], other, own[part])
        found.append(_found(ids[part], v[part], tau[part], other, w, near, error))
    return _framed(found)


def _best(found: pd.DataFrame, k: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The k nearest rows of each i, the smaller id nearer of equal distances, and their ranks."""
    i, j, d = (found[c].to_numpy() for c in "ijd")
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    keep = rank < k
    return pd.DataFrame({"i": i[keep], "j": j[keep], "d": d[keep]}), rank[keep]


def _without_copies(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest ids of each vector: no other can be among the nearest."""
    if len(np.unique((v * v).sum(axis=1))) > len(v) - k:
        return ids, v
    _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    first = np.searchsorted(same[order], same[order])
    keep = np.sort(order[np.arange(len(order)) - first < k])
    return ids[keep], v[keep]


def _nearest(k: int):
    """The k nearest other rows, at tau or nearer; of equal distances the smaller id is nearer."""

    def answer(ids, v, tau, other, w, own=None) -> pd.DataFrame:
        tau, found = tau.copy(), []
        other, w = _without_copies(other, w, k + 1)
        for part, near, error in squares(v, w):
            # Only a query that knows no bound yet looks for one: k rows and itself.
            new = part.start + np.flatnonzero(np.isinf(tau[part]))
            if len(new) and near.shape[1] > k:
                kth = np.partition(near[new - part.start], k, axis=1)[:, k].astype(float)
                tau[new] = np.sqrt(np.maximum(kth, 0) * (1 + SLACK) + 2 * error)
            found.append(_found(ids[part], v[part], tau[part], other, w, near, error))
        return _best(_framed(found), k)[0]

    return answer


def _nearest_so_far(k: int) -> Fold:
    """The k nearest of all boxes met, and the taus that they give."""

    def fold(found: pd.DataFrame, ids: np.ndarray, tau: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        best, rank = _best(found, k)
        last = best[rank == k - 1]
        tau, at = tau.copy(), np.searchsorted(ids, last["i"].to_numpy())
        tau[at] = np.minimum(tau[at], last["d"].to_numpy())
        return best, tau

    return fold


def _asking(index: Index, queries: DataFrame | None, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, box) of the queries: the index's own rows, or those of a table in boxes by a hash."""
    if queries is None:
        return index.rows.select("id", "v", "box")
    rows = stored(vectors_of(queries, id_col, vector_col))
    return rows.withColumn("box", F.pmod(F.xxhash64("id"), F.lit(-(-rows.count() // BOX_ROWS) or 1)).cast("int"))


def nearest(table: DataFrame, id_col: str, vector_col: str, k: int, queries: DataFrame | None = None, box_rows: int = BOX_ROWS) -> DataFrame:
    """(i, j, d): the k nearest other vectors of each query (all rows unless a set is given), exact."""
    index = build(table, id_col, vector_col, box_rows)
    if index is None:
        return table.sparkSession.createDataFrame([], PAIRS)
    asking = _asking(index, queries, id_col, vector_col)
    home = asked(index, asking.select("id", "v", F.lit(float("inf")).alias("tau")), lambda low, up, _: np.arange(low.shape[1])[None] == up.argmin(axis=1)[:, None])
    first = stored(answered(index, home, _nearest(k), PAIRS))
    discard(home)
    tau = first.groupBy("i").agg(F.count(F.lit(1)).alias("c"), F.max("d").alias("m")).select(F.col("i").alias("id"), F.when(F.col("c") >= k, F.col("m")).otherwise(F.lit(float("inf"))).alias("tau"))
    known = stored(asking.join(tau, "id", "left").na.fill(float("inf"), ["tau"]))

    def rest(low: np.ndarray, up: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        order = np.argsort(up, axis=1)
        # Enough rows, the query among them, lie within the upper bounds of the first boxes.
        full = np.cumsum(index_count[order], axis=1) > k
        most = np.where(full.any(axis=1), np.take_along_axis(up, order, 1)[np.arange(len(up)), full.argmax(axis=1)], np.inf)
        limit = np.minimum(part["tau"].to_numpy(float), most)
        return (low <= limit[:, None]) & np.isfinite(low) & (np.arange(low.shape[1])[None] != up.argmin(axis=1)[:, None])

    index_count, free = index.count, known.drop("box")
    if few(index, free, rest):
        every = first.unionByName(answered(index, asked(index, free, rest), _nearest(k), PAIRS))
    else:
        every = met(index, known, _nearest(k), PAIRS, fold=_nearest_so_far(k))
    return every.withColumn("__r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("__r") <= k).drop("__r")


def within(table: DataFrame, id_col: str, vector_col: str, epsilon: float, queries: DataFrame | None = None, box_rows: int = BOX_ROWS, index: Index | None = None) -> DataFrame:
    """(i, j, d): other vectors within epsilon of each query vector, exact."""
    index = index or build(table, id_col, vector_col, box_rows)
    if index is None:
        return table.sparkSession.createDataFrame([], PAIRS)
    asking = _asking(index, queries, id_col, vector_col).withColumn("tau", F.lit(float(epsilon)))
    choose = lambda low, up, _: low <= epsilon
    if few(index, asking.drop("box"), choose):
        return answered(index, asked(index, asking.drop("box"), choose), _within, PAIRS)
    return met(index, asking, _within, PAIRS)


def _once(index: Index, answer: Answer, schema: str, low: float, high: float, fold: Fold | None = None) -> DataFrame:
    """``answer`` of each pair of rows once, boxes with nothing from ``low`` to ``high`` left out."""
    rows = index.rows.select("id", "v", F.lit(float(high)).alias("tau"), "box")

    def choose(least: np.ndarray, most: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        own, box = part["own"].to_numpy()[:, None], np.arange(least.shape[1])[None]
        return (box == own) | ((box > own) & (least <= high) & (most >= low) & np.isfinite(least))

    if few(index, rows, choose):
        return answered(index, asked(index, rows, choose), answer, schema)
    return met(index, rows, answer, schema, low, True, fold)


def pairs_within(index: Index, epsilon: float) -> DataFrame:
    """(i, j, d): pairs of different vectors within epsilon, exact, each once with i < j."""
    found = _once(index, _within, PAIRS, -math.inf, epsilon)
    return found.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")


def _below(index: Index, low: float) -> int:
    """Pairs of rows of different boxes that ``_once`` leaves out as nearer than ``low``."""
    light = _light(index)

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for part in parts:
            for at in range(0, len(part), SLICE):
                some = part.iloc[at : at + SLICE]
                _, up = bounds(light, distances(stacked(some["v"]), light.pivots))
                later = np.arange(up.shape[1])[None] > some["box"].to_numpy()[:, None]
                total += int((((up < low) & later) * light.count[None]).sum())
        yield pd.DataFrame({"n": [total]})

    return int(index.rows.select("v", "box").mapInPandas(whole, "n long").agg(F.sum("n")).first()[0] or 0)


def _sums(found: pd.DataFrame, ids: np.ndarray, tau: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    return found.groupby("at", as_index=False, sort=False).agg({"n": "sum", "error": "max"}), tau


COUNTS = "at double, n long, error double"


def _counts(at: np.ndarray, n: np.ndarray, below: int, error: float) -> pd.DataFrame:
    """Numbers ``n`` at places ``at``; place -1 has those below."""
    return pd.DataFrame({"at": np.append(at, -1.0).astype(float), "n": np.append(n, below).astype("int64"), "error": error})


def _spread(index: Index, low: float, high: float, bins: int) -> tuple[int, np.ndarray, float]:
    """Pairs of rows whose squares of distances are below low's, and their histogram from low's to high's; squares are near ones, their error is told."""
    a, b = low * low, high * high
    step = max((b - a) / bins, 1e-300)

    def answer(ids, v, tau, other, w, own) -> pd.DataFrame:
        below, found, worst = 0, np.zeros(bins, np.int64), 0.0
        for part, near, error in squares(v, w):
            _single(near, ids[part], other, own[part])
            flat, worst = near.ravel(), max(worst, error)
            # In double precision from here on, as a bin's edge is.
            x = np.maximum(flat[np.flatnonzero(flat <= up_to(np.array([b]), flat.dtype)[0])].astype(float), 0)
            below += int((x < a).sum())
            found += np.bincount(((x[(x >= a) & (x < b)] - a) / step).astype(int).clip(0, bins - 1), minlength=bins)
        used = np.flatnonzero(found)
        return _counts(used, found[used], below, worst)

    rows = _once(index, answer, COUNTS, low, high, _sums)
    got = {r["at"]: r for r in rows.groupBy("at").agg(F.sum("n").alias("n"), F.max("error").alias("error")).collect()}
    out = np.array([got[k]["n"] if k in got else 0 for k in range(bins)])
    # Edges of bins are rounded as well.
    error = max((r["error"] for r in got.values()), default=0.0) + 1e-14 * b
    return (got[-1]["n"] if -1 in got else 0) + _below(index, low), out, error


def _exactly(low: float, high: float, edges: np.ndarray | None) -> Answer:
    """Pairs nearer than ``low``, and numbers of pairs at each distance from low to high or, given edges, in each bin."""

    def answer(ids, v, tau, other, w, own) -> pd.DataFrame:
        below, listed = 0, []
        for part, near, error in squares(v, w):
            _single(near, ids[part], other, own[part])
            under = near < -up_to(np.array([error - low * low * (1 - SLACK)]), near.dtype)[0]
            below += int(under.sum())
            place = np.flatnonzero((near <= up_to(np.array([high * high * (1 + SLACK) + error]), near.dtype)[0]) & ~under)
            d = exact_at(v[part], w, *np.divmod(place, max(near.shape[1], 1)))
            below += int((d < low).sum())
            listed.append(d[(d >= low) & (d <= high)])
        d = np.concatenate(listed) if listed else np.zeros(0)
        if edges is not None:
            d = np.clip(np.searchsorted(edges, d, "right") - 1, 0, len(edges) - 2)
        return _counts(*np.unique(d, return_counts=True), below, 0.0)

    return answer


def _at(listed: DataFrame, k: int) -> float:
    """The k-th of (at, n): places and how often they are there."""
    while True:
        span = listed.agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("low"), F.max("at").alias("high")).first()
        if span["rows"] <= LISTED or span["low"] == span["high"]:
            break
        width = (span["high"] - span["low"]) / 4096
        bin_ = F.least(F.floor((F.col("at") - span["low"]) / width), F.lit(4095))
        got = listed.groupBy(bin_.alias("bin")).agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
        sums = got["n"].cumsum().to_numpy()
        chosen = int(np.searchsorted(sums, k, "right"))
        k -= int(sums[chosen] - got["n"].iloc[chosen])
        listed = listed.filter(bin_ == int(got["bin"].iloc[chosen]))
    if span["low"] == span["high"]:
        return float(span["low"])
    got = listed.groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")
    return float(got["at"].iloc[int(np.searchsorted(got["n"].cumsum().to_numpy(), k, "right"))])


def percentile(table: DataFrame, id_col: str, vector_col: str, q: float, box_rows: int = BOX_ROWS, bins: int = 4096) -> tuple[float | None, Index | None]:
    """Interpolated percentile of the distances of all pairs, exact, and the index.

    A bounded sample proposes a range, and the range is widened until counts of near distances show
    that it holds the ranks. The bins that hold them, wider by the error, are listed exactly, a
    number of distances that grows with the table; while they hold more, they are counted exactly in narrower bins.
    """
    index = build(table, id_col, vector_col, box_rows)
    n = 0 if index is None else int(index.count.sum())
    if n < 2:
        return None, index
    same = index.rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0]
    pairs = n * (n - 1) // 2 - int(same or 0)
    if not pairs:
        return None, index
    rank = q / 100 * (pairs - 1)
    floor, ceil = math.floor(rank), math.ceil(rank)
    some = stacked(index.rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).toPandas()["v"])
    d = np.sort(distances(some, some)[np.triu_indices(len(some), 1)])
    top, margin = 2 * float(np.max(index.most) + distances(index.pivots, index.pivots).max()) + 1e-6 * float(np.linalg.norm(index.pivots, axis=1).max()) + 1e-9, 0.005
    while True:
        low = float(d[int(len(d) * (q / 100 - margin))]) if q / 100 > margin else 0.0
        high = float(d[int(len(d) * (q / 100 + margin))]) if q / 100 + margin < 1 else top
        before, found, error = _spread(index, low, high, bins)
        if before <= floor and ceil < before + found.sum():
            break
        if low == 0 and high == top:
            raise ValidationError("distances are not finite")
        margin *= 4
    sums = before + np.cumsum(found)
    first, last = (int(np.searchsorted(sums, k, "right")) for k in (floor, ceil))
    edges = np.linspace(low * low, high * high, bins + 1)
    low, high = math.sqrt(max(edges[first] - error, 0)) * (1 - SLACK), math.sqrt(edges[last + 1] + error) * (1 + SLACK)
    held = int(found[max(first - 1, 0) : last + 2].sum())
    # Distances that are equal stay together, so the rounds are few; they are listed as one.
    for _ in range(6):
        if held <= max(LISTED, LISTED_PER_ROW * n) or high - low <= 1e-12 * top:
            break
        edges = np.linspace(low, high, bins + 1)
        rows = _once(index, _exactly(low, high, edges), COUNTS, low, high, _sums)
        got = {r["at"]: r["n"] for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect()}
        found = np.array([got.get(k, 0) for k in range(bins)])
        sums = got.get(-1, 0) + _below(index, low) + np.cumsum(found)
        first, last = (int(np.searchsorted(sums, k, "right")) for k in (floor, ceil))
        held, low, high = int(found[first : last + 1].sum()), float(edges[first]), float(edges[last + 1])
    listed = stored(_once(index, _exactly(low, high, None), COUNTS, low, high, _sums).select("at", "n"))
    before = int(listed.filter(F.col("at") == -1).agg(F.sum("n")).first()[0] or 0) + _below(index, low)
    inside = listed.filter(F.col("at") >= 0)
    least = _at(inside, floor - before)
    return least + (rank - floor) * ((least if ceil == floor else _at(inside, ceil - before)) - least), index
