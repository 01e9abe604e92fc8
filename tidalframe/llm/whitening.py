"""Whitening of embeddings by randomised subspace iteration, exact by expansion.

The range finder multiplies a random block of ``components + oversample`` columns by the
covariance, pass after pass over all centred rows; each pass is one map over the rows, whose
partial products are summed by a shuffle. Rayleigh-Ritz in the block's span gives components
and, at no further cost, their residuals. A component counts as found if its residual is below
``TOLERANCE`` of its gap to the next Ritz values, or no more than rounding; if one of those asked for is not found after
``passes``, the block is expanded to an orthonormal basis of the full dimension, and
Rayleigh-Ritz on it is exact to double precision. The driver holds matrices of the dimension
alone, up to ``MAX_DIMENSION``.

Entries become integers, so sums are exact and rows are centred exactly: the integer n*x - S
divided by n. Rows are dropped whose vector is null or empty, or holds a null, a non-finite
number or one of 2**40 or more, or has another length than most rows (of lengths equally
frequent, the longer stays). Components whose eigenvalue is 0 but for rounding are not returned:
they have no scale. A deviation beyond a long is null. Null ids and repeated rows are rows as
any other; of equal eigenvalues the order is free; no rows give none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
#: Residual over gap at which a component is taken as found.
TOLERANCE = 1e-13
MAX_DIMENSION = 8192


def integers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the rows that count, entries as longs."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 40)))
    found = rows.filter(v.isNotNull() & (F.size(v) > 0) & ~odd)
    size = found.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    dimension = 0 if size is None else size["d"]
    if dimension > MAX_DIMENSION:
        raise ValueError(f"{dimension} dimensions; {MAX_DIMENSION} are allowed")
    return found.filter(F.size(v) == dimension).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(SCALE * c.cast("double")) + SHIFT).alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0), np.int64)


class Centre:
    """Count and sums of the fit list; centres integer rows exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n*x - S; of Python integers where longs could overflow."""
        near = x - self.base
        if len(near) and float(np.abs(near).max()) * self.n + self.n >= 2**62:
            return near.astype(object) * self.n - self.rest
        return near * self.n - self.rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = self.exact(x)
        if y.dtype == object or (y.size and float(np.abs(y).max()) ** 2 * y.shape[1] >= 2**62):
            y = y.astype(object)
        found = (y * y).sum(axis=1) if len(y) else []
        return [int(v) if v < 2**63 else None for v in found]


def partials(part: Callable[[np.ndarray], np.ndarray]):
    """For mapInArrow: the sum of ``part`` over the batches of a task, as rows (cell, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "v"])

    return run


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part`` of each batch, a flat array: one array a task is shuffled, by cells."""
    cells = rows.select("x").mapInArrow(partials(part), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    return cells.toPandas().sort_values("cell")["v"].to_numpy()


def column_sums(rows: DataFrame) -> list[int]:
    """Exact sums by dimension."""
    cells = rows.select("x").mapInArrow(partials(lambda x: x.sum(axis=0)), "cell long, v long").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return [int(r["v"]) for r in sorted(cells.collect(), key=lambda r: r["cell"])]


def multiplied(rows: DataFrame, centre: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance times ``block``, and its trace: one pass over all rows."""

    def part(x: np.ndarray) -> np.ndarray:
        y = centre.rows(x)
        return np.append((y.T @ (y @ block)).ravel(), (y * y).sum()) / centre.n

    out = summed(rows, part)
    return out[:-1].reshape(block.shape), float(out[-1])


def ritz(block: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors and the norms of their residuals."""
    small = block.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = block @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def found(values: np.ndarray, residuals: np.ndarray, wanted: int) -> bool:
    """Whether the first ``wanted`` Ritz vectors are eigenvectors to double precision."""
    gaps = np.abs(np.diff(values))
    near = np.minimum(np.append(np.inf, gaps[: wanted - 1]), gaps[:wanted]) if len(gaps) >= wanted else np.zeros(wanted)
    rounding = 16 * np.finfo(float).eps * abs(values[0])
    return bool((residuals[:wanted] <= np.maximum(TOLERANCE * near, rounding)).all())


def principal(rows: DataFrame, centre: Centre, components: int, oversample: int, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Eigenvalues, components as columns, trace, and whether the block was expanded to the full dimension."""
    d, random = len(centre.base), np.random.default_rng(seed)
    width, done = min(d, components + oversample), False
    block = np.linalg.qr(random.standard_normal((d, width)))[0]
    for _ in range(passes if width < d else 0):
        product, trace = multiplied(rows, centre, block)
        values, vectors, residuals = ritz(block, product)
        done = found(values, residuals, components)
        if done:
            break
        block = np.linalg.qr(product)[0]
    if not done:
        block = np.linalg.qr(np.hstack([block, random.standard_normal((d, d - width))]))[0]
        product, trace = multiplied(rows, centre, block)
        values, vectors, _ = ritz(block, product)
    keep = values[:components] > max(values[0], 0) * d * np.finfo(float).eps
    return values[:components][keep], vectors[:, :components][:, keep], trace, not done


def fit(rows: DataFrame, components: int = 32, oversample: int = 8, passes: int = 4, seed: int = 11) -> dict | None:
    """What ``whiten`` applies; None without rows."""
    n = rows.count()
    if not n:
        return None
    centre = Centre(n, column_sums(rows))
    values, vectors, trace, expanded = principal(rows, centre, components, oversample, passes, seed)
    scaled = vectors / np.sqrt(values)
    k = scaled.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        w = centre.rows(x) @ scaled
        return np.append((w.T @ w).ravel(), w.sum(axis=0)) / n

    got = summed(rows, part)
    mean = got[k * k :]
    error = np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max() if k else 0.0
    return {"centre": centre, "scaled": scaled, "explained": values / trace if k else values, "values": values, "vectors": vectors, "identity_error": float(error), "expanded": expanded}


def whiten(rows: DataFrame, model: dict | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row by each component."""
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(rows.schema["id"].dataType.simpleString())
    if model is None or not model["scaled"].size:
        return rows.sparkSession.createDataFrame([], schema)
    centre, scaled, explained, error = (model[k] for k in ("centre", "scaled", "explained", "identity_error"))
    k = scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch)
            again = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("id").take(again),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, centre.n)),
                pa.array(centre.deviations(x), pa.int64()).take(again),
                pa.array((centre.rows(x) @ scaled).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """Fits on all rows that count and whitens them; the integer rows are stored, as passes read them again and again."""
    common.tune(rows.sparkSession, 4096)
    kept = common.stored(integers(rows, id_col, vector_col))
    return whiten(kept, fit(kept, **settings))
