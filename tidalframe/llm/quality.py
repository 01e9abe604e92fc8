"""Quality classifier: hashed word n-gram logistic regression trained with FTRL-proximal.

Training runs in one task over a bounded, documented sample of labelled rows
(``max_train_rows`` rows of ``max_train_chars`` code points in all), so the driver sees the
weights alone; scoring is a sparse dot
product per document in a pandas UDF, one map stage with no shuffle. Null and empty texts have
no features and score by the bias alone; whole texts are scored however long they are; repeated
rows score alike; an empty table gives an empty result, and a sample without labels gives every
text the score 0.5. A score equal to the threshold is accepted.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A word is a run of letters and digits, or a run of other signs without white space.
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_WORDS = 50_000
MULT = np.uint64(0x9E3779B97F4A7C15)
SAME_WORD = np.uint64(0x5851F42D4C957F2D)


class WordHashes(dict):
    """Word to 64-bit hash; emptied when full, so that its memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def features(text: str | None, hashes: WordHashes, bits: int, order: int = 2) -> np.ndarray:
    """Indices of all word n-grams up to ``order``; repeats stand as often as they occur.

    A word is hashed as written if it is short or has capitals throughout (shouting), and an
    immediate repetition of a word adds the n-gram "same word again".
    """
    words = TOKEN.findall(text) if text else []
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    out, gram = [(h * MULT) >> shift], h
    for n in range(1, order):
        gram = (gram[:-1] * MULT) ^ (h[n:] + np.uint64(n))
        out.append((gram * MULT) >> shift)
    repeats = int((h[1:] == h[:-1]).sum()) if len(h) > 1 else 0
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    for count, mark in ((repeats, 1), (upper, 2)):
        if count:
            out.append(np.full(count, (SAME_WORD * np.uint64(mark)) >> shift, np.uint64))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int
    order: int

    def score(self, text: str | None, hashes: WordHashes) -> float:
        index = features(text, hashes, self.bits, self.order)
        z = self.bias + (SCALE * float(self.weights[index].sum()) / len(index) if len(index) else 0.0)
        return float(1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, z)))))


#: Feature values are n-gram frequencies times this, so that a document's values sum to it.
SCALE = 20.0


def train(rows: list[tuple[str | None, int]], bits: int = 18, order: int = 2, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> Model:
    """FTRL-proximal: per-coordinate steps, weights set lazily from (z, n)."""
    size, hashes = 1 << bits, WordHashes()
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    data = []
    for text, label in rows:
        index, counts = np.unique(features(text, hashes, bits, order), return_counts=True)
        total = counts.sum()
        value = SCALE * counts / total if total else counts.astype(float)
        data.append((np.append(index, size).astype(np.int32), np.append(value, 1.0).astype(np.float32), float(label)))
    shuffled = np.random.default_rng(7)
    for _ in range(epochs):
        for k in shuffled.permutation(len(data)):
            i, x, y = data[k]
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - sigma * wi
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w[:size].astype(np.float32), float(w[size]), bits, order)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = 6000, max_train_chars: int = 20_000_000) -> Model:
    """Train on a bounded sample of labelled rows whose fold is not held out."""
    usable = labels.filter(common.bucket_of(id_col, 5) != 0)
    sample = common.labelled_sample(docs, usable, id_col, text_col, label_col, max_train_rows, max_train_chars)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        model = train(list(zip(rows["text"], rows["label"].astype(int), strict=True)))
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias], "bits": [model.bits], "n": [model.order]})

    made = sample.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(run, "weights binary, bias double, bits int, n int").first()
    return train([]) if made is None else Model(np.frombuffer(made["weights"], np.float32), made["bias"], made["bits"], made["n"])


def score_column(spark: SparkSession, model: Model, text_col: str):
    shared = spark.sparkContext.broadcast(model)

    scored = F.pandas_udf(_iterator(shared), "double")
    return scored(F.col(text_col))


def _iterator(shared):
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([shared.value.score(t, hashes) for t in texts], dtype="float64")
    return scored


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    common.tune(docs.sparkSession)
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(common.bucket_of(id_col, 5) == 0, F.lit(False)).alias("held_out"), score_column(docs.sparkSession, model, text_col).alias("score"))
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
    )


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows whose text scores at least ``threshold``, all columns as they came."""
    common.tune(docs.sparkSession)
    return docs.withColumn("__score", score_column(docs.sparkSession, model, text_col)).filter(F.col("__score") >= threshold).select(*[docs[c] for c in docs.columns])
