"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character trigrams and, if it is in the learned lexicon,
the word itself; transitions between the languages of neighbouring words are learned with them.
Training sequences are code-switched: pieces of documents of different languages follow each
other, each word labelled with its document's language. Forward-backward gives every word of a
whole text its label probabilities, and their mean over the text is the document's prediction.

Training reads at most ``max_train_docs`` documents of ``max_train_chars`` code points in all
whose fold is not held out; scoring is one map stage. A null text, and one without letters, is
``und`` with score 0; numerals are no letters. Whole texts are scored, very long ones in blocks
of a batch of their own. Repeated rows score alike; of labels with equal means the first of the
alphabet is predicted. An empty table gives an empty result; without any training row every
text is ``und``.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
UND = "und"
CACHE_WORDS = 200_000
#: Words of a block whose transfer matrices are multiplied out.
BLOCK = 64


def words_of(text: str | None) -> list[str]:
    """Runs of letters; what has numerals like ½ alone is no word."""
    return [w for w in WORD.findall(text) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def word_features(word: str) -> list[str]:
    w = word.lower()
    padded = f"^{w}$"
    return ["w:" + w, "p:" + w[:2], "p:" + w[:4], "s:" + w[-2:], "s:" + w[-4:], *[padded[k : k + 3] for k in range(len(w))]]


@dataclass
class Model:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray  # a row per feature, a column per label
    transition: np.ndarray  # from row to column, logarithms

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of label weights for each word, scaled so that the largest is 1."""
        get, last = self.index.get, len(self.index)
        lists = [[get(f, last) for f in word_features(w)] for w in words]
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        rows = np.fromiter((i for own in lists for i in own), np.int64)
        e = np.add.reduceat(np.vstack([self.weights, np.zeros((1, len(self.labels)), np.float32)])[rows], starts, axis=0)
        return np.exp(e - e.max(axis=1, keepdims=True))


def posteriors(emission: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label probabilities of every word by forward-backward, for sequences laid end to end.

    Sequences are cut into blocks of ``BLOCK`` words. Each block's transfer matrix is
    multiplied out, all blocks at once; vectors then pass from block to block of a sequence,
    and within all blocks at once. Padding words pass vectors on unchanged.
    """
    size = transition.shape[0]
    per = -(-lengths // BLOCK)
    first = np.concatenate(([0], np.cumsum(per)))
    total = int(first[-1])
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = np.repeat(first[:-1], lengths) + at // BLOCK, at % BLOCK
    e = np.zeros((total, BLOCK, size))
    e[row, col] = emission
    real = np.zeros((total, BLOCK), bool)
    real[row, col] = True
    move = np.exp(transition - transition.max())

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    # Row i of a block's matrix: what the unit vector i at its entry becomes at its exit.
    through = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for k in range(BLOCK):
        nxt = (through.reshape(-1, size) @ move).reshape(total, size, size) * e[:, k, None, :]
        through = np.where(real[:, k, None, None], nxt, through)
        if k % 8 == 7:
            through /= through.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.full((total, size), 1.0 / size), np.full((total, size), 1.0 / size)
    for step in range(1, int(per.max(initial=0))):
        b = first[:-1][per > step] + step
        enter[b] = scaled(np.einsum("bi,bij->bj", enter[b - 1], through[b - 1]))
    for step in range(int(per.max(initial=0)) - 2, -1, -1):
        b = first[:-1][per > step + 1] + step
        leave[b] = scaled(np.einsum("bij,bj->bi", through[b + 1], leave[b + 1]))
    forward = np.empty((total, BLOCK, size))
    now = enter
    for k in range(BLOCK):
        now = forward[:, k] = scaled(np.where(real[:, k, None], (now @ move) * e[:, k], now))
    backward, now = np.empty((total, BLOCK, size)), leave
    for k in range(BLOCK - 1, -1, -1):
        backward[:, k] = now
        now = scaled(np.where(real[:, k, None], (e[:, k] * now) @ move.T, now))
    return scaled(forward[row, col] * backward[row, col])


def _sequences(rows: list[tuple[str, int]], length: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Words and labels of code-switched sequences, ``length`` words each; the last is filled up from the first words."""
    random = np.random.default_rng(seed)
    runs = []
    for text, label in rows:
        words, at = words_of(text), 0
        while at < len(words):
            n = int(random.integers(length // 8, length))
            runs.append((words[at : at + n], label))
            at += n
    order = random.permutation(len(runs))
    words = [w for k in order for w in runs[k][0]]
    labels = np.array([label for k in order for label in [runs[k][1]] * len(runs[k][0])], np.int64)
    short = -len(words) % length if words else 0
    again = [k % len(words) for k in range(short)]
    return words + [words[k] for k in again], np.append(labels, labels[again]).reshape(-1, length)


def train(rows: list[tuple[str, str]], lexicon: int = 2000, max_features: int = 40_000, length: int = 48, steps: int = 30, rate: float = 0.2, decay: float = 1e-5, seed: int = 11) -> Model:
    """Maximum likelihood by Adam; expectations come from forward-backward over all sequences."""
    labels = sorted({lang for _, lang in rows})
    words, gold = _sequences([(t, labels.index(lang)) for t, lang in rows], length, seed)
    size = len(labels)
    if not words or size < 1:
        return Model(labels, {}, np.zeros((0, size), np.float32), np.zeros((size, size)))
    types = Counter(words)
    place = {w: i for i, w in enumerate(types)}
    counts, lists = Counter(), [word_features(w) for w in types]
    for fs, n in zip(lists, types.values(), strict=True):
        for f in fs:
            counts[f] += n
    in_lexicon = {f"w:{w}" for w, _ in Counter({f[2:]: n for f, n in counts.items() if f.startswith("w:")}).most_common(lexicon)}
    ranked = [f for f, _ in counts.most_common() if not f.startswith("w:") or f in in_lexicon]
    index = {f: i for i, f in enumerate(ranked[:max_features])}
    pairs = [(t, index[f]) for t, fs in enumerate(lists) for f in fs if f in index]
    of_type, of_feature = np.array(pairs, np.int64).T
    ids = np.array([place[w] for w in words], np.int64).reshape(-1, length)
    weights, transition = np.zeros((len(index), size)), np.zeros((size, size))
    onehot = np.eye(size)
    seen = np.zeros((len(types), size))
    np.add.at(seen, ids.ravel(), onehot[gold.ravel()])
    moved = np.zeros((size, size))
    np.add.at(moved, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    params = [weights, transition]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    n = ids.size
    for step in range(1, steps + 1):
        score = np.stack([np.bincount(of_type, weights[of_feature, c], len(types)) for c in range(size)], axis=1)
        e = np.exp(score - score.max(axis=1, keepdims=True))[ids]
        move = np.exp(transition - transition.max())
        fwd, scale = np.empty(e.shape), None
        now = np.full((len(ids), size), 1.0 / size)
        for k in range(length):
            now = (now @ move) * e[:, k]
            now /= now.sum(axis=1, keepdims=True)
            fwd[:, k] = now
        back = np.full((len(ids), size), 1.0 / size)
        post, moves = np.empty(e.shape), np.zeros((size, size))
        for k in range(length - 1, -1, -1):
            p = fwd[:, k] * back
            post[:, k] = p / p.sum(axis=1, keepdims=True)
            weighted = e[:, k] * back
            if k:
                joint = fwd[:, k - 1, :, None] * move * weighted[:, None, :]
                moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = weighted @ move.T
            back /= back.sum(axis=1, keepdims=True)
        expected = np.stack([np.bincount(ids.ravel(), post[:, :, c].ravel(), len(types)) for c in range(size)], axis=1)
        by_type = (seen - expected) / n
        gradient = [np.stack([np.bincount(of_feature, by_type[of_type, c], len(index)) for c in range(size)], axis=1) - decay * weights, (moved - moves) / n]
        for p, g, m in zip(params, gradient, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    return Model(labels, index, weights.astype(np.float32), transition)


class Predictor:
    """Scores batches of texts; a word's emissions are computed once while the cache has room."""

    def __init__(self, model: Model):
        self.model, self.place, self.table = model, {}, np.empty((1024, len(model.labels)))

    def _places(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if len(self.place) + len(new) > CACHE_WORDS:
            self.place, new = {}, list(dict.fromkeys(words))
        start = len(self.place)
        while start + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        if new:
            self.table[start : start + len(new)] = self.model.emissions(new)
            self.place.update(zip(new, range(start, start + len(new)), strict=True))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None], words_at_once: int = 400_000) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
        if not self.model.labels:
            return out
        group, size = [], 0
        for k, text in enumerate(texts):
            words = words_of(text)
            if words:
                group.append((k, words))
                size += len(words)
            if size >= words_at_once:
                self._group(group, out)
                group, size = [], 0
        self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, list[str]]], out: list[tuple[str, float]]) -> None:
        if not group:
            return
        places = self._places([w for _, words in group for w in words])
        lengths = np.array([len(words) for _, words in group])
        post = posteriors(self.table[places], self.model.transition, lengths)
        mean = np.add.reduceat(post, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        for (k, _), p in zip(group, mean, strict=True):
            out[k] = (self.model.labels[int(p.argmax())], float(min(1.0, p.max())))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train_docs: int = 600, max_train_chars: int = 4_000_000) -> Model:
    """Train on a bounded sample of documents with a language outside the held-out fold.

    The sample is chosen by a hash of the id among ids alone, and only then are texts read.
    """
    named = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")).filter(F.col("__lang").isNotNull() & (common.bucket_of("__id", 4) != 2))
    rows = common.labelled_sample(docs, named.withColumnRenamed("__id", id_col), id_col, text_col, "__lang", max_train_docs, max_train_chars).orderBy("id").toPandas()
    return train(list(zip(rows["text"], rows["label"], strict=True)))


def _scorer(shared):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for texts in batches:
            yield pd.DataFrame(predictor.predict(list(texts)), columns=["lang_pred", "score"])

    return score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = F.pandas_udf(_scorer(shared), "lang_pred string, score double")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(common.bucket_of(id_col, 4) == 2, F.lit(False)).alias("held_out"), scored(F.col(text_col)).alias("__p"))
    return rows.select("doc_id", "held_out", "__p.lang_pred", "__p.score")
