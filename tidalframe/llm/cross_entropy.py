r"""LM scoring by cross-entropy difference.

A target model and a background model over one shared, open vocabulary are counted over the
whole corpus: the target over rows with the wanted label, the background over all rows. A
document's score is the mean over its tokens of the difference of their losses in bits; low
values mark text like the target.

A token is a lower-cased run of letters and digits, or a sign (``\w+|[^\w\s]``). Both models
have the same levels. Words lean by Witten-Bell on a spelling model, a bigram model of UTF-8
bytes that gives every word of any script a probability:

    p(w) = (count(w) + kinds * spelling(w)) / (tokens + kinds)

With ``contexts``, a token is predicted from the one before it (or the text's beginning). Each
of the most frequent ``contexts`` words is a class of its own, all other words are one more
class, in which a word has its share as above, over the tokens of that class:

    p(k | v) = (count(v, k) + follow(v) * q(k)) / (count(v) + follow(v))
    q(k) = (count(k) + 1) / (tokens + classes)
    p(w | v) = p(k | v), times (count(w) + kinds * spelling(w)) / (count(others) + kinds)

the latter for words of the class of others; follow(v) counts the classes seen after v. The
spelling model also spends a little on words with a class of their own, which is lost.

A document is left out of the models that score it: its own words and pairs are taken off the
counts of the background, and of the target if it belongs to it (kinds and follow stay). So a
document that occurs twice, or shares its rare words with others, is told from one that stands
alone.

Scale. Words have no cap: the counts of all words, and of all pairs of classes, are tables in
the shared folder that grow with the corpus. Their most frequent rows, ``HEAD_WORDS`` and
``HEAD_PAIRS`` at most, are broadcast (24 bytes each) and scored where the texts are, which is
only a matter of speed; a document's other words and pairs are sent to the tables, once each
with their number, and their losses come back summed up. What is frequent follows from a
histogram of counts, so nothing is sorted. Texts are taken apart ``SLICE_CHARS`` code points at
a time (a longer text by itself).

Null and empty texts have no tokens and null losses. Whole texts count, however long. Repeated
rows count as often as they occur and score alike. Without any target row the target model is
its untrained spelling model. An empty table gives an empty result; extra columns are not read.
Words are named by 64-bit hashes.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words and pairs that are broadcast at most; words and pairs that a task holds before it sends its counts.
HEAD_WORDS, HEAD_PAIRS, TASK_WORDS, TASK_PAIRS = 500_000, 1_000_000, 200_000, 2_000_000
#: Code points that are taken apart at once.
SLICE_CHARS = 2_000_000
#: Ids of target rows that are broadcast at most when counting; beyond, texts are shuffled once by their ids.
BROADCAST_IDS = 2_000_000
#: Bytes, and the boundary before and after a word.
SYMBOLS, BOUNDARY = 257, 256
WORD, SPELLING, PAIR = 0, 1, 2
#: Steps of a doubling in the histogram that tells what is frequent.
STEPS = 64
#: A base of hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 0 for white space, 1 for letters and digits, 2 for signs."""
    return np.array([0 if c.isspace() else 1 if c.isalnum() or c == "_" else 2 for c in map(chr, range(0x110000))], np.uint8)


@lru_cache(2)
def _powers(base: int, length: int) -> np.ndarray:
    out = np.full(length, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Tokens:
    """The tokens of some texts in order: ``of`` their text, ``which`` of the distinct ``words``, whose hashes are ``names``."""

    of: np.ndarray
    which: np.ndarray
    words: list[str]
    names: np.ndarray


def tokens_of(texts: list[str | None]) -> Tokens:
    """Tokens by the places where kinds of signs change; a token's hash is a difference of running sums."""
    lower = [t.lower() if t else "" for t in texts]
    line = " ".join(lower) + " "
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    word = kind == 1
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    s, e = np.flatnonzero(start | (kind == 2)), np.flatnonzero(end | (kind == 2)) + 1
    size = 1 << max(16, int(len(codes) - 1).bit_length())
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[: len(codes)], out=sums[1:])
    h = (sums[e] - sums[s]) * _powers(INVERSE, size)[s]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    names, first, which = np.unique((h ^ (h >> np.uint64(29))).view(np.int64), return_index=True, return_inverse=True)
    ends = np.cumsum([len(t) + 1 for t in lower])
    return Tokens(np.searchsorted(ends, s, "right"), which, [line[i:j] for i, j in zip(s[first].tolist(), e[first].tolist(), strict=True)], names)


def slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows of ``SLICE_CHARS`` code points at most, or of one row."""
    at, held = 0, 0
    for k, n in enumerate(len(t or "") for t in batch["__text"]):
        if k > at and held + n > SLICE_CHARS:
            yield batch.iloc[at:k]
            at, held = k, 0
        held += n
    if at < len(batch):
        yield batch.iloc[at:]


def byte_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte bigrams of all words, boundaries included, and where each word starts."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(b) + 1 for b in raw], np.int64)
    starts = np.cumsum(lengths) - lengths
    left, right = np.full(lengths.sum(), BOUNDARY, np.int64), np.full(lengths.sum(), BOUNDARY, np.int64)
    at = np.ones(lengths.sum(), bool)
    at[starts] = False
    data = np.frombuffer(b"".join(raw), np.uint8)
    left[at] = data
    right[np.roll(at, -1)] = data
    return left * SYMBOLS + right, starts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, key, background, target): words, and byte bigrams of all their occurrences."""
    every, wanted, names = Counter(), Counter(), {}

    def flush() -> pd.DataFrame:
        words = list(every)
        n, t = np.array([every[w] for w in words], np.int64), np.array([wanted[w] for w in words], np.int64)
        cells, starts = byte_pairs(words)
        lengths = np.diff(np.append(starts, len(cells)))
        size = SYMBOLS * SYMBOLS
        n_cells, t_cells = (np.bincount(cells, np.repeat(x, lengths), size).astype(np.int64) for x in (n, t))
        used = np.flatnonzero(n_cells)
        every.clear()
        wanted.clear()
        out = pd.DataFrame(
            {
                "kind": np.repeat(np.array([WORD, SPELLING], np.int32), [len(words), len(used)]),
                "key": np.concatenate((np.array([names[w] for w in words], np.int64), used)),
                "background": np.concatenate((n, n_cells[used])),
                "target": np.concatenate((t, t_cells[used])),
            }
        )
        names.clear()
        return out

    for batch in batches:
        for part in slices(batch):
            own = tokens_of(list(part["__text"]))
            good = part["__target"].to_numpy(bool)[own.of]
            size = len(own.words)
            every.update(dict(zip(own.words, np.bincount(own.which, minlength=size).tolist(), strict=True)))
            wanted.update(dict(zip(own.words, np.bincount(own.which[good], minlength=size).tolist(), strict=True)))
            names.update(zip(own.words, own.names.tolist(), strict=True))
            if len(every) >= TASK_WORDS:
                yield flush()
    if every:
        yield flush()


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in the sorted keys, and whether it does."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def classes(own: Tokens, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token and of the one before it; ``len(keys)`` are other words, one more is a text's beginning."""
    at, known = places(keys, own.names)
    after = np.where(known, at, len(keys))[own.which]
    before = np.roll(after, 1)
    before[np.flatnonzero(np.diff(own.of, prepend=-1))] = len(keys) + 1
    return before, after


def _count_pairs(shared):
    """(kind, key, background, target) of pairs of classes; key is before * (classes + 2) + after."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held, rows = shared.value, [], 0

        def flush() -> pd.DataFrame:
            key, n, t = (np.concatenate(c) for c in zip(*held, strict=True))
            found, which = np.unique(key, return_inverse=True)
            held.clear()
            return pd.DataFrame({"kind": np.int32(PAIR), "key": found, "background": np.bincount(which, n).astype(np.int64), "target": np.bincount(which, t).astype(np.int64)})

        for batch in batches:
            for part in slices(batch):
                own = tokens_of(list(part["__text"]))
                before, after = classes(own, keys)
                key, which = np.unique(before * (len(keys) + 2) + after, return_inverse=True)
                held.append((key, np.bincount(which, minlength=len(key)), np.bincount(which, part["__target"].to_numpy(bool)[own.of], len(key))))
                rows += len(key)
                if rows >= TASK_PAIRS:
                    yield flush()
                    rows = 0
        if rows:
            yield flush()

    return count


def log_model(counts: np.ndarray, size: int) -> np.ndarray:
    """log2 p(right | left) by Witten-Bell from counts of (left, right), down to the uniform distribution."""
    single = counts.sum(axis=0)
    kinds = (single > 0).sum()
    lower = (single + kinds / size) / (single.sum() + kinds) if kinds else np.full(size, 1.0 / size)
    total, follow = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    return np.log2(np.where(total > 0, (counts + follow * lower) / np.maximum(total + follow, 1), lower))


@dataclass
class Side:
    """One model without its words: tokens, kinds of words, and log2 of the byte bigrams."""

    tokens: int
    kinds: int
    spelling: np.ndarray


@dataclass
class Contexts:
    """Classes by the sorted hashes of their words. By class (others and the beginning last) and side: tokens, pairs that begin with it, classes that follow it."""

    keys: np.ndarray
    tokens: tuple[np.ndarray, np.ndarray]
    begun: tuple[np.ndarray, np.ndarray]
    follow: tuple[np.ndarray, np.ndarray]
    head: tuple[np.ndarray, np.ndarray, np.ndarray]  # of pairs: key (sorted), background, target


@dataclass
class Models:
    counts: DataFrame  # kind, key, background, target of every word, and of every pair
    ids: DataFrame  # __id of the target's documents
    head: tuple[np.ndarray, np.ndarray, np.ndarray]  # of words: key (sorted), background, target
    background: Side
    target: Side
    contexts: Contexts | None = None


def frequent(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, background, target) of the most frequent rows by the background, ``most`` at most, sorted by key."""
    step = F.floor(F.log2("background") * STEPS).cast("int")
    sizes = rows.filter("background > 0").groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()
    least, held = None, 0
    for s, c in sorted(((r["s"], r["c"]) for r in sizes), reverse=True):
        held += c
        if held > most:
            break
        least = s
    top = rows.filter((F.col("background") > 0) & (step >= least) if least is not None else F.lit(False))
    top = top.select("key", "background", "target").toArrow()
    key, *counts = (top[c].to_numpy().astype(np.int64) for c in ("key", "background", "target"))
    order = np.argsort(key)
    return key[order], *(c[order] for c in counts)


def _contexts(marked: DataFrame, words: DataFrame, sums, most: int) -> tuple[Contexts, DataFrame]:
    keys, *own = frequent(words, most)
    size = len(keys) + 2
    pairs = marked.mapInPandas(_count_pairs(marked.sparkSession.sparkContext.broadcast(keys)), "kind int, key long, background long, target long")
    pairs = common.stored(pairs.groupBy("kind", "key").agg(F.sum("background").alias("background"), F.sum("target").alias("target")))
    begun = pairs.groupBy(F.expr(f"key div {size}").alias("v")).agg(*[f for c in ("background", "target") for f in (F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"k_{c}"))]).toArrow()
    dense = lambda c: np.bincount(begun["v"].to_numpy().astype(int), begun[c].to_numpy(), size)
    tokens = tuple(np.append(n, [int(sums[2 * k] or 0) - n.sum(), 0]) for k, n in enumerate(own))
    return Contexts(keys, tokens, (dense("n_background"), dense("n_target")), (dense("k_background"), dense("k_target")), frequent(pairs, HEAD_PAIRS)), pairs


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", wanted: int = 1, contexts: int = 0) -> Models:
    """Count both models over all rows; the target is the rows labelled ``wanted``. ``contexts``: words with a class of their own, 0 for words without context."""
    common.tune(docs.sparkSession)
    ids = common.stored(labels.filter((F.col(label_col) == wanted) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id")).distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text")).filter(F.length("__text") > 0)
    marks = ids.withColumn("__target", F.lit(True))
    few = F.broadcast(marks) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else marks
    marked = rows.join(few, F.col("__doc") == F.col("__id"), "left").select("__text", F.coalesce("__target", F.lit(False)).alias("__target"))
    counted = marked.mapInPandas(_count, "kind int, key long, background long, target long")
    table = common.stored(counted.groupBy("kind", "key").agg(F.sum("background").alias("background"), F.sum("target").alias("target")))
    words = table.filter(F.col("kind") == WORD)
    cells = table.filter(F.col("kind") == SPELLING).toArrow()  # SYMBOLS ** 2 rows at most
    sums = words.agg(*[f for c in ("background", "target") for f in (F.sum(c), F.count_if(F.col(c) > 0))]).first()
    sides = []
    for k, column in enumerate(("background", "target")):
        dense = np.zeros(SYMBOLS * SYMBOLS)
        dense[cells["key"].to_numpy().astype(np.int64)] = cells[column].to_numpy().astype(float)
        sides.append(Side(int(sums[2 * k] or 0), int(sums[2 * k + 1] or 0), log_model(dense.reshape(SYMBOLS, SYMBOLS), SYMBOLS).reshape(-1).astype(np.float32)))
    found, pairs = _contexts(marked, words, sums, contexts) if contexts else (None, None)
    return Models(words if pairs is None else words.unionByName(pairs), ids, frequent(words, HEAD_WORDS), *sides, found)


def log_plus(count: np.ndarray, worn: np.ndarray) -> np.ndarray:
    """log2 of count + 2 ** worn."""
    with np.errstate(divide="ignore"):
        return np.logaddexp2(np.log2(np.asarray(count, float)), worn)


WHOLE, LATE = ["doc", "n", "sum_b", "sum_t", "sum_u"], ["kind", "key", "times", "b", "t", "u"]


def _score(shared, leave_out: bool):
    """Rows of documents (key null) with sums over what is broadcast; and of each other word and pair with its number.

    ``t`` is the target without the document, ``u`` the target as it is. ``b``, ``t``, ``u`` of a
    word or pair are logarithms of what is added to its count.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, background, target, contexts = shared.value
        sides = ((background, 0, leave_out), (target, 1, leave_out), (target, 1, False))

        def meet(kind: int, table, of, key, n, worn, sums) -> pd.DataFrame:
            """Adds what the table's head holds to the sums; the rest as rows."""
            at, known = places(table[0], key)
            k, late = at[known], ~known
            for total, (_, side, out), w in zip(sums, sides, worn, strict=True):
                count = np.maximum(table[1 + side][k] - (n[known] if out else 0), 0)
                total += np.bincount(of[known], n[known] * log_plus(count, w[known]), len(total))
            rows = {"row": of[late], "kind": np.full(late.sum(), kind, np.int32), "key": key[late], "times": n[late]}
            return pd.DataFrame(rows | {c: w[late].astype(np.float32) for c, w in zip("btu", worn, strict=True)})

        for part in (p for batch in batches for p in slices(batch)):
            own, size = tokens_of(list(part["__text"])), len(part)
            row, doc = part["__row"].to_numpy(np.int64), part["__doc"].to_numpy(object)
            tokens, sums, late = np.bincount(own.of, minlength=size), [np.zeros(size) for _ in sides], []
            of, which = own.of, own.which
            if contexts is not None and len(of):
                others = len(contexts.keys)
                before, after = classes(own, contexts.keys)
                mine, times = np.unique(own.of * (others + 2) + after, return_counts=True)
                key, n = np.unique(own.of * (others + 2) ** 2 + before * (others + 2) + after, return_counts=True)
                at, v, k = key // (others + 2) ** 2, key // (others + 2) % (others + 2), key % (others + 2)
                runs = np.flatnonzero(np.diff(key // (others + 2), prepend=-1))
                begun = np.repeat(np.add.reduceat(n, runs), np.diff(np.append(runs, len(n))))
                same = times[np.searchsorted(mine, at * (others + 2) + k)]
                in_others = np.bincount(own.of[after == others], minlength=size)
                worn = []
                for total, (side, s, out) in zip(sums, sides, strict=True):
                    less = 1 if out else 0
                    follow = np.maximum(contexts.follow[s][v], 1)
                    q = (np.maximum(contexts.tokens[s][k] - less * same, 0) + 1) / (np.maximum(side.tokens - less * tokens[at], 0) + others + 1)
                    worn.append(np.log2(follow * q))
                    total -= np.bincount(at, n * np.log2(np.maximum(contexts.begun[s][v] - less * begun, 0) + follow), size)
                    total -= in_others * np.log2(np.maximum(contexts.tokens[s][others] - less * in_others, 0) + max(side.kinds, 1))
                late.append(meet(PAIR, contexts.head, at, key % (others + 2) ** 2, n, worn, sums))
                of, which = of[after == others], which[after == others]
            if len(of):
                cells, starts = byte_pairs(own.words)
                pair, n = np.unique(of * len(own.words) + which, return_counts=True)
                of, which = pair // len(own.words), pair % len(own.words)
                b, t = (np.log2(max(side.kinds, 1)) + np.add.reduceat(side.spelling[cells], starts, dtype=float)[which] for side in (background, target))
                late.append(meet(WORD, head, of, own.names[which], n, (b, t, t), sums))
            yield pd.DataFrame({"row": row, "doc": doc, "n": tokens} | dict(zip(WHOLE[2:], sums, strict=True))).reindex(columns=["row", *WHOLE, *LATE])
            for rows in late:
                if len(rows):
                    yield rows.assign(row=row[rows["row"].to_numpy()], doc=np.full(len(rows), None)).reindex(columns=["row", *WHOLE, *LATE])

    return scan


def scores(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", leave_out: bool = True) -> DataFrame:
    """(doc_id, n_tokens, h_target, h_background, difference): bits a token, target minus background.

    ``leave_out=False`` is for texts that the models did not count.
    """
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((models.head, models.background, models.target, models.contexts))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("long").cast("string").alias("__doc"), F.col(text_col).alias("__text"))
    schema = "row long, doc string, n long, sum_b double, sum_t double, sum_u double, kind int, key long, times long, b float, t float, u float"
    seen = common.stored(rows.mapInPandas(_score(shared, leave_out), schema))
    late = seen.filter(F.col("key").isNotNull()).select("row", *LATE)
    # Sums in logarithms, as a long word's spelling may underflow.
    gain = lambda count, worn: f"CASE WHEN {count} > 0 THEN log2({count} + pow(2D, {worn})) ELSE {worn} END"
    less = "times" if leave_out else "0L"
    gains = (gain(f"greatest(coalesce(background, 0L) - {less}, 0L)", "b"), gain(f"greatest(coalesce(target, 0L) - {less}, 0L)", "t"), gain("coalesce(target, 0L)", "u"))
    back = late.join(models.counts, ["kind", "key"], "left").groupBy("row").agg(*[F.sum(F.col("times") * F.expr(x)).alias(f"late_{c}") for x, c in zip(gains, "btu", strict=True)])
    whole = seen.filter(F.col("key").isNull()).select("row", *WHOLE).withColumn("doc", F.col("doc").cast("long"))
    whole = whole.join(back, "row", "left").join(models.ids, F.col("doc") == F.col("__id"), "left")
    inside, n = F.col("__id").isNotNull(), F.col("n")
    own = n if leave_out else F.lit(0)

    def loss(side: Side, mine, column):
        # With contexts the totals are those of each context, and are in the sums.
        total = F.lit(0.0) if models.contexts else F.log2(F.greatest(F.lit(side.tokens) - mine, F.lit(0)) + F.lit(max(side.kinds, 1)))
        return F.when(n > 0, total - (F.col(f"sum_{column}") + F.coalesce(F.col(f"late_{column}"), F.lit(0.0))) / n)

    return whole.select(
        F.col("doc").alias("doc_id"),
        n.alias("n_tokens"),
        F.when(inside, loss(models.target, own, "t")).otherwise(loss(models.target, F.lit(0), "u")).alias("h_target"),
        loss(models.background, own, "b").alias("h_background"),
    ).withColumn("difference", F.col("h_target") - F.col("h_background"))
