r"""Importance resampling towards a target distribution, by hashed n-grams of words.

The CRC-32 of each word is computed once; that of an n-gram is composed from those of its words:
appending m bytes multiplies a CRC by x**(8m) in GF(2)[x], a 32 x 32 bit matrix, and
crc(a + b) = shift(crc(a), len(b)) ^ crc(b). No n-gram is ever spelled out.

A first pass counts the buckets of all documents and of all target texts; a task sends each of
its buckets once. The gain of a bucket is its scaled log ratio of smoothed frequencies, one table
of ``buckets`` numbers. A second pass sums gains over a document's n-grams; its weight is their
floored mean. Gumbel noise from a digest of the id turns weights into a draw without replacement:
the highest scores among the documents of ``min_words`` words or more, ranked by ranges.

Whole texts are read, in pieces that repeat the last n-1 words, so a very long text needs no more
memory than a few times its bytes. A null text has no words, no features and weight 0. A
null id counts as an empty one. Of equal scores the smaller id comes first, null last; repeated
rows are documents of their own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ranges

POLYNOMIAL = 0xEDB88320
#: Bytes of texts that are worked on at once; words beyond WORD bytes are digested by zlib.
PIECE, WORD = 1 << 21, 64
SCALE = 1000


def _byte_step() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (table & np.uint32(1)))
    return table


STEP = _byte_step()
CODES = np.arange(256)
LOWER = np.where((CODES >= 65) & (CODES <= 90), CODES + 32, CODES).astype(np.uint8)
IN_WORD = ((CODES >= 48) & (CODES <= 57)) | ((CODES >= 65) & (CODES <= 90)) | ((CODES >= 97) & (CODES <= 122)) | (CODES >= 128)


def times(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
    """GF(2) matrix (32 columns as integers) times each of ``v``."""
    out = np.zeros(len(v), np.uint32)
    for k in range(32):
        out ^= columns[k] * ((v >> np.uint32(k)) & np.uint32(1))
    return out


def one_byte() -> np.ndarray:
    """The matrix that appends one zero byte."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return STEP[unit & np.uint32(255)] ^ (unit >> np.uint32(8))


class Shift:
    """Appends zero bytes to CRCs: a byte-wise table for each short length, powers of two beyond."""

    def __init__(self, short: int = WORD + 2):
        byte, matrix = one_byte(), np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.tables = np.empty((short, 4, 256), np.uint32)
        for n in range(short):
            for b in range(4):
                self.tables[n, b] = times(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * b))
            matrix = times(byte, matrix)
        self.powers = [byte]
        for _ in range(40):
            self.powers.append(times(self.powers[-1], self.powers[-1]))

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        short = np.minimum(length, len(self.tables) - 1)
        out = self.tables[short, 0, crc & np.uint32(255)]
        for b in range(1, 4):
            out = out ^ self.tables[short, b, (crc >> np.uint32(8 * b)) & np.uint32(255)]
        for at in np.flatnonzero(length >= len(self.tables)):
            c, n = crc[at : at + 1], int(length[at])
            for k in range(n.bit_length()):
                if n >> k & 1:
                    c = times(self.powers[k], c)
            out[at] = c[0]
        return out


_shift: Shift | None = None


def shift() -> Shift:
    global _shift
    _shift = _shift or Shift()
    return _shift


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: all words advance byte by byte together, the longest first."""
    falling = -np.minimum(lengths, WORD)
    order = np.argsort(falling, kind="stable")
    at, falling = starts[order], falling[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(-int(falling[0]) if len(at) else 0):
        m = int(np.searchsorted(falling, -k))
        s = state[:m]
        state[:m] = STEP[(s ^ data[at[:m] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = ~state
    for j in np.flatnonzero(lengths > WORD):
        out[j] = zlib.crc32(data[starts[j] : starts[j] + lengths[j]].tobytes())
    return out


def pieces(texts: list[bytes | None], order: int) -> Iterator[tuple[int, bytes, int]]:
    """(row, bytes, words to skip): texts, long ones cut between words, with the last order-1 words again."""
    for row, text in enumerate(texts):
        if text is None or len(text) <= PIECE:
            yield row, text or b"", 0
            continue
        inside = IN_WORD[np.frombuffer(text, np.uint8)]
        gaps, begins = np.flatnonzero(~inside), np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
        at, first, skip = 0, 0, 0
        while at < len(text):
            # A piece ends behind a word and holds more words than the next one repeats.
            least = begins[first + order] if first + order < len(begins) else len(text)
            cut = int(np.searchsorted(gaps, max(at + PIECE, least)))
            end = int(gaps[cut]) if cut < len(gaps) else len(text)
            yield row, text[at:end], skip
            last = int(np.searchsorted(begins, end))
            skip = order - 1
            first = last - skip
            at = int(begins[first]) if skip and end < len(text) else end


def ngrams(texts: list[bytes | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For groups of texts: row of each word, whether it counts, and (CRCs, whether they exist) for 1 to ``order`` words that end with it."""
    group, size = [], 0
    for piece in pieces(texts, order):
        group.append(piece)
        size += len(piece[1])
        if size >= PIECE:
            yield _ngrams(group, order)
            group, size = [], 0
    if group:
        yield _ngrams(group, order)


def _ngrams(group: list[tuple[int, bytes, int]], order: int):
    data = LOWER[np.frombuffer(b"\n".join(p[1] for p in group) + b"\n", np.uint8)]
    ends_of = np.cumsum([len(p[1]) + 1 for p in group])
    edge = np.flatnonzero(np.diff(IN_WORD[data].astype(np.int8), prepend=0, append=0))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    of = np.searchsorted(ends_of, starts, "right")
    crc = word_crcs(data, starts, lengths)
    first = np.concatenate([[0], np.searchsorted(of, np.arange(1, len(group)), "left")]) if len(group) else np.zeros(0, int)
    nth = np.arange(len(starts)) - first[of] if len(starts) else np.zeros(0, int)
    new = nth >= np.array([p[2] for p in group])[of] if len(starts) else np.zeros(0, bool)
    blank = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = shift()(blank, lengths) ^ crc
    grams, last = [(crc, new)], crc
    for k in range(1, order):
        last = np.concatenate([last[:1], shift()(last[:-1], lengths[1:] + 1) ^ spaced[1:]])
        grams.append((last, new & (nth >= k)))
    return np.array([p[0] for p in group])[of] if len(starts) else np.zeros(0, int), new, grams


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def bucket_counts(rows: DataFrame, text_col: str, order: int, buckets: int) -> DataFrame:
    """(bucket, n) over all n-grams of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, grams in ngrams(_bytes(batch.column(0)), order):
                for crc, ok in grams:
                    counts += np.bincount((crc[ok] % np.uint32(buckets)).astype(np.int64), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    parts = rows.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", order: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Scaled log ratio of smoothed frequencies, target to documents, for each bucket; ``buckets`` numbers in all."""
    tables = []
    for rows, col in ((docs, text_col), (target, target_col)):
        counts = [0] * buckets
        for r in bucket_counts(rows, col, order, buckets).collect():
            counts[r["bucket"]] = r["n"]
        tables.append(counts)
    s, t = tables
    all_s, all_t = sum(s), sum(t)
    ratio = lambda a, b: ((b + 1.0) * (all_s + buckets)) / ((a + 1.0) * (all_t + buckets))
    return np.array([math.floor(SCALE * math.log(ratio(a, b))) for a, b in zip(s, t, strict=True)], np.int64)


def weights(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    buckets = np.uint32(len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            words, features, total = (np.zeros(m, np.int64) for _ in range(3))
            for row, new, grams in ngrams(_bytes(batch.column(1)), order):
                words += np.bincount(row[new], minlength=m)
                for crc, ok in grams:
                    features += np.bincount(row[ok], minlength=m)
                    total += np.bincount(row[ok], table[crc[ok] % buckets], m).astype(np.int64)
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """Scaled Gumbel noise from 32 bits of a digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Adds score and rank to (doc_id, n_words, n_features, weight); rank is null where a row is not drawn."""
    rows = common.stored(scored.withColumn("score", F.col("weight") + noise("doc_id", seed)))
    enough = F.col("n_words") >= min_words
    drawn = percent * rows.filter(enough).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    ranked = ranges.running(ranges.by_ranges(rows.filter(enough), *order), F.lit(1), order, out="__rank")
    rank = (F.col("__rank") + 1).cast("long")
    ranked = ranked.withColumn("rank", F.when(rank <= drawn, rank)).drop("__rank", ranges.PART)
    return ranked.unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document."""
    common.tune(docs.sparkSession)
    return draw(weights(docs, gains(docs, target, text_col, target_col, order, buckets), id_col, text_col, order), percent, min_words, seed)
