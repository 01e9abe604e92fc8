"""Benchmark decontamination by pigeonhole edit matching.

A test item of m code points may be hit with up to k edits. It is split into k + 1 pieces, so
that a passage within k edits contains one piece unchanged. One Aho-Corasick automaton finds
all piece hits of a text in one pass, hits of an item are merged into windows, and each window
is verified with Myers' bit-parallel distance. Where pieces are shorter than ``min_piece``, an
item is split into k + 2, of which a passage contains two unchanged, moved apart by k at most.

Texts and items are compared after lower-casing and folding every run of white space to one
space. The budget k is ``rate`` of the item's length, rounded down; ``min_piece`` never lowers
it. The test set is the stated query set: it is read in blocks of bounded size,
each broadcast and run against all rows. Null, empty and white-space texts and items match
nothing; repeated rows and items each give their own results; empty tables give none.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of test items in one broadcast block.
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id long, item_id long, start long, end long, distance int"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, rate: float, min_piece: int = 1) -> int:
    """Edits allowed; ``min_piece`` has no say in it, see ``unchanged``."""
    return int(length * rate)


def unchanged(length: int, k: int, min_piece: int) -> int:
    """Unchanged pieces asked for before a window is verified; the item has k more pieces."""
    return 1 if k == 0 or k + 2 > length or length // (k + 1) >= min_piece else 2


def anchors(hits: set[tuple[int, int]], asked: int, k: int) -> list[int]:
    """Places of an item, from hits (place, offset), where ``asked`` hits lie at most k apart."""
    at = sorted(hits)
    near = {j + i for j in range(len(at) - asked + 1) if at[j + asked - 1][0] - at[j][0] <= k for i in range(asked)}
    return sorted({at[j][0] for j in near})


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 nearly equal pieces."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the best match of a pattern inside ``text``; the first end of equals."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = pattern_bits.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hp = vn | (full & ~(d0 | vp))
        hn = vp & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp = hn | (full & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, at
    return best, end


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, min_piece: int):
        import ahocorasick

        if not 0 <= rate < 1:
            raise ValueError(f"rate {rate}; pieces need 0 <= rate < 1")
        self.items, self.tree = [], ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normal(text)
            if item:
                k = budget(len(item), rate, min_piece)
                asked = unchanged(len(item), k, min_piece)
                for offset, piece in pieces(item, k + asked - 1):
                    found.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, item, k, asked, bits(item)))
        for piece, owners in found.items():
            self.tree.add_word(piece, (len(piece), owners))
        self.tree.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) in code points of the normalised text."""
        text, starts = normal(text), {}
        if not text or not self.items:
            return []
        for last, (length, owners) in self.tree.iter(text):
            for item, offset in owners:
                starts.setdefault(item, set()).add((last - length + 1 - offset, offset))
        out = []
        for item in sorted(starts):
            item_id, pattern, k, asked, peq = self.items[item]
            m, windows = len(pattern), []
            for s in anchors(starts[item], asked, k):
                lo, hi = max(0, s - k), min(len(text), s + m + k)
                if windows and lo <= windows[-1][1] and s - windows[-1][2] <= 2 * k:
                    windows[-1][1], windows[-1][2] = hi, s
                else:
                    windows.append([lo, hi, s])
            for lo, hi, _ in windows:
                if hi - lo >= m - k:
                    distance, end = (0, text.find(pattern, lo, hi) - lo + m) if text.find(pattern, lo, hi) >= 0 else myers(peq, m, text[lo:hi])
                    hit = (item_id, max(0, lo + end - m), lo + end, distance)
                    if distance <= k and (not out or hit != out[-1]):
                        out.append(hit)
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The test set in blocks of bounded size; one row is on the driver at a time otherwise."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).orderBy(item_col, text_col).toLocalIterator():
        if row[1]:
            if block and size + len(row[1]) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((row[0], row[1]))
            size += len(row[1])
    yield block


def _per_block(docs: DataFrame, benchmark: DataFrame, item_col: str, bench_text: str, rate: float, min_piece: int):
    common.tune(docs.sparkSession)
    for block in _blocks(benchmark, item_col, bench_text):
        yield docs.sparkSession.sparkContext.broadcast((block, rate, min_piece))


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", rate: float = 0.1, min_piece: int = 16) -> DataFrame:
    """A row (doc_id, item_id, start, end, distance) for each test item found in each text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    out = None
    for shared in _per_block(docs, benchmark, item_col, bench_text, rate, min_piece):
        found = rows.mapInPandas(_scan(shared), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", rate: float = 0.1, min_piece: int = 16) -> DataFrame:
    """Rows whose text contains no test item; columns as they came."""
    out = docs
    for shared in _per_block(docs, benchmark, item_col, bench_text, rate, min_piece):
        out = out.filter(F.pandas_udf(_clean(shared), "boolean")(F.col(text_col)))
    return out


def _clean(shared):
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*shared.value)
        for texts in batches:
            yield pd.Series([not matcher.matches(t) for t in texts], dtype="bool")

    return clean


def _scan(shared):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(*shared.value)
        for batch in batches:
            found = [(doc, *hit) for doc, text in zip(batch["doc_id"], batch["__text"], strict=True) for hit in matcher.matches(text)]
            frame = pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end", "distance"])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    return scan
