"""Whitening, mixing and importance resampling against plain Python and numpy versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidalframe.llm import common, importance, mixing, queries, whitening

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None, "b"), (2, "", "b"), (3, " \t\n", None), (4, "One", "a"), (5, "one two", None), (6, "word " * 5000, "ä"), (7, "same text here", "a"), (7, "same text here", "a"), (None, "no id", "b"), (9, "ÄÖ \U0001f600 é", "B"), (10, "x\x00y z", "")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in ODD], "doc_id long, text string, source string, size long, ord string")


# Whitening.


def brute_whitening(vectors):
    """(n, deviations, whitened, explained) by numpy, in exact integers as far as they go."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:32]
    return n, [sum(int(v) ** 2 for v in row) for row in (n * x.astype(object) - s.astype(object))], centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def held_against(rows, ids, vectors):
    n, deviation, want, explained = brute_whitening(vectors)
    k = want.shape[1]
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    assert len(rows) == n * k and {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1
    got = np.array([r["whitened"] for r in rows]).reshape(n, k)
    order = np.argsort(ids)
    assert [r["deviation"] for r in rows][::k] == [deviation[j] for j in order]
    assert np.allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-9)
    signs = np.sign((got * want[order]).sum(axis=0))
    assert np.abs(got * signs - want[order]).max() < 1e-7
    cov = got.T @ got / n - np.outer(got.mean(0), got.mean(0))
    assert np.abs(cov - np.eye(k)).max() <= 1e-4 and rows[0]["identity_error"] == pytest.approx(np.abs(cov - np.eye(k)).max(), abs=1e-9)


def test_whitening_real(spark):
    table = common.table(spark, DATA, "embeddings").collect()
    held_against(queries.op11_whitening(spark, DATA).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_whitening_finds_a_steep_spectrum_without_expansion(spark):
    """Falling eigenvalues: the range finder's residuals vanish and the block is not expanded; numbers near a flat spectrum expand it."""
    random, d = np.random.default_rng(0), 60
    basis = np.linalg.qr(random.normal(size=(d, d)))[0]
    x = random.normal(size=(400, d)) * 40.0 ** -np.arange(d) @ basis.T * 1e6
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = whitening.integers(df, "vec_id", "embedding").cache()
    model = whitening.fit(rows, components=3, oversample=4, passes=6)
    assert not model["expanded"] and model["identity_error"] < 1e-6
    n, _, want, explained = brute_whitening(x)
    assert np.allclose(model["explained"], explained[:3], rtol=1e-9)
    got = np.array([r["whitened"] for r in whitening.whiten(rows, model).orderBy("vec_id", "component").collect()]).reshape(n, 3)
    assert np.abs(np.abs(got) - np.abs(want[:, :3])).max() < 1e-6
    assert whitening.fit(rows, components=20, oversample=4, passes=1)["expanded"]


def test_whitening_odd_rows(spark):
    """Nulls, non-finite entries, other lengths, repeated rows and null ids; a constant dimension has no component."""
    random = np.random.default_rng(1)
    good = [(k, [*random.normal(size=5).tolist(), 0.25]) for k in range(20)]
    bad = [(50, None), (51, [1.0] * 5 + [None]), (52, [float("nan")] + [1.0] * 5), (53, [float("inf")] + [1.0] * 5), (54, [1.0, 2.0]), (55, []), (56, [1e300] + [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in [*good, *good[:3], (None, good[4][1]), *bad]], "vec_id long, embedding array<double>, component double")
    rows = whitening.whitened(df).collect()
    assert len(rows) == 24 * 5 and {r["n"] for r in rows} == {24} and {r["vec_id"] for r in rows} == {*range(20), None}
    assert rows[0]["identity_error"] < 1e-9
    assert whitening.whitened(df.limit(0)).collect() == [] and len(whitening.whitened(df.limit(1)).collect()) == 0


def test_whitening_counts_exactly():
    """Deviations in exact integers, null beyond a long."""
    x = np.array([[2**46, 5], [-(2**46), 7], [0, 9]], np.int64)
    centre = whitening.Centre(3, [int(v) for v in x.astype(object).sum(axis=0)])
    want = [sum((3 * int(v) - int(s)) ** 2 for v, s in zip(row, x.astype(object).sum(axis=0), strict=True)) for row in x]
    assert centre.deviations(x) == [w if w < 2**63 else None for w in want] and None in centre.deviations(x)


# Mixing.


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and left / rest * weight[s] > 3 * size[s]} if rest else set()
        if not more:
            return {s: 3.0 * size[s] if s in full else min(3.0 * size[s], left / rest * weight[s]) for s in names}
        full |= more


def brute_mix(rows):
    size = Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    streams = defaultdict(list)
    for i, t, s in rows:
        size[s] += words(t)
        streams[s].append((int(hashlib.md5(f"12:{'' if i is None else i}".encode()).hexdigest()[:15], 16), (i is not None, i), words(t)))
    target, out = brute_targets(size), []
    for s, docs in streams.items():
        quota, at = math.floor(target[s] + 0.5), 0
        for _, (_, i), n in sorted(docs):
            took = sum(max(0, min(quota, at + p * size[s] + n) - (at + p * size[s])) for p in range(3)) if n else 0
            out.append((i, n, size[s], round(target[s], 6), took))
            at += n
    return Counter(out)


def mixed(df, **settings):
    rows = mixing.taken(mixing.segments(df, **settings))
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows.collect())


def test_mixing_real_and_odd(spark, odd):
    docs = common.table(spark, DATA, "documents")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert mixed(docs) == brute_mix(rows) == mixed(docs, block_words=37)
    assert mixed(odd, block_words=3) == brute_mix(ODD)
    assert not mixed(odd.limit(0)) and mixed(odd.filter("doc_id < 3")) == brute_mix([r for r in ODD if r[0] in (1, 2)])


def test_mixing_schedule(spark, monkeypatch):
    """Slots are filled whole, every prefix of the schedule holds the sources near their shares, and small parts and chunks change nothing."""
    random = np.random.default_rng(2)
    rows = [(k, "w " * int(random.integers(1, 60)), f"s{min(3, int(random.integers(0, 8)))}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts = [r.asDict() for r in mixing.segments(df, block_words=16).collect()]
    by_slot, source = Counter(), {}
    for r in parts:
        if r["slot"] is not None:
            by_slot[r["slot"]] += r["words"]
            assert source.setdefault(r["slot"], r["source"]) == r["source"] and 0 <= r["from_word"] < r["size"]
    total = sum(len(t.split()) for _, t, _ in rows)
    assert sum(by_slot.values()) == pytest.approx(total, abs=4) and sum(n < 16 for n in by_slot.values()) <= 4
    target = {r["source"]: r["target"] for r in parts}
    for end in (50, 200, 400, len(by_slot)):
        got = Counter(source[k] for k in sorted(by_slot)[:end])
        assert all(abs(got[s] / end - t / total) < 8 / end for s, t in target.items())
    want = mixed(df, block_words=16)
    monkeypatch.setattr(mixing, "PART_ROWS", 20)
    monkeypatch.setattr(mixing, "PART_SLOTS", 10)
    monkeypatch.setattr(mixing, "CHUNK_POINTS", 8)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert mixed(df, block_words=16) == want == brute_mix(rows)


# Importance resampling.


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_features(text, order=2):
    w = plain_words(text)
    return [" ".join(w[k : k + m]) for m in range(1, order + 1) for k in range(len(w) - m + 1)]


def brute_importance(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000))))
    rows = []
    for i, x in docs:
        f = plain_features(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(plain_words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(enough[: 25 * len(enough) // 100])}
    return Counter((r[0], *r[2:], rank.get(id(r))) for r in rows)


def resampled(df, target):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.resample(df, target).collect())


def test_importance_real_and_odd(spark, odd):
    docs, target = (common.table(spark, DATA, t) for t in ("documents", "benchmark"))
    texts = [r["text"] for r in target.collect()]
    assert resampled(docs, target) == brute_importance([(r["doc_id"], r["text"]) for r in docs.collect()], texts)
    assert resampled(odd, target) == brute_importance([(i, x) for i, x, _ in ODD], texts)
    assert not resampled(odd.limit(0), target) and resampled(odd, target.limit(0)) == brute_importance([(i, x) for i, x, _ in ODD], [])
    copies = odd.unionByName(odd).unionByName(odd)
    assert resampled(copies, target) == brute_importance([(i, x) for i, x, _ in ODD] * 3, texts)


@pytest.mark.parametrize("piece", [8, 64, 1 << 21])
def test_composed_crcs(monkeypatch, piece):
    """CRCs of n-grams equal those of the spelled-out ones, for words of any length and texts cut anywhere."""
    monkeypatch.setattr(importance, "PIECE", piece)
    random = np.random.default_rng(3)
    alphabet = list("abcXYZ019 ,.-\n\x00äßЖ中\U0001f600")
    texts = ["".join(random.choice(alphabet, int(n))) for n in random.integers(0, 300, 30)]
    texts += ["", "a", "x" * 63 + " " + "y" * 64 + " " + "z" * 65 + " " + "q" * 1000 + " end", " lead", "tail ", "w " * 400]
    for order in (1, 2, 4):
        got = defaultdict(Counter)
        for row, _, grams in importance.ngrams([t.encode() for t in texts] + [None], order):
            for crc, ok in grams:
                for r, c in zip(row[ok].tolist(), crc[ok].tolist(), strict=True):
                    got[r][c] += 1
        for k, text in enumerate(texts):
            assert got[k] == Counter(zlib.crc32(f.encode()) for f in plain_features(text, order)), (order, k)


def test_queries_keep_no_python_in_the_native_one(spark):
    plan = queries.op12_mixing(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "NestedLoop" not in plan and "Cartesian" not in plan
    assert set(queries.op13_importance(spark, DATA).columns) == {"doc_id", "n_features", "weight", "score", "rank"}
