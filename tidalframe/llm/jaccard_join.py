"""Exact n-gram Jaccard join over a token-group matrix.

A document's set holds its distinct word n-grams. Two documents link when
``100 * intersection >= percent * union``; the result names every document's component.

1. Documents with equal sets fall into one class (128-bit digest of the sorted set); a class is
   a vertex named by its smallest id.
2. Screen. A set of n tokens misses at most e(n) = n * (100 - percent) / 100 tokens of a linking
   partner. Of the tokens in the order of their hashes, the first e(n) + half(n), half(n) =
   e(n) / 2, are the head. Two linking sets share at least half(the smaller) tokens of their
   heads: the j-th token in common stands at most e(n) places later in either set. A set whose
   head has fewer tokens in any other class's head links with nothing and goes no further.
3. Groups. The sets left are partitioned by the smallest shared token of their heads. Sorted runs
   of one key are cut into groups bounded in rows and tokens; each is clustered exactly by a
   matrix of token unions (``Chunk``). One leader of each cluster takes part in further passes,
   keyed by another hash and the first in turn, which connect clusters across groups.
4. Token-group matrix. A link that is still open joins two clusters, so tokens that one cluster
   alone has are no part of it, and documents that have too few others drop out, again and
   again. The documents left are laid out by keys that similar ones share (``_layout``) and cut
   into groups of bounded size; the members of a group are compared with one another. The matrix
   of rows (token, group) is the union of the head tokens of each group's members. Each document
   queries it with its rarest tokens (all but the overlap needed, less one), as a group that none
   of them is in cannot reach the overlap. It meets the groups found in bounded blocks, where its
   overlap with the unions of their parts bounds the overlap with every member, and only parts
   that reach the needed overlap are opened. Of two clusters the one with fewer members asks.

Pairs are never listed as rows; documents meet in bounded blocks. A family of k near copies is
about k / ``CHUNK_ROWS`` groups, each of which a document of the family enters once, however many
tokens lead there. A passage that many documents share makes no candidates unless it is most of
them, and nothing is left out: steps 2 and 4 drop only what cannot link.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than n make one token of
the whole sequence; null, empty and white-space texts have an empty set and link with nothing.
Repeated rows share a component; rows of one id with different texts are one document, so their
texts' components are one. A null id has a null component and links with nothing. Very long
texts are sets like any other: memory holds a batch of texts, then a chunk's sets. Ties between
groups fall to the smaller id; an empty table gives an empty result; extra columns are not read.
Tokens are compared by 64-bit hashes in candidate search and in verification.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, ranges
from .components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CACHE_WORDS = 50_000
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bounds of one chunk: sets, and tokens in all of them (a single set may exceed the latter).
CHUNK_ROWS, CHUNK_TOKENS = 400, 200_000
#: Passes over the group keys at most, and the share of leaders a pass must save to go on.
PASSES, SAVED = 6, 0.05
#: Rounds of dropping documents with too few tokens in other clusters, and halves of e(n) in a wide head.
ROUNDS, WIDE = 3, 4


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * K2
    h = (h ^ (h >> np.uint64(27))) * K3
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((cache[w] for w in words), np.uint64, len(words))
    take = min(n, len(h))
    gram = np.full(len(h) - take + 1, take, np.uint64) * K3
    for k in range(take):
        gram = mix((gram + h[k : len(h) - take + 1 + k]) * K1)
    return np.unique(gram)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets."""
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    common_tokens = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common_tokens >= percent * (n + m - common_tokens)


class _Group:
    """Members of one row of a matrix. Their tokens lie in one array, rebuilt when it has grown by half."""

    def __init__(self):
        self.members, self.ready, self.tokens, self.starts, self.lengths = [], 0, None, None, None

    def overlaps(self, own: list[np.ndarray], mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(overlap with the marked set, size) of every member."""
        if len(self.members) > self.ready + self.ready // 2 + 8:
            self.ready = len(self.members)
            self.tokens = np.concatenate([own[s] for s in self.members])
            self.lengths = np.array([len(own[s]) for s in self.members])
            self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        late = self.members[self.ready :]
        both = np.array([mark[own[s]].sum() for s in late], np.int64)
        sizes = np.array([len(own[s]) for s in late], np.int64)
        if not self.ready:
            return both, sizes
        return np.concatenate((np.add.reduceat(mark[self.tokens], self.starts, dtype=np.int64), both)), np.concatenate((self.lengths, sizes))


class Chunk:
    """Token-group matrix over one bounded chunk of sets; clusters its sets by their links.

    A row of the matrix is the union of a group's tokens. A set's overlap with it bounds the
    overlap with every member, and only groups that reach the needed overlap are opened. With
    ``asking``, those sets are compared with the others only, and the others with one another
    unless ``met`` says that this was done elsewhere.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, asking: np.ndarray | None = None, met: bool = False):
        self.sets, self.percent, self.asking, self.met = sets, percent, asking, met
        self.parent = list(range(len(sets)))

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def run(self) -> list[int]:
        sets, percent, asking = self.sets, self.percent, self.asking
        tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.cumsum([0, *map(len, sets)])
        own = [inverse[bounds[k] : bounds[k + 1]] for k in range(len(sets))]
        sizes = np.array([len(s) for s in sets])
        rows = max(1, min(64, 16_000_000 // max(1, len(tokens))))
        matrix = np.zeros((min(rows, len(sets)), len(tokens)), bool)
        groups: list[_Group] = []
        mark = np.zeros(len(tokens), bool)
        for q in np.lexsort((sizes, asking)) if asking is not None else np.argsort(sizes, kind="stable"):
            q, size = int(q), int(sizes[q])
            if not size:
                continue
            need = -(-percent * size // 100)
            bound = matrix[: len(groups), own[q]].sum(axis=1) if groups else np.empty(0, int)
            if not self.met or asking[q]:
                mark[own[q]] = True
                for g in np.flatnonzero(bound >= need):
                    both, lengths = groups[g].overlaps(own, mark)
                    for k in np.flatnonzero(100 * both >= percent * (size + lengths - both)):
                        self.join(q, groups[g].members[k])
                mark[own[q]] = False
            if asking is not None and asking[q]:
                continue
            if len(groups) < len(matrix) and (not len(bound) or bound.max() < need):
                groups.append(_Group())
                g = len(groups) - 1
            else:
                g = int(np.argmax(bound))
            groups[g].members.append(q)
            matrix[g, own[q]] = True
        return [self.find(k) for k in range(len(sets))]


def _allowed(n, percent: int):
    """e(n): tokens that a set of n can miss of a partner; like its peers for ints and arrays."""
    return n * (100 - percent) // 100


def head_size(n, percent: int, halves: int = 1):
    """Tokens of a head: e(n), and ``halves`` halves of it; more halves make a wide head."""
    e = _allowed(n, percent)
    return np.minimum(n, e + np.maximum(1, (halves * e + 1) // 2))


def head_needed(n, percent: int, halves: int = 1):
    """Tokens that the heads of a set of n and of any linking partner share at least."""
    small = (percent * n + 99) // 100
    return np.minimum(small, np.maximum(1, (halves * _allowed(small, percent) + 1) // 2))


def _sql_head_size(n: str, percent: int, halves: int = 1) -> str:
    e = f"({n} * {100 - percent} div 100)"
    return f"least({n}, {e} + greatest(1L, ({halves} * {e} + 1) div 2))"


def _sql_head_needed(n: str, percent: int, halves: int = 1) -> str:
    small = f"(({percent} * {n} + 99) div 100)"
    return f"least({small}, greatest(1L, ({halves} * ({small} * {100 - percent} div 100) + 1) div 2))"


def _digest(tokens: np.ndarray) -> np.ndarray:
    """128 bits of a sorted set as two longs; the first is its short name in the screen."""
    return np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)


def _sets(n: int):
    """(doc_id, n_shingles, both halves of the set's digest) of every row."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        for batch in batches:
            sets = [shingles(t, n, cache) for t in batch["__text"]]
            halves = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": batch["__id"], "n_shingles": np.array([len(s) for s in sets], np.int64), "s1": halves[:, 0], "s2": halves[:, 1]})

    return scan


#: What a row of the screen says of its token: one set of the batch has it; the named set is one
#: of several that share it in the batch; several share it, told to the other batches once.
ALONE, TOGETHER, TOLD = 0, 1, 2


def _heads(n: int, percent: int):
    """(token, class, state) of the heads of a batch; a token goes to the other batches once.

    Copies of a class within the batch count once.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        for batch in batches:
            sets = {}
            for text in batch["__text"]:
                s = shingles(text, n, cache)
                if len(s):
                    sets.setdefault(int(_digest(s)[0]), s[: head_size(len(s), percent)])
            if not sets:
                continue
            token = np.concatenate(list(sets.values()))
            of = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(s) for s in sets.values()])
            order = np.argsort(token, kind="stable")
            token, of = token[order].view(np.int64), of[order]
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(start, len(token)))
            several = np.repeat(count > 1, count)
            yield pd.DataFrame(
                {
                    "token": np.concatenate((token[start], token[several])),
                    "of": np.concatenate((of[start], of[several])),
                    "state": np.concatenate((np.where(count > 1, TOLD, ALONE), np.full(several.sum(), TOGETHER))).astype(np.int32),
                }
            )

    return scan


def _screen(rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(v, key1, key2) of the classes whose heads share enough tokens with other classes."""
    seen = rows.mapInPandas(_heads(n, percent), "token long, of long, state int")
    # Rows already known to be shared are spread, so a hot token has a row from each batch at most.
    seen = seen.withColumn("__k", F.when(F.col("state") == TOGETHER, F.xxhash64("of", "token")).otherwise(F.col("token")))
    w = Window.partitionBy("__k")
    seen = seen.select("token", "of", "state", F.min("of").over(w).alias("__a"), F.max("of").over(w).alias("__z"), F.max("state").over(w).alias("__s"))
    shared = seen.filter((F.col("state") == TOGETHER) | ((F.col("state") == ALONE) & ((F.col("__a") != F.col("__z")) | (F.col("__s") == TOLD))))
    counts = shared.select("of", "token").distinct().groupBy("of").agg(F.count(F.lit(1)).alias("__c"), F.min("token").alias("key1"), F.min(F.xxhash64("token")).alias("key2"))
    kept = classes.join(counts, classes["s1"] == counts["of"]).filter(F.expr(f"__c >= {_sql_head_needed('n_shingles', percent)}"))
    return kept.groupBy("v").agg(F.min("key1").alias("key1"), F.min("key2").alias("key2"))


def _tokens(n: int):
    """(v, key1, key2, n, tokens): the sorted set of each row, with what came with it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        for batch in batches:
            sets = [shingles(t, n, cache) for t in batch["text"]]
            keep = [k for k, s in enumerate(sets) if len(s)]
            out = batch[["v", "key1", "key2"]].iloc[keep]
            yield out.assign(n=np.array([len(sets[k]) for k in keep], np.int64), tokens=[sets[k].view(np.int64) for k in keep])

    return scan


def _cluster_runs(percent: int):
    """(v, leader, chunk) of rows sorted by key: runs of one key in chunks of bounded size, each clustered."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, names, sets, held = None, [], [], 0

        def close() -> pd.DataFrame:
            leaders = [names[k] for k in Chunk(sets, percent).run()] if len(names) > 1 else names
            return pd.DataFrame({"v": names, "leader": leaders, "chunk": names[:1] * len(names)}, dtype=np.int64)

        for batch in batches:
            for own, v, tokens in zip(batch["key"], batch["v"], batch["tokens"], strict=True):
                if names and (own != key or len(names) >= CHUNK_ROWS or held + len(tokens) > CHUNK_TOKENS):
                    yield close()
                    names, sets, held = [], [], 0
                key = own
                names.append(v)
                sets.append(np.asarray(tokens, np.int64).view(np.uint64))
                held += len(tokens)
        if names:
            yield close()

    return scan


def _groups(alive: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found inside chunks, and the chunks (v, chunk) of the first pass, which are the groups.

    The first pass holds all documents, later ones the leaders of clusters, by both keys in turn.
    """
    level, edges, groups, left = alive.select("v", "key1", "key2"), [], None, None
    for k in range(PASSES):
        key = ("key1", "key2")[k % 2]
        # Sets are sent only where several have the key.
        often = level.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").select(F.col(key).alias("__k"))
        sent = common.stored(level.join(often, F.col(key) == F.col("__k"), "left_semi").select("v").distinct())
        rows = common.matching(alive, "v", sent, "v").select(F.col(key).alias("key"), "v", "tokens")
        rows = rows.repartitionByRange("key", "v").sortWithinPartitions("key", "v")
        done = common.stored(rows.mapInPandas(_cluster_runs(percent), "v long, leader long, chunk long"))
        groups = groups or done.select("v", "chunk")
        edges.append(done.filter("v != leader").select(F.col("v").alias("a"), F.col("leader").alias("b")))
        led = done.filter("v != leader").select(F.col("v").alias("__v")).distinct()
        level = common.stored(level.join(led, F.col("v") == F.col("__v"), "left_anti"))
        now = level.count()
        if k and now > left * (1 - SAVED):
            break
        left = now
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out, groups


def _open(percent: int):
    """(v, leader) of one block of a group: its members, who meet in its first block, and documents that asked for it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v", kind="stable")
        v = rows["v"].to_numpy(np.int64)
        chunk, first = Chunk([np.asarray(t, np.int64).view(np.uint64) for t in rows["tokens"]], percent, rows["asks"].to_numpy(bool), bool(rows["block"].iloc[0])), {}
        for k, label in enumerate(rows["label"].to_numpy(np.int64)):
            chunk.join(k, first.setdefault(label, k))
        return pd.DataFrame({"v": v, "leader": v[chunk.run()]})

    return run


def _foreign(rows: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, token) of rows (v, label, token) whose token other labels have too, and the documents that have enough of them (stored)."""
    foreign = rows.groupBy("token").agg(F.min("label").alias("__a"), F.max("label").alias("__z")).filter("__a < __z")
    shared = rows.select("v", "token").join(foreign.select("token"), "token", "left_semi")
    counts = shared.groupBy("v").agg(F.count(F.lit(1)).alias("__c"))
    needs = needs.groupBy("v").agg(F.min("need").alias("__n"))
    return shared, common.stored(counts.join(needs, "v").filter("__c >= __n").select("v"))


def _layout(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with ``at``, the group of each: runs of about ``CHUNK_ROWS`` members or ``CHUNK_TOKENS`` tokens at most.

    Members are in the order of two keys. A key is the token of smallest hash, where tokens that
    many of ``rows`` (v, token) have count as many times: most of a family have the same.
    """
    times = rows.groupBy("token").agg(F.count(F.lit(1)).alias("__t"))
    drawn = lambda seed: F.min(F.struct((-F.log((F.pmod(F.xxhash64(F.lit(seed), "token"), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.col("__t")).alias("e"), "token"))["token"]
    keys = rows.join(times, "token").groupBy("v").agg(drawn(1).alias("__k1"), drawn(2).alias("__k2"))
    order = [F.col("__k1"), F.col("__k2"), F.col("v")]
    dealt = ranges.by_ranges(members.join(keys, "v"), *order)
    placed = ranges.running(dealt, F.greatest("n", F.lit(CHUNK_TOKENS // CHUNK_ROWS)), order)
    return common.stored(placed.select("v", "label", "n", "need", "rank", F.floor(F.col("__before") / CHUNK_TOKENS).alias("at")))


def _asked(rows: DataFrame) -> DataFrame:
    """(v, at): the groups, other than its own, that each document of rows (v, at, rank, need, token) asks."""
    matrix = rows.groupBy("token", "at").agg(F.max("rank").alias("top"))
    # One row a token: the groups that have it, with the largest cluster that has it there.
    matrix = common.stored(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.collect_list(F.struct("at", "top")).alias("places")))
    whole = Window.partitionBy("v")
    rare = rows.join(matrix.select("token", "groups"), "token").withColumn("__r", F.row_number().over(whole.orderBy("groups", "token"))).withColumn("__c", F.count(F.lit(1)).over(whole))
    rare = rare.filter("__r <= __c - need + 1").select("token", "v", F.col("at").alias("__own"), "rank")
    found = F.transform(F.filter("places", lambda p: (p["at"] != F.col("__own")) & (F.col("rank") < p["top"])), lambda p: p["at"])
    asks = rare.join(matrix.select("token", "places"), "token").select("v", found.alias("__f")).filter(F.size("__f") > 0)
    return asks.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("__f"))).alias("__f")).select("v", F.explode("__f").alias("at"))


def _across(alive: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """Links (v, leader) between clusters, found over the token-group matrix; None without any candidate.

    ``labels`` names the cluster that a document is known to belong to.
    """
    named = common.matching(alive, "v", labels, "v", keep=["root"], how="left").select("v", F.coalesce("root", "v").alias("label"), "n", "tokens")
    before = None
    # From cheap to telling: narrow heads, wide ones, whole sets; then narrow ones again, for the matrix.
    for halves in (1, WIDE, None, *[1] * ROUNDS):
        head, need = F.slice("tokens", 1, F.expr(_sql_head_size("n", percent, halves or 1)).cast("int")), F.expr(_sql_head_needed("n", percent, halves or 1))
        if halves is None:
            head, need = F.col("tokens"), F.expr(f"({percent} * n + 99) div 100")
        needs = named.select("v", need.alias("need"))
        shared, enough = _foreign(named.select("v", "label", F.explode(head).alias("token")), needs)
        now = enough.count()
        if not now:
            return None
        if halves == 1 and before is not None and now > 0.9 * before:
            break
        before = now if halves is None or before is not None else None
        named = common.matching(named, "v", enough, "v", count=now)
    needs = needs.groupBy("v").agg(F.min("need").alias("need"))
    named = named.groupBy("v", "label").agg(F.max("n").alias("n")).join(enough, "v").join(needs, "v")
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = named.join(sizes, "label").select("v", "label", "n", "need", F.struct("size", "label").alias("rank"))
    shared = common.stored(shared.join(enough, "v", "left_semi"))
    members = _layout(shared, members)
    queries = common.stored(_asked(shared.join(members, "v").select("v", "at", "rank", "need", "token")))
    load = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS), F.least(F.count(F.lit(1)), F.ceil(F.sum("n") / CHUNK_TOKENS)))
    blocks = common.stored(queries.join(members.select("v", "n"), "v").groupBy("at").agg(load.alias("blocks")))
    inside = members.select("v", "label", "at").join(blocks, "at", "left")
    last = F.coalesce("blocks", F.lit(1)).cast("long") - 1
    inside = inside.select("v", "label", "at", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.lit(False).alias("asks"))
    outside = queries.join(members.select("v", "label"), "v").join(blocks, "at")
    outside = outside.select("v", "label", "at", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"), F.lit(True).alias("asks"))
    blocks = common.stored(inside.unionByName(outside))
    opened = blocks.join(common.matching(alive.select("v", "tokens"), "v", members.select("v"), "v", count=now), "v")
    return common.stored(opened.groupBy("at", "block").applyInPandas(_open(percent), "v long, leader long").filter("v != leader").distinct())


def link_classes(rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the classes (v, s1, n_shingles) as far as they link; ``rows`` has __id and __text."""
    screened = common.stored(_screen(rows, classes, n, percent))
    texts = common.matching(rows.select(F.col("__id").alias("v"), F.col("__text").alias("text")), "v", screened, "v", keep=["key1", "key2"])
    alive = common.stored(texts.mapInPandas(_tokens(n), "v long, key1 long, key2 long, n long, tokens array<long>"))
    edges, _ = _groups(alive, percent)
    labels = components(edges)
    late = _across(alive, labels, percent)
    found = labels.select(F.col("v").alias("a"), F.col("root").alias("b"))
    return found if late is None else found.unionByName(late.select(F.col("v").alias("a"), F.col("leader").alias("b")))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for every row of ``docs``.

    component_id is the smallest id reachable by links, the own id without any, and null for a
    null id. class_id is the smallest id with an equal set.
    """
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    own = common.stored(rows.mapInPandas(_sets(n), "doc_id long, n_shingles long, s1 long, s2 long"))
    filled = own.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sets = common.stored(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("v"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies")))
    edges = link_classes(rows.filter(F.col("__id").isNotNull()), sets, n, percent)
    split = common.stored(filled.groupBy("doc_id").agg(F.min("s1").alias("__a"), F.max("s1").alias("__z")).filter("__a < __z").select("doc_id"))
    if not split.isEmpty():
        edges = edges.unionByName(filled.join(split, "doc_id").join(sets.select("s1", "s2", "v"), ["s1", "s2"]).select(F.col("v").alias("a"), F.col("doc_id").alias("b")))
    roots = components(edges)
    heads = sets.join(roots.select(F.col("v").alias("__v"), "root"), F.col("v") == F.col("__v"), "left")
    heads = common.stored(heads.select("s1", "s2", "copies", F.col("v").alias("class_id"), F.coalesce("root", "v").alias("component_id")))
    # Sets that very many rows share are looked up by a broadcast that cannot exceed 100,000 of them.
    hot = F.col("copies") > max(1000, own.count() // 100_000)
    found = common.looked_up(filled, heads.filter(hot).drop("copies"), heads.filter(~hot).drop("copies"), ["s1", "s2"])
    rest = own.filter(F.col("doc_id").isNull() | (F.col("n_shingles") <= 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id").unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of every component: the row with its smallest id; columns as they came.

    Rows with a null id are kept. Of rows that repeat the kept id, the one with the smallest
    text stays (nulls first), and of equal texts the one whose other columns hash least.
    """
    ids = common.stored(join_components(docs, id_col, text_col, n, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("__c"), F.count(F.lit(1)).alias("__n")))
    kept = common.matching(docs, id_col, ids.filter("__c < doc_id").select("doc_id"), "doc_id", how="left_anti")
    again = ids.filter("__c = doc_id AND __n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    order = Window.partitionBy(id_col).orderBy(F.col(text_col), F.xxhash64(F.to_json(F.struct(*docs.columns))))
    several = common.matching(kept, id_col, again, "doc_id").withColumn("__r", F.row_number().over(order)).filter("__r = 1")
    return common.matching(kept, id_col, again, "doc_id", how="left_anti").unionByName(several.select(*docs.columns))
