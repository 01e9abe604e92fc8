"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf by hand; from it come the normaliser (compiled character
map, extra white space, dummy prefix), the metaspace marker, the pieces with their scores and
types, and byte fallback. A unigram model becomes a unigram tokenizer with those scores; for a
BPE model, whose scores are merge ranks, every split of a piece into two known pieces becomes
a merge in score order. Batches are encoded with the library's own threads. ``verify`` checks
equal ids against the sentencepiece library and is run when a backend is built by ``load``.

Null and empty texts have no tokens and decode to the empty text.
"""

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts of about this many characters are encoded at once; words kept in a worker's cache.
BATCH_BYTES = 4_000_000
CACHE_WORDS = 800_000
#: Threads of the tokenizers library in each Python worker.
THREADS = 2
#: What ``verify`` encodes with both libraries.
PROBES = ["", " ", "a", "Hello world", "  two  spaces ", "tab\tand\nline\r\n", "naïve Äpfel ñandú", "日本語 текст עברית", "emoji 👩‍👩‍👧 🏳️‍🌈", "x" * 300, "<s> </s> <unk> <0x41>", "▁ mark▁inside", "é   　 ﻿", "\x00\x01\x7f", "1234567890.00 €", "AAAA!!! ***%%%$$$", "def f(x):\n    return x ** 2\n\n\n"]


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or bytes of the other wire types."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_spaces: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n in (3, 4, 5):
                    setattr(model, {3: "dummy_prefix", 4: "fold_spaces", 5: "escape"}[n], bool(v))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """All splits of each piece into two known pieces, best score first."""
    known = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    ranked = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind in (NORMAL, USER):
            ranked += [(-score, i, k) for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
    return [(model.pieces[i][0][:k], model.pieces[i][0][k:]) for _, i, k in sorted(ranked)]


def words_apart(model: Model) -> bool:
    """Words can be encoded one by one: no piece has a marker after another sign, so no merge
    crosses the cut before a marker, and the normaliser does nothing but put markers."""
    plain = model.kind == BPE and model.escape and model.dummy_prefix and not model.charsmap and not model.fold_spaces
    return plain and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def build(data: bytes):
    """A tokenizers.Tokenizer equal to the sentencepiece model in ``data``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse(data)
    unknown = next(i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind}")
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.fold_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" " if not model.escape else MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if words_apart(model):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(parts + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tok


def verify(tok, data: bytes, texts: list[str]) -> list[str]:
    """Texts whose ids differ from those of the sentencepiece library."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    return [t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != e.ids]


def load(path: str = DEFAULT_MODEL) -> tuple[str, bool]:
    """The tokenizer as JSON, after a parity check, and ``words_apart``; a few MB, fixed by the model file."""
    with open(path, "rb") as f:
        return checked(f.read())


def checked(data: bytes) -> tuple[str, bool]:
    tok = build(data)
    if bad := verify(tok, data, PROBES):
        raise ValueError(f"ids differ from sentencepiece for {bad[:3]!r}")
    json, apart = tok.to_str(), words_apart(parse(data))
    if [ids.tolist() for ids, _ in Backend(json, apart).round_trips(PROBES)] != [e.ids for e in tok.encode_batch(PROBES, add_special_tokens=False)]:
        raise ValueError("words encoded one by one give other ids")
    return json, apart


def shared_model(spark: SparkSession, path: str):
    """What ``load`` gives, as a broadcast. A task builds and checks it, so the driver holds the file and the result alone."""
    with open(path, "rb") as f:
        data = f.read()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [checked(data) for _ in range(len(part))]
            yield pd.DataFrame({"json": [m[0] for m in made], "apart": [m[1] for m in made]})

    made = spark.range(1, numPartitions=1).mapInPandas(run, "json string, apart boolean").first()
    return spark.sparkContext.broadcast((made["json"], made["apart"]))


class Backend:
    """Encodes batches of texts; where words are apart, each distinct word once.

    A word's ids lie in one growing array; the store is emptied when it has ``CACHE_WORDS``
    words, so that its memory stays bounded. It outlives a task in a reused Python worker.
    """

    WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, json: str, apart: bool):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import Tokenizer, decoders, normalizers

        self.tok, self.apart = Tokenizer.from_str(json), apart
        if apart:
            self.plain = Tokenizer.from_str(json)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.ends, self.changed = np.empty(0, "<i4"), np.zeros(1, np.int64), np.empty(0, bool)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of the words in the store."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS and self.index:
            self._empty()
            new = words
        if new:
            # Words that begin or end with a marker of their own would run into their neighbours.
            alone = [w for w in new if not w.strip(MARK) or w.startswith(MARK * 2)]
            lone = set(alone)
            new = [w for w in new if w not in lone] if lone else new
            parts = [new[k : k + 5000] for k in range(0, len(new), 5000)] + [[w] for w in alone]
            new = new + alone
            got = self.plain.encode_batch(["".join(p) for p in parts], add_special_tokens=False)
            counts = np.concatenate([np.bincount(np.array(e.word_ids), minlength=len(p)) for e, p in zip(got, parts, strict=True)])
            ids = [np.array(e.ids, "<i4") for e in got]
            back = self.plain.decode_batch(ids, skip_special_tokens=False)
            bad = []
            for p, own, text in zip(parts, got, back, strict=True):
                same = text == "".join(p).replace(MARK, " ")
                bad += [False] * len(p) if same else self._changed(p, own)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, *ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            self.changed = np.concatenate([self.changed, bad])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _changed(self, words: list[str], encoding) -> list[bool]:
        own: list[list[int]] = [[] for _ in words]
        for word, i in zip(encoding.word_ids, encoding.ids, strict=True):
            own[word].append(i)
        return [t != w.replace(MARK, " ") for t, w in zip(self.plain.decode_batch(own, skip_special_tokens=False), words, strict=True)]

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of the texts in a row, and each text's number of words."""
        rows = [self.WORD.findall(self.tok.normalizer.normalize_str(t)) if not t or t[0] == " " or "  " in t or MARK in t else None for t in texts]
        fast = pc.split_pattern(pa.array([t for t, r in zip(texts, rows, strict=True) if r is None], pa.large_string()), " ")
        flat = fast.flatten().dictionary_encode()
        slow = [w for r in rows if r for w in r]
        known = [MARK + w for w in flat.dictionary.to_pylist()]
        place = self._learn(list(dict.fromkeys([*known, *slow])))
        at = dict(zip(dict.fromkeys([*known, *slow]), place, strict=True)) if slow else None
        fast_words, fast_counts = place[flat.indices.to_numpy()], iter(pc.list_value_length(fast).to_numpy())
        counts = np.array([next(fast_counts) if r is None else len(r) for r in rows], np.int64)
        if not slow:
            return fast_words, counts
        out, used = [], 0
        for r, n in zip(rows, counts, strict=True):
            if r is None:
                out.append(fast_words[used : used + n])
                used += n
            else:
                out.append(np.array([at[w] for w in r], np.int64))
        return np.concatenate(out), counts

    def round_trips(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """(ids as little-endian 32-bit integers, whether they decode to the text) of each text."""
        if not self.apart:
            got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.tok.decode_batch(got, skip_special_tokens=False)
            yield from ((np.array(i, "<i4"), b == t) for i, b, t in zip(got, back, texts, strict=True))
            return
        words, counts = self._words(texts)
        start, length = self.ends[words], self.ends[words + 1] - self.ends[words]
        last = np.cumsum(length)
        ids = self.ids[np.arange(last[-1] if len(last) else 0) + np.repeat(start - (last - length), length)]
        cuts = np.concatenate(([0], last))[np.concatenate(([0], np.cumsum(counts)))]
        bad = np.concatenate(([0], np.cumsum(self.changed[words])))[np.concatenate(([0], np.cumsum(counts)))]
        for k, text in enumerate(texts):
            yield ids[cuts[k] : cuts[k + 1]], bad[k + 1] == bad[k] and MARK not in text


_BACKENDS: dict[tuple[str, bool], Backend] = {}


def backend(json: str, apart: bool) -> Backend:
    """One backend for a worker's tasks."""
    if (json, apart) not in _BACKENDS:
        _BACKENDS.clear()
        _BACKENDS[json, apart] = Backend(json, apart)
    return _BACKENDS[json, apart]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode_column(docs: DataFrame, text_col: str, model_path: str = DEFAULT_MODEL, ids: bool = True):
    """struct(n_tokens, ids_sha256, round_trip, token_ids) of a text column.

    ids_sha256 digests the ids as little-endian 32-bit integers; round_trip says that decoding
    gives the text back; token_ids is null unless ``ids``.
    """
    common.tune(docs.sparkSession)
    shared = shared_model(docs.sparkSession, model_path)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own_backend = backend(*shared.value)
        for texts in batches:
            out = []
            for group in _groups(["" if t is None else t for t in texts]):
                out += [(len(own), hashlib.sha256(own.tobytes()).hexdigest(), bool(same), own if ids else None) for own, same in own_backend.round_trips(group)]
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "round_trip", "token_ids"])

    return F.pandas_udf(encode, "n_tokens long, ids_sha256 string, round_trip boolean, token_ids array<int>")(F.col(text_col))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip[, token_ids]) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), encode_column(docs, text_col, model_path, ids).alias("__e"))
    return rows.select("doc_id", "__e.n_tokens", "__e.ids_sha256", "__e.round_trip", *["__e.token_ids"] * ids)


def decode(rows: DataFrame, ids_col: str = "token_ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Adds ``text``, decoded from an array of ids; null ids give null."""
    common.tune(rows.sparkSession)
    shared = shared_model(rows.sparkSession, model_path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(shared.value[0])
        for batch in batches:
            yield pd.Series([None if i is None else tok.decode(list(i), skip_special_tokens=False) for i in batch], dtype="object")

    return rows.withColumn("text", F.pandas_udf(run, "string")(F.col(ids_col)))
