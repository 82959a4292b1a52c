"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here (its wire format needs no generated code), and from it the tokenizer is rebuilt:
normaliser (character map, spaces, dummy prefix), the metaspace marker, the unigram scores or, for a BPE model, the
merges in the order of the scores, and byte fallback. Texts are encoded in batches on all threads that a task may use.
``parity`` holds the rebuilt tokenizer against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType

from .common import add_columns, fields

#: Where the public tokenizers' files lie; the model's path is a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A run of markers and what follows it, or what comes before the first marker.
PIECES = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words whose ids a worker remembers at most, beside those of one batch: so many of late, and so many from before.
KNOWN_WORDS = 110_000
#: New words that are encoded as one string.
JOINED = 100
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(field number, value) of a protobuf message: int for varints, bytes for the other kinds."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """What a SentencePiece model file holds; fields not in the file keep the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix_mark: bool = False


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:  # a piece
            text, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    text = v.decode("utf-8")
                elif k == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif k == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:  # the trainer's settings
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 24:
                    m.suffix_mark = bool(v)
                elif k == 35:
                    m.byte_fallback = bool(v)
                elif k == 40:
                    m.unk_id = v
        elif number == 3:  # the normaliser's
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_spaces = bool(v)
                elif k == 5:
                    m.escape_spaces = bool(v)
    if m.suffix_mark or not m.escape_spaces or m.kind not in (UNIGRAM, BPE):
        raise ValueError("models with a suffix marker, unescaped spaces, or of words or characters aren't supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """The pairs that build each piece, in the order in which BPE prefers them: by the score of what they build."""
    score = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
    index = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    found = []
    for piece, s in score.items():
        pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in score and piece[k:] in score]
        found += [(-s, index[piece], index[a], index[b], a, b) for a, b in pairs]
    return [(a, b) for *_, a, b in sorted(found)]


class Codec:
    """data: a model file's bytes. check: the sentencepiece library's processor of it; every word that is met first is then verified."""

    def __init__(self, data: bytes, check=None):  # noqa: ANN001
        import tokenizers as T

        self.check, self.wrong = check, set()

        m = self.model = parse(data)
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        unk = m.pieces[m.unk_id][0]
        if m.kind == BPE:
            core = T.models.BPE(vocab, merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=40_000)
        else:
            core = T.models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, byte_fallback=m.byte_fallback)
        t = self.tokenizer = T.Tokenizer(core)
        steps = [T.normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra_spaces:
            steps += [T.normalizers.Strip(), T.normalizers.Replace(T.Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(T.normalizers.Prepend(MARK))
        t.normalizer = T.normalizers.Sequence([*steps, T.normalizers.Replace(" ", MARK)])
        # Where no piece has the marker after another character, no merge crosses such a place: words can be taken apart there.
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, _ in m.pieces)
        self.word_tokenizer, self.known, self.before = T.Tokenizer(core), {}, {}
        if self.by_word:
            t.pre_tokenizer = T.pre_tokenizers.Split(T.Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        self.begins = np.array([p.startswith(MARK) for p, _, _ in m.pieces], bool)
        self.bytes = {i: int(p[3:5], 16) for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self.text = {i: p.replace(MARK, " ").encode() for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
        self.text |= {i: bytes([b]) for i, b in self.bytes.items()} | {m.unk_id: " ⁇ ".encode()}

    def normalise(self, text: str) -> str:
        m = self.model
        if m.charsmap or m.remove_extra_spaces:
            return self.tokenizer.normalizer.normalize_str(text)
        return (MARK + text if text and m.dummy_prefix else text).replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.verified(texts)[0]

    def verified(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether the library gives the same ids for all of its words (for the whole text, where words can't be taken apart).

        Words that a batch hasn't met go through the tokenizer together, on all its threads, and are verified once.
        """
        if not self.by_word:
            out = [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return out, [self.check is None or self.check.encode(t) == ids.tolist() for t, ids in zip(texts, out, strict=True)]
        split = [PIECES.findall(self.normalise(t)) for t in texts]
        known = self.known
        if len(known) > KNOWN_WORDS:
            self.before, self.known = known, {}
            known = self.known
        new = {w for words in split for w in words if w not in known}
        known.update({w: self.before[w] for w in new if w in self.before})
        new = new.difference(self.before)
        plain = [w for w in new if len(w) > 1 and w[0] == MARK != w[1]]
        self._learn([plain[i : i + JOINED] for i in range(0, len(plain), JOINED)])
        self._learn([[w] for w in new.difference(plain)])
        ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in split]
        return ids, [not self.wrong or self.wrong.isdisjoint(words) for words in split]

    def _learn(self, groups: list[list[str]]) -> None:
        """Encodes groups of words, each as one string, and remembers the words' ids. In groups of several, words have one marker each.

        A piece with a marker begins a word there, so the ids of a string fall apart into those of its words.
        """
        found = [np.array(e.ids, "<i4") for e in self.word_tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)]
        for words, ids in zip(groups, found, strict=True):
            cuts = np.flatnonzero(self.begins[ids]) if len(words) > 1 else np.zeros(1, np.int64)
            same = self.check is None or self._same(words, ids)
            if len(words) > 1 and (not same or len(cuts) != len(words)):
                self._learn([[w] for w in words])
                continue
            packed, ends = ids.tobytes(), [*(cuts * 4).tolist(), 4 * len(ids)]
            self.known.update(zip(words, map(packed.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def _same(self, words: list[str], ids: np.ndarray) -> bool:
        """Whether the library gives the same ids for these words; a word alone for which it doesn't is noted."""
        text = "".join(words)
        text = (text[1:] if self.model.dummy_prefix and text[0] == MARK else text).replace(MARK, " ")
        # a marker alone is what a space at a text's end becomes; an empty text wouldn't get it
        other = self.check.encode(text) if text else self.check.encode("a ")[len(self.check.encode("a")) :]
        if other == ids.tolist():
            return True
        if len(words) == 1:
            self.wrong.add(words[0])
        return False

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; control pieces give nothing, and the space that the dummy prefix gave goes."""
        get = self.text.get
        out = b"".join([get(i, b"") for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Codec:
    """Reads a model file that every machine has at this path; a worker process keeps it from task to task."""
    import sentencepiece

    with open(path, "rb") as f:
        return Codec(f.read(), sentencepiece.SentencePieceProcessor(model_file=path))


def parity(codec: Codec, path: str, texts: list[str]) -> list[str]:
    """The texts for which the sentencepiece library gives other ids or another decoded text."""
    import sentencepiece

    sp = codec.check or sentencepiece.SentencePieceProcessor(model_file=path)
    return [t for t, ids in zip(texts, codec.encode(texts), strict=True) if sp.encode(t) != ids.tolist() or sp.decode(ids.tolist()) != codec.decode(ids)]


#: Texts on which each task verifies parity before it encodes any row: spaces, line ends, byte fallback, markers, literals of special pieces.
PROBES = ("", " ", "  a  b ", "Line one\nline two\r\n\ttab", "naïve été straße", "\U0001f600 க்ஷ ▁x", "<s> </s> <unk> <0x41>", "$$$ 123,456.78 foo_bar", "\x00\x01  　 ﻿", "a" * 300)


def encode(docs: DataFrame, path: str = MODEL, keep: list[str] | None = None, every: int = 64) -> DataFrame:
    """docs with ids (array of int), n_tokens, n_fallback (byte pieces), round_trip and parity.

    round_trip: decoding the ids gives the text back (for a model whose normaliser changes nothing, always true).
    parity: the sentencepiece library gives the same ids. It's checked for PROBES at each task's start, where a difference
    is an error, and for every row: by each of its words, as no piece joins two of them, and where the text's CRC is
    divisible by ``every`` by the whole text too.
    Null texts are encoded as empty ones, which have no ids.
    """
    return _encoded(docs, path, keep, every, digest=False)


def encode_digest(docs: DataFrame, path: str = MODEL, keep: list[str] | None = None, every: int = 64) -> DataFrame:
    """As encode(), with ids_sha256 (of the ids as little-endian 32-bit numbers) in place of the ids."""
    return _encoded(docs, path, keep, every, digest=True)


def decode(df: DataFrame, path: str = MODEL, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; null ids give null."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load(path)
        for ids in batches:
            yield pd.Series([None if x is None else codec.decode([int(i) for i in x]) for x in ids], dtype=object)

    text = F.pandas_udf(run, "string")
    return df.withColumn(out, text(F.col(ids_col)))


def _encoded(docs: DataFrame, path: str, keep: list[str] | None, every: int, digest: bool) -> DataFrame:
    def make():
        import zlib

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        codec = load(path)
        wrong = parity(codec, path, list(PROBES))
        if wrong:
            raise ValueError(f"the rebuilt tokenizer differs from sentencepiece for {wrong[0]!r}")
        is_byte = np.zeros(len(codec.model.pieces), bool)
        is_byte[list(codec.bytes)] = True

        def compute(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in range(5)]
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                for t, ids, same in zip(part, *codec.verified(part), strict=True):
                    if same and zlib.crc32(t.encode("utf-8", "replace")) % every == 0:
                        same = codec.check.encode(t) == ids.tolist()
                    row = (hashlib.sha256(ids).hexdigest() if digest else ids, len(ids), int(is_byte[ids].sum()), codec.decode(ids) == t, same)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
            return out

        return compute

    first = {"ids_sha256": StringType()} if digest else {"ids": ArrayType(IntegerType())}
    return add_columns(docs, "text", fields(**first, n_tokens=LongType(), n_fallback=LongType(), round_trip=BooleanType(), parity=BooleanType()), make, keep)
