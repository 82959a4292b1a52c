"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's features are the word itself and its character n-grams, hashed; a text is the average of its features'
embeddings, and a softmax layer over that average gives two classes. Embeddings and layer are trained jointly in
numpy. A misspelling that training never met still shares most n-gram vectors with the word it comes from.

For scoring, the layer is folded into the embeddings: each feature has one number, the difference of the two classes'
logits, and each word the sum over its features. That is the same model, since averaging and the layer are linear.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType

from .common import add_columns, fields, labelled_sample
from .sparse import Adam, Rows, scatter, sigmoid

TOKENS = re.compile(r"\w+")
BUCKETS, SIZES, DIM = 1 << 17, (3, 4, 5, 6), 8
#: Labelled documents that the model is fitted on at most, and the score from which a text is called toxic.
SAMPLE, TOXIC = 6000, 0.7
#: A text's average is scaled by this ahead of the layer, so that few words in a long text can still decide.
SCALE = 100.0
#: Features without a vector that each text's average counts besides its own, so that one odd feature doesn't decide a short text.
NEUTRAL = 100
#: A feature must occur in so many sample texts, and differ between the labels by so many standard errors, to have a vector.
LEAST, SIGMAS = 5, 5.0
#: Words whose sums a task remembers at most, beside those of one batch.
KNOWN_WORDS = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, and for each the place of its word; n-grams are over the characters of <word>."""
    raw = ["<" + w + ">" for w in words]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer("".join(raw).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(b))  # characters from here to the word's end
    ids, at = [np.fromiter((zlib.crc32(r.encode("utf-8", "replace")) % BUCKETS for r in raw), np.int64, len(raw))], [np.arange(len(raw))]
    for k in SIZES:
        ok = np.flatnonzero(left >= k)
        h = np.full(len(ok), k, np.uint64)
        for j in range(k):
            h = h * np.uint64(1_000_003) + b[ok + j]
        ids.append((h * MIX >> np.uint64(40)).astype(np.int64) % BUCKETS)
        at.append(owner[ok])
    return np.concatenate(ids), np.concatenate(at)


class Model:
    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias
        self.known: dict[str, tuple[float, int]] = {}

    def scores(self, texts: list[str]) -> np.ndarray:
        """For each text the probability of label 1; a text without words has the bias's."""
        split = [tokens(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        if new:
            ids, at = subwords(new)
            sums, counts = np.bincount(at, self.values[ids], len(new)), np.bincount(at, minlength=len(new))
            self.known.update(zip(new, zip(sums.tolist(), counts.tolist(), strict=True), strict=True))
        flat = np.fromiter(chain.from_iterable(chain.from_iterable(map(self.known.__getitem__, words)) for words in split), np.float64).reshape(-1, 2)
        n = np.fromiter(map(len, split), np.int64, len(split))
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(flat, 0)])
        ends = np.cumsum(n)
        s = total[ends] - total[ends - n]
        return sigmoid(SCALE * s[:, 0] / (s[:, 1] + NEUTRAL) + self.bias)

    def __getstate__(self):
        return {"values": self.values, "bias": self.bias, "known": {}}


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features whose shares of texts differ between the labels by more than chance: the others get no vector."""
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    share = [sum((np.bincount(ids, minlength=BUCKETS) for ids, label in zip(rows, y, strict=True) if label == k), np.zeros(BUCKETS)) / n[k] for k in (0, 1)]
    both = (share[0] * n[0] + share[1] * n[1]) / sum(n)
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    return (np.abs(share[1] - share[0]) > SIGMAS * spread) & (both * sum(n) >= LEAST)


def train(texts: list[str], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.03, decay: float = 1e-6, seed: int = 1) -> Model:
    """Fits embeddings and layer; the same texts and labels give the same model. Without both labels the scores are the label's share."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rows = []
    for t in texts:
        ids, n = np.unique(subwords(tokens(t) or [""])[0], return_counts=True)
        rows.append((ids.astype(np.int32), (n / (n.sum() + NEUTRAL)).astype(np.float32)))
    told = telling([ids for ids, _ in rows], y)
    for k, (ids, vals) in enumerate(rows):
        ok = told[ids]
        rows[k] = (ids[ok], vals[ok]) if ok.any() else (np.zeros(1, np.int32), np.zeros(1, np.float32))
    x = Rows(rows)
    del rows
    r = np.random.default_rng(seed)
    p = {"E": r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), "W": r.normal(0, 0.5, (DIM, 2)).astype(np.float32), "b": np.log(np.array([1 - y.mean(), y.mean()], np.float32))}
    adam = Adam(p, rate)
    for _ in range(epochs):
        for at in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
            ids, vals, owner, starts = x.take(at)
            mean = np.add.reduceat(p["E"][ids] * vals[:, None], starts, 0) * SCALE
            z = mean @ p["W"] + p["b"]
            e = np.exp(z - z.max(1, keepdims=True))
            g = e / e.sum(1, keepdims=True)
            g[np.arange(len(at)), y[at].astype(int)] -= 1
            g = (g / len(at)).astype(np.float32)
            gm = g @ p["W"].T * SCALE
            adam.update({"E": scatter(ids, gm[owner] * vals[:, None], BUCKETS) + decay * p["E"], "W": mean.T @ g + decay * p["W"], "b": g.sum(0)})
    w = p["W"][:, 1] - p["W"][:, 0]
    return Model(np.where(told, p["E"] @ w, 0).astype(np.float32), float(p["b"][1] - p["b"][0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, "toxic", sample)
    return train([t for _, t, _ in rows], np.array([y for *_, y in rows], np.float32))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = TOXIC) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on), from whole texts only. Null and empty texts: the bias's score."""

    def make():
        def compute(texts: list[str]) -> list[list]:
            out: list[float] = []
            for at in range(0, len(texts), 256):
                out += model.scores(texts[at : at + 256]).tolist()
            return [out, [int(s >= threshold) for s in out]]

        return compute

    return add_columns(docs, "text", fields(score=DoubleType(), predicted=IntegerType()), make, keep)
