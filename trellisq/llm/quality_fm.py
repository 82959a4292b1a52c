"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j). The pairwise sum is computed in time linear in
the number of features, as half of (sum v x)^2 - sum (v x)^2 in each of the factors. Trained in numpy on a bounded sample.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType

from .common import WORDS, add_columns, fields, labelled_sample
from .sparse import Adam, Rows, scatter, sigmoid

#: Buckets of hashed words; the statistics follow them. FACTORS: rank of the interactions.
BUCKETS, FACTORS = 1 << 15, 6
#: Labelled documents that the model is fitted on at most, and the score from which a text is called good.
SAMPLE, GOOD = 6000, 0.5
KNOWN_WORDS = 300_000
#: Structure statistics, then metadata (length and share of multi-byte characters, known without reading words).
STATS = ("words", "word_length", "distinct", "upper", "digits", "symbols", "ends", "lines", "line_length", "dup_lines", "short_words", "chars", "wide")
SYMBOLS = {ord(c): None for c in "#*$%&|<>!{}[]~^_=+\\/"}
DIGITS = {ord(c): None for c in "0123456789"}


def structure(text: str, words: list[str], distinct: int) -> list[float]:
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    length = sum(map(len, words))
    return [
        np.log1p(len(words)), length / n, distinct / n, sum(map(str.isupper, words)) / n, 1 - len(text.translate(DIGITS)) / chars,
        1 - len(text.translate(SYMBOLS)) / chars, (text.count(".") + text.count("!") + text.count("?")) / n, np.log1p(len(lines)),
        np.log1p(chars / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(w) < 3 for w in words) / n, np.log1p(len(text)),
        len(text.encode("utf-8", "replace")) / chars - 1,
    ]


class Model:
    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.p, self.mean, self.spread = p, mean, spread
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return {"p": self.p, "mean": self.mean, "spread": self.spread, "known": {}}

    def bucket(self, words) -> list[int]:  # noqa: ANN001
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        return [known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS) for w in words]

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts together: word buckets, their number in each text, and the scaled statistics."""
        ids, n, stats = [], [], []
        for t in texts:
            words = WORDS.findall(t)
            distinct = set(words)
            ids.append(self.bucket(distinct))
            n.append(len(distinct))
            stats.append(structure(t, words, len(distinct)))
        s = np.clip((np.array(stats).reshape(len(texts), len(STATS)) - self.mean) / self.spread, -4, 4) / len(STATS) ** 0.5
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array(n, np.int64), s

    def scores(self, texts: list[str]) -> np.ndarray:
        ids, n, s = self.features(texts)
        x = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n).astype(np.float32)
        w, v = self.p["w"], self.p["V"]
        ends = np.cumsum(n)

        def by_text(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
            return total[ends] - total[ends - n]

        vx = v[ids] * x[:, None]
        one = by_text(vx) + s @ v[BUCKETS:]
        two = by_text(vx**2) + s**2 @ v[BUCKETS:] ** 2
        return sigmoid(self.p["b"][0] + by_text(w[ids] * x) + s @ w[BUCKETS:] + 0.5 * (one**2 - two).sum(1))


def train(texts: list[str], y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, decay: float = 2e-5, seed: int = 2) -> Model:
    """Fits the machine; the same texts and labels give the same model. Without both labels the scores are the label's share."""
    size = BUCKETS + len(STATS)
    r = np.random.default_rng(seed)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    p = {"b": np.full(1, base, np.float32), "w": np.zeros(size, np.float32), "V": np.zeros((size, FACTORS), np.float32)}
    model = Model(p, np.zeros(len(STATS)), np.ones(len(STATS)))
    if not len(y) or y.min() == y.max():
        return model
    p["V"][:] = r.normal(0, 0.05, p["V"].shape)
    raw = np.array([structure(t, w := WORDS.findall(t), len(set(w))) for t in texts])
    model.mean, model.spread = raw.mean(0), np.maximum(raw.std(0), 1e-3)
    ids, n, s = model.features(texts)
    cut = np.split(ids, np.cumsum(n)[:-1])
    tail = BUCKETS + np.arange(len(STATS))
    x = Rows([(np.concatenate([i, tail]), np.concatenate([np.full(len(i), 1 / max(1, len(i)) ** 0.5), si])) for i, si in zip(cut, s, strict=True)])
    adam = Adam(p, rate)
    for _ in range(epochs):
        for at in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
            ids, vals, owner, starts = x.take(at)
            vx = p["V"][ids] * vals[:, None]
            one = np.add.reduceat(vx, starts, 0)
            z = p["b"][0] + np.add.reduceat(p["w"][ids] * vals, starts) + 0.5 * (one**2 - np.add.reduceat(vx**2, starts, 0)).sum(1)
            g = ((sigmoid(z) - y[at]) / len(at)).astype(np.float32)
            gx = g[owner] * vals
            adam.update({"b": g.sum(keepdims=True), "w": scatter(ids, gx, size) + decay * p["w"], "V": scatter(ids, gx[:, None] * (one[owner] - vx), size) + decay * p["V"]})
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, "quality", sample)
    return train([t for _, t, _ in rows], np.array([y for *_, y in rows], np.float32))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = GOOD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on), from whole texts only; null texts count as empty."""

    def make():
        def compute(texts: list[str]) -> list[list]:
            out: list[float] = []
            for at in range(0, len(texts), 128):
                out += model.scores(texts[at : at + 128]).tolist()
            return [out, [int(s >= threshold) for s in out]]

        return compute

    return add_columns(docs, "text", fields(score=DoubleType(), predicted=IntegerType()), make, keep)
