"""Secret scans: patterns with fixed meanings, and a character convolutional network over every further candidate.

The base patterns' spans are always reported. Every other run of 16 or more key-like characters is a candidate, and so
is what base spans leave of a run, from that length on. A network in numpy reads a candidate's characters with those
around it, in windows that overlap where it's long; the candidate's score is the highest of its windows. It's trained on labelled findings: the base findings and
plain candidates of a bounded sample of documents, with generated credentials of common forms and generated harmless
runs, some of them long runs that hold a credential anywhere. Scores are calibrated on findings held out from training, and the threshold is the highest that keeps the wanted
recall on them.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .common import add_columns, fields

#: Fixed patterns. A match whose ``group`` is shorter than ``least`` is dropped after it has been matched.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run of 24 or more: as [0-9a-f]+ with shorter runs dropped
)
KINDS = {k: i for i, k in enumerate([*(b[0] for b in BASE), "model"])}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Characters of a window: WIDTH. The first starts BEFORE characters ahead of the candidate, the last ends AFTER behind it,
#: and between them one starts every STEP at most, so any WIDTH - STEP characters of a candidate lie whole in a window.
BEFORE, AFTER, WIDTH, STEP = 24, 24, 88, 44
#: Candidates have so many characters, and a window is a secret's from so many of them on.
LEAST = 16
#: Documents that findings are taken from, findings of each label at most, and the recall that the threshold keeps.
SAMPLE, MOST, RECALL = 3000, 1500, 0.98
CLASSES = 48
CODE = {c: 2 + i for i, c in enumerate(string.ascii_lowercase)} | {c: 2 + i for i, c in enumerate(string.ascii_uppercase)}
CODE |= {c: 28 + i for i, c in enumerate(string.digits)} | {c: 38 + i for i, c in enumerate("+/_.=-:\"' ")}
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind; by start, then kind."""
    out = [(kind, m.start(), m.end()) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], KINDS[s[0]]))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Key-like runs without their parts in base spans: what is left of a run is as many candidates as have LEAST characters."""
    taken: list[list[int]] = []
    for a, z in sorted((a, z) for _, a, z in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], z)
        else:
            taken.append([a, z])
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        a, z = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < z:
            if taken[j][0] - a >= LEAST:
                out.append((a, taken[j][0]))
            a = taken[j][1]
            j += 1
        if z - a >= LEAST:
            out.append((a, z))
    return out


def starts(a: int, z: int) -> list[int]:
    """Where the windows of a candidate start, by their position in the text; the first may be negative."""
    first, last = a - BEFORE, z + AFTER - WIDTH
    n = max(0, -(-(last - first) // STEP))
    return [first + (last - first) * k // n for k in range(n + 1)] if n else [first]


def windows(items: list[tuple[str, int, int]], at: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, start, end) the classes of a window's characters, and three bits: inside, upper case, digit.

    at: where each window starts; without it, each is its candidate's first.
    """
    codes, bits = np.zeros((len(items), WIDTH), np.int64), np.zeros((len(items), WIDTH, 3), np.float32)
    for i, (text, a, z) in enumerate(items):
        start = a - BEFORE if at is None else at[i]
        first = max(0, start)
        for j, c in enumerate(text[first : start + WIDTH], first - start):
            codes[i, j] = CODE.get(c, 1)
            bits[i, j] = (a <= start + j < z, c.isupper(), c.isdigit())
    return codes, bits


class Network:
    """Embedding, convolution of five characters, ReLU, maximum and mean over the window, logistic output."""

    DIM, TAPS, FILTERS = 10, 5, 24

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d = self.DIM + 3
        self.p = {
            "E": r.normal(0, 0.3, (CLASSES, self.DIM)), "C": r.normal(0, (2 / (d * self.TAPS)) ** 0.5, (d * self.TAPS, self.FILTERS)),
            "c": np.zeros(self.FILTERS), "w": r.normal(0, 0.2, 2 * self.FILTERS), "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, codes: np.ndarray, bits: np.ndarray):
        x = np.concatenate([self.p["E"][codes], bits], 2)
        n = WIDTH - self.TAPS + 1
        cols = np.concatenate([x[:, t : t + n] for t in range(self.TAPS)], 2)
        a = np.maximum(cols @ self.p["C"] + self.p["c"], 0)
        top = a.argmax(1)
        h = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
        return cols, a, top, h, h @ self.p["w"] + self.p["b"][0]

    def logits(self, codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 128], bits[i : i + 128])[-1] for i in range(0, len(codes), 128)] or [np.zeros(0, np.float32)])

    def gradients(self, codes: np.ndarray, bits: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, a, top, h, z = self.forward(codes, bits)
        g = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        gh = g[:, None] * self.p["w"]
        k = self.FILTERS
        ga = np.repeat(gh[:, None, k:] / a.shape[1], a.shape[1], 1)
        np.put_along_axis(ga, top[:, None], np.take_along_axis(ga, top[:, None], 1) + gh[:, None, :k], 1)
        ga *= a > 0
        flat = ga.reshape(-1, k)
        gx, n, d = np.zeros((*codes.shape, self.DIM + 3), np.float32), a.shape[1], self.DIM + 3
        gcols = ga @ self.p["C"].T
        for t in range(self.TAPS):
            gx[:, t : t + n] += gcols[:, :, t * d : (t + 1) * d]
        ge = np.zeros_like(self.p["E"])
        np.add.at(ge, codes.ravel(), gx[:, :, : self.DIM].reshape(-1, self.DIM))
        return {"E": ge, "C": cols.reshape(-1, cols.shape[2]).T @ flat, "c": flat.sum(0), "w": h.T @ g, "b": g.sum(keepdims=True)}

    def train(self, codes: np.ndarray, bits: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.004, seed: int = 6) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        r, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            for at in np.array_split(r.permutation(len(y)), max(1, len(y) // 64)):
                step += 1
                for k, g in self.gradients(codes[at], bits[at], y[at]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)

    def best(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """For each (text, start, end) the highest logit of its windows."""
        at = [(i, s) for i, (_, a, z) in enumerate(items) for s in starts(a, z)]
        out = np.full(len(items), -np.inf, np.float32)
        for k in range(0, len(at), 2048):
            which, where = zip(*at[k : k + 2048], strict=True)
            np.maximum.at(out, list(which), self.logits(*windows([items[i] for i in which], where)))
        return out

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling on held-out findings' best logits; then the highest threshold at which ``recall`` of the secrets are found."""
        for _ in range(300):
            g = 1 / (1 + np.exp(-(self.scale * z + self.shift))) - y
            self.scale = float(np.clip(self.scale - 0.05 * (g * z).mean(), 0.05, 10))
            self.shift -= float(0.5 * g.mean())
        s = np.sort(self.scaled(z)[y == 1])
        self.threshold = float(s[int((1 - recall) * len(s))] - 1e-6) if len(s) else 0.5

    def scores(self, codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(codes, bits))

    def scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))


def generated(n: int, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of made-up credentials (1) and harmless runs (0) in short contexts."""
    r = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick("etaoinshrdlucm", r.randint(2, 9))
    secret = (
        lambda: pick(alnum, r.randint(20, 44)), lambda: pick(alnum + "+/", 40), lambda: base64.b64encode(r.randbytes(r.randint(15, 36))).decode(),
        lambda: pick(["ghp_", "sk_live_", "xoxb-", "pk_", "key-"], 1) + pick(alnum, 32), lambda: pick(string.ascii_uppercase + string.digits, r.randint(20, 40)),
        lambda: pick("0123456789ABCDEF", r.randint(24, 64)), lambda: pick(alnum, 24) + "." + pick(alnum + "_-", 27),
    )
    plain = (
        lambda: "".join(word() for _ in range(5))[:40].ljust(16, "e"), lambda: (word() + word() + word()).upper().ljust(16, "E"), lambda: word() + word() + "." + word() + ".example.com",
        lambda: pick(string.digits, r.randint(16, 20)), lambda: "-".join(word() for _ in range(5)), lambda: "/".join(word() for _ in range(6)), lambda: "_".join(word() for _ in range(5)),
        lambda: r.choice("=-_.") * r.randint(16, 60), lambda: (word().capitalize() + word() + word() + word()).ljust(16, "a") + ".", lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{pick(string.digits, 6)}",
    )
    out = []
    for i in range(n):
        label = i % 2
        run = r.choice(secret if label else plain)()
        before = " ".join(word() for _ in range(4)) + r.choice([" ", ": ", " = ", ' "', "\n"])
        if len(run) >= 16:
            out.append((before + run + " " + " ".join(word() for _ in range(8)), len(before), len(before) + len(run), label))
    return out


def generated_long(n: int, seed: int = 12) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, secret's start, its end) of made-up long runs: harmless, with an empty secret, or with a credential at any place."""
    r = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick("etaoinshrdlucmpgbyfvwk", r.randint(2, 9))
    joined = lambda sep, k: sep.join(r.choice([word, word, word, lambda: word().capitalize(), lambda: str(r.randint(0, 2030))])() for _ in range(k))
    plain = (
        lambda k: "/" + joined("/", k), lambda k: joined(r.choice("-_."), k), lambda k: word() + "." + word() + ".example.com/" + joined("/", k), lambda k: "/".join(joined("=", 2) for _ in range(k // 2 + 1)),
        lambda k: "".join(word() for _ in range(k)), lambda k: r.choice("=-_." + string.ascii_lowercase) * (7 * k), lambda k: pick(string.digits, 5 * k), lambda k: joined("_", k).upper(),
    )
    secret = (
        lambda: pick(alnum, r.randint(20, 44)), lambda: pick(alnum + "+/", 40), lambda: base64.b64encode(r.randbytes(r.randint(15, 180))).decode(),
        lambda: pick(["ghp_", "sk_live_", "xoxb-", "pk_", "key-"], 1) + pick(alnum, 32), lambda: pick(string.ascii_uppercase + string.digits, r.randint(20, 40)),
        lambda: pick("0123456789ABCDEF", r.randint(24, 128)), lambda: pick(alnum, 24) + "." + pick(alnum + "_-", 27),
    )
    out = []
    for i in range(n):
        ahead = r.choice(plain)(r.randint(3, 24)) + r.choice("/=._-") if i % 2 == 0 or r.random() < 0.8 else ""
        key = r.choice(secret)() if i % 2 else ""
        behind = r.choice("/=._-") + r.choice(plain)(r.randint(3, 16)) if r.random() < 0.3 else ""
        before, run = " ".join(word() for _ in range(4)) + r.choice([" ", ": ", " = ", ' "', "\n"]), ahead + key + behind
        at = len(before) + len(ahead)
        if len(run) >= LEAST:
            out.append((before + run + r.choice([" ", '"', "\n", ", "]) + " ".join(word() for _ in range(8)), len(before), len(before) + len(run), at, at + len(key)))
    return out


def findings(texts: list[str], most: int = MOST) -> list[tuple[str, int, int, int]]:
    """Labelled findings of documents: the values of base spans are secrets; runs without both digits and letters aren't."""
    found: dict[int, list] = {0: [], 1: []}
    for t in texts:
        base = base_spans(t)
        for kind, a, z in base:
            if kind != "assign" and len(found[1]) < most:
                found[1].append((t[max(0, a - BEFORE) : z + WIDTH], min(a, BEFORE), min(a, BEFORE) + z - a, 1))
        edges = {x for _, *ends in base for x in ends}  # what base spans leave of a run may belong to a secret
        for a, z in candidates(t, base):
            run = t[a:z].rstrip(".")
            if len(found[0]) < most and a not in edges and z not in edges and (run.isalpha() or run.isdigit()):
                found[0].append((t[max(0, a - BEFORE) : z + WIDTH], min(a, BEFORE), min(a, BEFORE) + z - a, 0))
    return found[0] + found[1]


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 3) -> Network:
    """Trains on the findings of the ``sample`` documents whose ids hash lowest, one text for each id: of several that whose hash is least."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64(F.lit("secrets"), "doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("__id")))
    rows = rows.groupBy("doc_id").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    texts = [t for _, t in sorted((r[0] or 0, r[1]) for r in rows.collect())]
    items = [(t, a, z, a, z if label else a) for t, a, z, label in findings(texts) + generated(3000)] + generated_long(2000)
    random.Random(seed).shuffle(items)
    net, cut = Network(), len(items) * 3 // 4
    net.train(*labelled_windows(items[:cut]))
    held = items[cut:]
    net.calibrate(net.best([x[:3] for x in held]), np.array([x[4] > x[3] for x in held], np.float32))
    return net


def labelled_windows(items: list[tuple[str, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of (text, start, end, secret's start, its end) and their labels, without those that hold a few characters of a secret only."""
    rows = []
    for text, a, z, from_, to in items:
        for s in starts(a, z):
            n = max(0, min(to, s + WIDTH) - max(from_, s))
            if n == 0 or n >= LEAST:
                rows.append(((text, a, z), s, n > 0))
    return *windows([r[0] for r in rows], [r[1] for r in rows]), np.array([r[2] for r in rows], np.float32)


def spans_of(texts: list[str], net: Network) -> list[list[Span]]:
    """All spans of each text, by start, then kind: the base ones and the candidates that the network takes for secrets."""
    out = [base_spans(t) for t in texts]
    items = [(i, a, z) for i, t in enumerate(texts) for a, z in candidates(t, out[i])]
    for (i, a, z), s in zip(items, net.scaled(net.best([(texts[i], a, z) for i, a, z in items])), strict=True):
        if s >= net.threshold:
            out[i].append(("model", a, z))
    return [sorted(s, key=lambda x: (x[1], KINDS[x[0]])) for s in out]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def scan(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans: positions are code points of the whole text, ends exclusive.

    Null texts are scanned as empty ones and have no spans.
    """

    def make():
        def compute(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in range(5)]
            for spans in spans_of(texts, net):
                base = [s for s in spans if s[0] != "model"]
                row = [sum(s[0] == kind for s in base) for kind, *_ in BASE]
                for col, v in zip(out, (*row, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                    col.append(v)
            return out

        return compute

    return add_columns(docs, "text", fields(n_assign=LongType(), n_access=LongType(), n_hex=LongType(), base_sha256=StringType(), spans=StringType()), make, keep)


def redact(docs: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by ``mark`` (overlapping spans by one), and redacted: the spans, as strings."""

    def make():
        def compute(texts: list[str]) -> list[list]:
            new, old = [], []
            for t, spans in zip(texts, spans_of(texts, net), strict=True):
                out, until = [], 0
                for _, a, z in spans:
                    if a >= until:
                        out += [t[until:a], mark]
                    until = max(until, z)
                new.append("".join([*out, t[until:]]))
                old.append([f"{k}:{a}:{z}" for k, a, z in spans])
            return [new, old]

        return compute

    return add_columns(docs, "text", fields(text=StringType(), redacted=ArrayType(StringType())), make)
