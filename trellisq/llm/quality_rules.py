"""Quality rules as a short-circuit cascade.

Each rule rejects a document by one statistic of its whole text. Run on a bounded sample, every rule gets a cost
(seconds a document) and a selectivity (share rejected); the cascade runs them by rejections per second, the highest
first, and a document leaves at the first rule that rejects it. The order changes the time and ``first_rule``, never
whether a document is kept.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType

from .common import WORDS, add_columns, fields

SYMBOLS = "#*$%&|<>"
NOT_SYMBOL = str.maketrans("", "", SYMBOLS)
#: Rows that the costs and selectivities are estimated on.
SAMPLE = 500
WINDOW = 5


@dataclass
class Facts:
    """Statistics of one text, each computed once and only when a rule or an output asks for it."""

    text: str
    _words: list[str] | None = None
    _seen: dict[str, float] = field(default_factory=dict)

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = WORDS.findall(self.text)
        return self._words

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = STATISTICS[name](self)
        return self._seen[name]


def repeated_window_words(words: list[str], width: int = WINDOW) -> int:
    """Number of words that lie in a window of ``width`` words whose sequence occurs at least twice in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # exact: windows are numbered by pairs of numbers, so that no two different ones meet
    code, size, width_now = ids, len(number), 1
    while width_now < width:
        step = min(width_now, width - width_now)
        pair = code[: len(code) - step] * np.int64(size) + code[step:]
        distinct, code = np.unique(pair, return_inverse=True)
        size, width_now = len(distinct), width_now + step
        if size == len(code):  # no window of this width repeats, so no wider one does
            return 0
    again = np.flatnonzero(np.bincount(code, minlength=size)[code] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def repeated_lines(f: Facts) -> int:
    seen, again = set(), 0
    for line in f.text.split("\n"):
        if line in seen:
            again += 1
        elif WORDS.search(line):
            seen.add(line)
    return again


LETTER = re.compile(r"[^\W\d_]")
STATISTICS: dict[str, Callable[[Facts], float]] = {
    "n_words": lambda f: len(f.words),
    "word_chars": lambda f: sum(map(len, f.words)),
    "n_symbols": lambda f: len(f.text) - len(f.text.translate(NOT_SYMBOL)) if any(s in f.text for s in SYMBOLS) else 0,
    "n_dup_lines": repeated_lines,
    "n_repeat_words": lambda f: repeated_window_words(f.words),
    "n_upper_words": lambda f: sum(map(str.isupper, f.words)),
    "n_plain_words": lambda f: sum(1 for w in f.words if LETTER.search(w)),
    "n_lines": lambda f: f.text.count("\n") + 1,
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


#: The base rules come with the operator; the others reject junk that no ordinary prose of any language reaches.
RULES = (
    Rule("too_few_words", lambda f: f.n_words < 10),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 25 * f.n_words),
    Rule("symbols", lambda f: 5 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
    Rule("upper_case", lambda f: 10 * f.n_upper_words > 7 * f.n_words),
    Rule("few_letters", lambda f: 10 * f.n_plain_words < 6 * f.n_words),
)
BASE = ("too_few_words", "repeated_windows")


def order(texts: list[str], rules=RULES, clock: Callable[[], float] = time.perf_counter) -> list[tuple[str, float, float]]:
    """(rule, cost in seconds, share rejected) by rejections per second, the highest first; ties by name."""
    found = []
    for rule in rules:
        began, rejected = clock(), 0
        for t in texts:
            rejected += rule.rejects(Facts(t))
        found.append((rule.name, max(clock() - began, 1e-9) / max(1, len(texts)), rejected / max(1, len(texts))))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0]))


def cascade(f: Facts, rules: list[Rule]) -> str | None:
    """Name of the first rule that rejects, None if none does."""
    return next((r.name for r in rules if r.rejects(f)), None)


def apply(docs: DataFrame, rules=RULES, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, first_rule.

    The order of the rules is estimated on the ``sample`` rows whose hashes are least; all rows are judged, by their whole texts. Null and empty
    texts have no words and fail the base. first_rule: the rule that ended the cascade, null for a kept document.
    """
    hashed = docs.select("text", F.xxhash64(*[c for c in docs.columns if c == "doc_id"], "text").alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(sample)  # hashes alone; their texts are fetched after that
    texts = [r[1] or "" for r in hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.first("text").alias("text")).orderBy("h").collect()]
    names = [name for name, _, _ in order(texts, rules)]

    def make():
        by_name = {r.name: r for r in rules}
        ordered = [by_name[n] for n in names]
        base = [by_name[n] for n in BASE]

        def compute(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in range(8)]
            for t in texts:
                f = Facts(t)
                first = cascade(f, ordered)
                row = (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, any(r.rejects(f) for r in base), first is None, first)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            return out

        return compute

    added = fields(
        n_words=LongType(), word_chars=LongType(), n_symbols=LongType(), n_dup_lines=LongType(), n_repeat_words=LongType(),
        base_failed=BooleanType(), kept=BooleanType(), first_rule=StringType(),
    )
    return add_columns(docs, "text", added, make, keep)
