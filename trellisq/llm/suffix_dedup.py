"""Exact repeats of LENGTH bytes by prefix doubling over content-defined anchors.

A suffix array of every byte position isn't needed to know which strings of LENGTH bytes repeat. Of the starts that
share an anchor (the position of the least hash in the WINDOW grams from the start on, which depends on those bytes
alone) only the anchor is ranked; two equal strings have their anchors at the same distance from their starts. The
anchors of a text cut it into chunks, and all strings of an anchor's starts hold the chunks of its first CORE bytes.

1. Prefix doubling: a chunk's first rank comes from its bytes. Round after round Spark sorts the pairs of the ranks of k
   chunks from a position on and of the k chunks behind those, and numbers the pairs that occur again: these are the
   ranks of 2k chunks. A position leaves as soon as its rank is unique; an anchor is done when two overlapping ranks
   cover its chunks.
2. What stays grows by bytes at both ends: blocks of BLOCK starts, by the rank before and the LENGTH - BLOCK + 1 bytes
   that all strings of a block hold, which gives new ranks; then start by start, by those and all LENGTH bytes.

At each step, starts whose longest common hull (all bytes that any of their strings holds) occurs again as a whole are
known to repeat, and only one row of each such hull goes on, as a partner for others. So the work in a later step is
near the ends of repeats alone. Chunks and the bytes beside ranks are compared by 64-bit hashes, the first keys by a
second hash of all CORE bytes too.

``repeats_passage`` finds shorter passages, by words: the same anchors over words, and hashes of PASSAGE words.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.fixpoint import shared_folder
from .common import cut_lineage, tuned

LENGTH, WINDOW, BLOCK, GRAM = 400, 145, 16, 8
#: Bytes from an anchor on that are in the strings of all its starts, and how far behind it a window may start there.
CORE = LENGTH - WINDOW + 1
REACH = CORE - GRAM + 1 - WINDOW
#: Chunks that ranks are made for at most, of the two or three that CORE bytes usually hold: of periodic text, where every
#: position is an anchor, the hash of the CORE bytes tells the rest. So three rounds do, whatever the texts.
RUN = 7
#: LENGTH, WINDOW and GRAM for passages, in words.
PASSAGE, WORD_WINDOW, WORD_GRAM = 51, 32, 4
#: Starts of a text that are worked on at once; very long texts are read piece by piece, short ones together up to so many bytes or words.
PIECE, TOGETHER = 1 << 20, 1 << 18
_M1, _M2, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    return (x ^ (x >> np.uint64(32))) * _M2


def _need_powers(n: int) -> None:
    if len(_powers[0]) <= n:
        for i, base in enumerate((_P, _INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + n // 4, base)]))


class Hashes:
    """Hashes of substrings of a piece, each in constant time. grams: a hash for each ``gram`` units, bytes or words."""

    def __init__(self, grams: np.ndarray, gram: int):
        self.grams, self.gram = grams, gram
        _need_powers(len(grams))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * _powers[0][: len(grams)])])

    @classmethod
    def of_bytes(cls, raw: bytes) -> Hashes:
        x = np.frombuffer(raw, np.uint8).astype(np.uint64)
        for k in (1, 2, 4):
            x = x[:-k] | (x[k:] << np.uint64(8 * k))
        return cls(_mix(x), GRAM)

    @classmethod
    def of_words(cls, words: np.ndarray) -> Hashes:
        x = words
        for k in (1, 2):
            x = _mix(x[:-k] * _P + x[k:])
        return cls(x, WORD_GRAM)

    def of(self, start: np.ndarray, length) -> np.ndarray:  # noqa: ANN001
        """Of length >= gram units from each start on."""
        return _mix((self.prefix[start + length - self.gram + 1] - self.prefix[start]) * _powers[1][start])

    def minima(self, window: int) -> np.ndarray:
        """For each window of grams the place of the least, of equal ones the first."""
        low = np.uint64((1 << 24) - 1)
        m = (self.grams & ~low) | np.arange(len(self.grams), dtype=np.uint64)
        w = 1
        while 2 * w <= window:
            m, w = np.minimum(m[:-w], m[w:]), 2 * w
        if w < window:
            m = np.minimum(m[: w - window], m[window - w :])
        return (m & low).astype(np.int64)

    def hull(self, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
        """Of all units that strings of ``length`` from the starts lo to hi on hold, with their place around p."""
        return _mix(self.of(lo, hi - lo + length) ^ ((p - lo).astype(np.uint64) * _M1) ^ ((p - hi).astype(np.uint64) * _M2))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those from first[1] on, and so on."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _changes(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def owned(minima: np.ndarray, off: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, anchor, first start, last start) for the anchors of so many starts from each off on: strings that lie in a piece."""
    at = _ranges(off, starts)
    own = minima[at]
    first = _changes(own)
    last = np.concatenate([first[1:] - 1, [len(own) - 1]])
    return np.repeat(np.arange(len(off)), starts)[first], own[first], at[first], at[last]


def pieces(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashes]]:
    """(row, its first start, place in the hashes, bytes) of pieces, many in one go, that together hold every string of LENGTH bytes once; the hashes."""
    held: list[tuple[int, int, bytes]] = []

    def out() -> tuple:
        size = np.array([len(x) for *_, x in held])
        return np.array([r for r, *_ in held]), np.array([a for _, a, _ in held]), np.cumsum(size) - size, size, Hashes.of_bytes(b"".join(x for *_, x in held))

    n = 0
    for row, raw in enumerate(raws):
        for at in range(0, len(raw) - LENGTH + 1, PIECE):
            held.append((row, at, raw[at : at + PIECE + LENGTH - 1]))
            n += len(held[-1][2])
            if n >= TOGETHER:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _every(h: Hashes, m: np.ndarray, off: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, anchor) of all windows that lie in a piece."""
    count = size - GRAM + 2 - WINDOW
    own = m[_ranges(off, count)]
    first = _changes(own)
    return np.repeat(np.arange(len(off)), count)[first], own[first]


def chunks(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash of a chunk's bytes, chunks that its anchor's strings all hold); 0 chunks where no start has the anchor.

    A chunk reaches from an anchor to the gram of the next one, so both are known from it. Behind a piece's last one is a
    gap, with -1 chunks.
    """
    for row, _, off, size, h in pieces(raws):
        m = h.minima(WINDOW)
        _, p, *_ = owned(m, off, size - LENGTH + 1)
        of, every = _every(h, m, off, size)
        whole = np.flatnonzero(of[1:] == of[:-1])
        width = (every[1:] - every[:-1])[whole]
        names, n = np.zeros(len(every), np.uint64), np.full(len(every), -1)
        names[whole] = _mix(h.of(every[whole], width + GRAM) ^ (width.astype(np.uint64) * _M1))
        n[whole] = 0
        at = np.searchsorted(every, p)
        n[at] = np.minimum(np.searchsorted(every, m[p + REACH]) - at, RUN)
        yield row[of], names, n


def anchor_rows(raws: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place among the text's chunks, hash of the CORE bytes, hull, anchor, first start, last start) for the anchors of the texts."""
    before = np.zeros(len(raws), np.int64)
    for row, start, off, size, h in pieces(raws):
        m = h.minima(WINDOW)
        of, p, lo, hi = owned(m, off, size - LENGTH + 1)
        each, every = _every(h, m, off, size)
        base = np.searchsorted(each, np.arange(len(row)))
        shift = np.zeros(len(row), np.int64)
        for k, n in enumerate(np.bincount(each, minlength=len(row))):  # of a text's pieces each goes on where the last one ended
            shift[k] = before[row[k]]
            before[row[k]] += n
        move = (start - off)[of]
        yield row[of], np.searchsorted(every, p) - base[of] + shift[of], h.of(p, CORE), h.hull(p, lo, hi, LENGTH), p + move, lo + move, hi + move


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the text, and where it starts."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    out = (ends - starts).astype(np.uint64) * _M1
    for at in range(0, len(b), PIECE):
        piece = _BYTE[b[at : at + PIECE]]
        _need_powers(len(piece))
        piece *= _powers[0][: len(piece)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece)])
        i, j = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(piece))
        if i < j:
            lo, hi = np.maximum(starts[i:j] - at, 0), np.minimum(ends[i:j] - at, len(piece))
            part = (total[hi] - total[lo]) * _powers[1][lo]
            part[:1] *= np.array([pow(int(_P), max(0, at - int(starts[i])), 1 << 64)], np.uint64)  # the piece may begin within a word
            out[i:j] += part
    return _mix(out), starts


def passage_rows(raws: list[bytes]) -> Iterator[tuple]:
    """(hashes of many texts' words, row, core, hull, anchor, first start, last start) of the anchors over words."""
    held: list[tuple[int, np.ndarray]] = []

    def out() -> tuple:
        size = np.array([len(w) for _, w in held])
        h = Hashes.of_words(np.concatenate([w for _, w in held]))
        of, p, lo, hi = owned(h.minima(WORD_WINDOW), np.cumsum(size) - size, size - PASSAGE + 1)
        return h, np.array([r for r, _ in held])[of], h.of(p, PASSAGE - WORD_WINDOW + 1), h.hull(p, lo, hi, PASSAGE), p, lo, hi

    n = first = 0
    while first < len(raws):
        last, some = first, 0
        while last < len(raws) and (last == first or some + len(raws[last]) < TOGETHER):
            some += len(raws[last]) + 1
            last += 1
        joined = b" ".join(raws[first:last])
        ends = np.cumsum([len(r) + 1 for r in raws[first:last]])
        words, starts = word_hashes(joined)
        cuts = np.searchsorted(starts, ends)
        for row, (a, z) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True), first):
            for at in range(a, z - PASSAGE + 1, PIECE):
                held.append((row, words[at : min(z, at + PIECE + PASSAGE - 1)]))
                n += len(held[-1][1])
                if n >= TOGETHER:
                    yield out()
                    held, n = [], 0
        first = last
    if held:
        yield out()


def _mapped(df: DataFrame, schema: str, rows) -> DataFrame:  # noqa: ANN001
    """rows(record batch) yields tuples of numpy arrays, Arrow arrays or lists, one for each column of the schema."""
    tuned(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def column(c, kind: pa.DataType):  # noqa: ANN001, ANN202
        if isinstance(c, pa.Array):
            return c.cast(kind)
        return pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cols in rows(b):
                yield pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(cols, arrow, strict=True)], names=arrow.names)

    return df.mapInArrow(run, schema)


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]


def _gathered(parts: list[tuple], width: int) -> list:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(width)]


def _repeat(content: list, counts: list[int]) -> pa.Array:
    return pa.array(content, None if content else pa.int64()).take(pa.array(np.repeat(np.arange(len(content)), counts)))


def _lists(rows: np.ndarray, values: np.ndarray, n: int, kind) -> pa.Array:  # noqa: ANN001
    """One list for each of n rows: the values of that row; rows are sorted."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64).astype(kind)))


def _parsed(b: pa.RecordBatch) -> Iterator[tuple]:
    """(content, id, hashes and runs of the chunks, cores and hulls of the passages) of texts that have some."""
    raws, n = _bytes(b), b.num_rows
    row, name, run = _gathered(list(chunks(raws)), 3)
    at, core, hull = _gathered([x[1:4] for x in passage_rows(raws)], 3)
    keep = pa.array((np.bincount(row, minlength=n) + np.bincount(at, minlength=n)) > 0)
    lists = (_lists(row, name, n, np.int64), _lists(row, run, n, np.int16), _lists(at, core, n, np.int64), _lists(at, hull, n, np.int64))
    yield tuple(c.filter(keep) for c in (b.column("content"), b.column("doc_id"), *lists))


def _states(b: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(content, place, chunks wanted, rank), by place, of each text's live positions."""
    for content, live in zip(b.column("content").to_pylist(), b.column("live"), strict=True):
        i, n, rank = (live.values.field(k).to_numpy(zero_copy_only=False) for k in ("i", "n", "rank"))
        order = np.argsort(i)
        yield content, i[order].astype(np.int64), n[order].astype(np.int64), rank[order]


def _paired(i: np.ndarray, rank: np.ndarray, rows: np.ndarray, offset) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Those of the rows at whose place + offset there is a live position too, and its rank."""
    at = np.searchsorted(i, i[rows] + offset)
    ok = (at < len(i)) & (i[np.minimum(at, len(i) - 1)] == i[rows] + offset)
    return rows[ok], rank[at[ok]]


def _kept(df: DataFrame, folder: str) -> DataFrame:
    """df from a Parquet file in the folder: computed once, small on disk, and readers take the columns that they need."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    del df
    gc.collect()  # as in cut_lineage
    spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _finished(k: int):  # noqa: ANN202
    """(content, place, chunks, two ranks) for the positions that two overlapping ranks of k chunks cover."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        contents, counts, found = [], [], []
        for content, i, n, rank in _states(b):
            mine = np.flatnonzero((n >= k) & (n < 2 * k))
            mine, other = _paired(i, rank, mine, n[mine] - k)
            contents.append(content)
            counts.append(len(mine))
            found.append((i[mine], n[mine], rank[mine], other))
        yield (_repeat(contents, counts), *_gathered(found, 4))

    return rows


def _pairs(k: int):  # noqa: ANN202
    """(content, place, chunks, ranks of k chunks and of the k behind) for the positions that longer runs need."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        contents, counts, found = [], [], []
        for content, i, n, rank in _states(b):
            long = n >= 2 * k
            edge = np.zeros(len(i) + 1, np.int64)
            np.add.at(edge, np.flatnonzero(long), 1)
            np.add.at(edge, np.searchsorted(i, i[long] + n[long] - 2 * k, "right"), -1)
            mine = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            mine, behind = _paired(i, rank, mine, k)
            contents.append(content)
            counts.append(len(mine))
            found.append((i[mine], n[mine], rank[mine], behind))
        yield (_repeat(contents, counts), *_gathered(found, 4))

    return rows


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys occur again, with the keys' rank: sorted over the cluster and numbered in that order."""
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*keys).orderBy(*keys)
    numbered = cut_lineage(again.withColumn("rank", F.monotonically_increasing_id()))
    return rows.join(numbered, keys).select("content", "i", "n", "rank")


def doubled(rows: DataFrame) -> DataFrame:
    """(content, i, n, k1, k2) for each position i whose n chunks may occur again, all that do among them; equal chunks have equal n, k1, k2.

    rows: content, i, n (0 if only other positions need this one) and name, one row for each chunk of each distinct text;
    where equal chunks begin, n is equal.
    """
    live, k, done, kind = _ranked(rows, ["name"]), 1, [], rows.schema["content"].dataType.simpleString()
    while True:
        state = cut_lineage(live.groupBy("content").agg(F.collect_list(F.struct("i", "n", "rank")).alias("live")))
        done.append(_mapped(state, f"content {kind}, i int, n int, k1 long, k2 long", _finished(k)))
        longer = state.where(F.exists("live", lambda x: x["n"] >= 2 * k))
        if longer.isEmpty():
            break
        live = _ranked(_mapped(longer, f"content {kind}, i int, n int, r1 long, r2 long", _pairs(k)), ["r1", "r2"])
        k *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


_ROW = "content long, m int, at int, lo int, hi int, k1 long, k2 long, hull long"


def _flat(lists: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """(row, fields) of the structs in a column of lists."""
    values = lists.flatten()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), *(np.array(values.field(k).to_numpy(zero_copy_only=False), np.int64) for k in names)


def _anchors(b: pa.RecordBatch) -> Iterator[tuple]:
    """A row for each anchor that has ranks in its text's row; its key is of both ranks, the chunks' number and the CORE bytes."""
    of, i, many, k1, k2 = _flat(b.column("ranks"), "i", "n", "k1", "k2")
    ranked = (of << 32) + i
    order = np.argsort(ranked)
    ranked, many, k1, k2 = ranked[order], many[order].astype(np.uint64), k1[order], k2[order].view(np.uint64)
    content, m = b.column("content"), b.column("m").to_numpy()
    for row, place, core, hull, p, lo, hi in anchor_rows(_bytes(b)):
        wanted = (row << 32) + place
        at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
        ok = ranked[at] == wanted
        at, row = at[ok], row[ok]
        key = _mix(core[ok] ^ _mix(k2[at] * _M1 + many[at]))
        yield content.take(pa.array(row)), m[row], p[ok].astype(np.int32), lo[ok].astype(np.int32), hi[ok].astype(np.int32), k1[at], key, hull[ok]


def _finer(width: int):  # noqa: ANN202
    """Rows for the blocks of ``width`` starts in the ranges (anchor, first, last start, rank) that a text's row brings."""
    core = LENGTH - width + 1

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        text, at, lo, hi, rank = _flat(b.column("todo"), "at", "lo", "hi", "rank")
        content, m = b.column("content"), b.column("m").to_numpy()
        for row, start, off, _, h in pieces(_bytes(b)):
            piece = (row << 32) + start // PIECE  # in order
            mine = (text << 32) + lo // PIECE
            k = np.minimum(np.searchsorted(piece, mine), len(piece) - 1)
            ok = piece[k] == mine
            move = (off - start)[k[ok]]
            p, a, z, r, x = at[ok] + move, lo[ok] + move, hi[ok] + move, rank[ok], text[ok]
            first, last = (p - z) // width, (p - a) // width  # blocks by their distance before the anchor
            each = last - first + 1
            of = np.repeat(np.arange(len(p)), each)
            j = _ranges(first, each)
            top = p[of] - width * j  # the last start that a whole block has; its prefix is in all strings of the block
            s, e = np.maximum(top - width + 1, a[of]), np.minimum(top, z[of])
            key, hull = _mix(h.of(top, core) ^ (j.astype(np.uint64) * _M1)), h.hull(top, s, e, LENGTH)
            back = move[of]
            yield content.take(pa.array(x[of])), m[x[of]], *((y - back).astype(np.int32) for y in (p[of], s, e)), r[of], key, hull

    return rows


def _judged(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(spans, todo): strings known to repeat as (content, lo, end), and the ranked rows that a longer prefix has to decide."""
    mine = f"{folder}/{uuid.uuid4().hex}"
    rows = _kept(rows, mine)
    pick = F.xxhash64("content", "lo")
    hulls = _kept(rows.groupBy("k1", "k2", "hull").agg(F.sum("m").alias("n"), F.min(pick).alias("one")), mine)
    again = hulls.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("hulls"), F.sum("n").alias("all")).where("all > 1").drop("all")
    prefixes = _kept(again.orderBy("k1", "k2").withColumn("rank", F.monotonically_increasing_id()), mine)
    # written, so that the rows are dealt by all three keys: of one hot prefix there are many hulls
    groups = _kept(hulls.join(prefixes, ["k1", "k2"]).withColumn("one", F.when((F.col("hulls") > 1) & (F.col("n") > 1), F.col("one"))), mine)
    told = _kept(rows.join(groups, ["k1", "k2", "hull"]).select(
        "content", "at", "lo", "hi", "rank", (F.col("n") > 1).alias("known"), ((F.col("hulls") > 1) & ((F.col("n") == 1) | (pick == F.col("one")))).alias("open")
    ).where("known OR open"), folder)
    _removed(rows.sparkSession, mine)
    spans = told.where("known").select("content", "lo", (F.col("hi") + LENGTH).alias("end"))
    todo = told.where("open").groupBy("content").agg(F.collect_list(F.struct("at", "lo", "hi", "rank")).alias("todo"))
    return spans, todo


def _cut(b: pa.RecordBatch) -> Iterator[tuple]:
    """(content, bytes removed, runs removed, SHA-256 of what stays)."""
    removed, runs, digests = [], [], []
    for raw, spans in zip(_bytes(b), b.column("spans"), strict=True):
        lo, end = (np.array(spans.values.field(k).to_numpy(zero_copy_only=False), np.int64) for k in ("lo", "end"))
        edge = np.zeros(len(raw) + 1, np.int64)
        np.add.at(edge, lo, 1)
        np.add.at(edge, end, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed.append(int(gone.sum()))
        runs.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]))
        digests.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    yield b.column("content"), removed, runs, digests


def _passages(b: pa.RecordBatch) -> Iterator[tuple]:
    """(content, core, hash of PASSAGE words) for the starts whose core is among those that the text's row brings."""
    of = np.repeat(np.arange(b.num_rows), b.column("wanted").value_lengths().to_numpy())
    wanted = np.unique(_mix(b.column("wanted").flatten().to_numpy(zero_copy_only=False).view(np.uint64) + of.astype(np.uint64)))
    for h, row, core, _, p, lo, hi in passage_rows(_bytes(b)):
        ok = np.isin(_mix(core + row.astype(np.uint64)), wanted)
        each = (hi - lo + 1)[ok]
        of = np.repeat(np.flatnonzero(ok), each)
        s = _ranges(lo[ok], each)
        yield b.column("content").take(pa.array(row[of])), core[of], _mix(h.of(s, PASSAGE) ^ ((p[of] - s).astype(np.uint64) * _M1))


def _fetched(base: DataFrame, need: DataFrame) -> DataFrame:
    """need (digest, id and more) with the text of each digest: of the one document that has this id, hashed, and text."""
    return base.join(need, ["digest", "id"]).dropDuplicates(["digest", "id"]).drop("digest", "id")


def _cores(distinct: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(found, todo): (content) of texts that hold PASSAGE words in a row that another document holds too, and the cores of texts to compare by those.

    Texts that several documents have are such ones. Of the others, those are whose hull around an anchor is in two
    texts. What is left are texts that share a core but no hull: all passages around such cores are compared, with those
    of one text for each hull.
    """
    rows = distinct.where("size(cores) > 0").select("content", "m", F.explode(F.arrays_zip("cores", "hulls")).alias("x")).select("content", "m", "x.cores", "x.hulls").toDF("content", "m", "core", "hull")
    hulls = _kept(rows.groupBy("core", "hull").agg(F.min("content").alias("a"), F.max("content").alias("z")), folder)
    cores = hulls.groupBy("core").agg(F.min("a").alias("first"), F.max("z").alias("last")).where("first <> last").select("core")
    shared = _kept(hulls.join(cores, "core").select("core", "hull", "a", (F.col("a") != F.col("z")).alias("whole")), folder)
    told = rows.join(shared, ["core", "hull"]).groupBy("content").agg(F.max("whole").alias("whole"), F.max("m").alias("m"), F.collect_set("core").alias("wanted"))
    told = _kept(told, folder)
    found = distinct.where("size(cores) > 0 AND m > 1").select("content").unionByName(told.where("whole AND m = 1").select("content"))
    open_ = told.where("NOT whole AND m = 1").select("content", F.explode("wanted").alias("core"))
    partners = shared.join(open_.select("core").distinct(), "core").select(F.col("a").alias("content"), "core")
    return found, open_.unionByName(partners).groupBy("content").agg(F.collect_set("core").alias("wanted"))


def _passage_texts(texts: DataFrame, folder: str) -> DataFrame:
    """(content) of the texts, read with their wanted cores, that share PASSAGE words in a row around one of those."""
    passages = _kept(_mapped(texts, "content long, core long, passage long", _passages), folder)
    again = passages.groupBy("core", "passage").agg(F.min("content").alias("a"), F.max("content").alias("z")).where("a <> z").select("core", "passage")
    return passages.join(again, ["core", "passage"]).select("content")


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats_passage.

    Removed are the bytes of every string of LENGTH bytes that starts at another place too, in the same text or another
    one; texts are UTF-8, null counts as empty, and equal texts (repeated rows too) repeat each other. Texts below
    LENGTH bytes keep all. repeats_passage: the document holds at least PASSAGE words in a row, however many bytes those
    are, that another row's document holds too; nothing is removed for it. Only texts that hold some repeated prefix are
    moved: after the rounds of ranks, whole texts of those alone are shuffled, one row for each distinct text. A text
    that several rows have goes whole; it takes part in the ranks once, as a partner for others.
    """
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    base = docs.select(F.col("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    light = cut_lineage(base.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole")))
    base = base.select(F.xxhash64("doc_id").alias("id"), "digest", "text")
    parsed = _mapped(base.select(F.col("digest").alias("content"), F.col("id").alias("doc_id"), "text"), "digest binary, id long, names array<long>, runs array<short>, cores array<long>, hulls array<long>", _parsed)
    distinct = parsed.groupBy("digest").agg(F.count(F.lit(1)).cast("int").alias("m"), F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("names", "runs", "cores", "hulls")))
    # from here on a distinct text is a number, which sorts and groups at less cost than its digest
    distinct = _kept(distinct.withColumn("content", F.monotonically_increasing_id()), folder)
    found, wanted = _cores(distinct, folder)
    chunk = distinct.select("content", F.posexplode(F.arrays_zip("names", "runs")).alias("i", "x")).where("x.runs >= 0")
    done = doubled(chunk.select("content", "i", F.col("x.runs").cast("int").alias("n"), F.col("x.names").alias("name")))
    ranks = done.groupBy("content").agg(F.collect_list(F.struct("i", "n", "k1", "k2")).alias("ranks"))
    texts = _kept(_fetched(base, distinct.select("digest", "id", "content", "m").join(ranks.join(wanted, "content", "full"), "content")), folder)
    passages = found.unionByName(_passage_texts(texts.where("wanted IS NOT NULL").select("content", "text", "wanted"), folder)).distinct().withColumn("repeats_passage", F.lit(True))
    spans, todo = _judged(_mapped(texts.where("ranks IS NOT NULL").select("content", "m", "text", "ranks"), _ROW, _anchors), folder)
    every = spans
    for width in (BLOCK, 1):
        finer = texts.where("ranks IS NOT NULL").select("content", "m", "text").join(todo, "content").select("content", "m", "text", "todo")
        spans, todo = _judged(_mapped(finer, _ROW, _finer(width)), folder)
        every = every.unionByName(spans)
    by_text = every.groupBy("content").agg(F.collect_list(F.struct("lo", "end")).alias("spans"))
    cut = texts.where("m = 1").select("content", "text").join(by_text, "content").select("content", "text", "spans")
    told = _mapped(cut, "content long, n_removed long, n_spans long, kept_sha256 string", _cut)
    copied = distinct.where("m > 1 AND size(names) > 0").select("content", F.lit(True).alias("copied"))
    told = told.join(copied, "content", "full").join(passages, "content", "full")
    told = cut_lineage(distinct.select("digest", "content").join(told, "content").drop("content"))
    _removed(spark, folder)
    none = F.lit(0).cast("long")
    out = light.join(told, "digest", "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(F.col("copied"), none + 1).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(F.col("copied"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.coalesce("repeats_passage", F.lit(False)).alias("repeats_passage"),
    )
