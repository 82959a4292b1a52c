"""MinHash near-duplicate detection with tensored banding.

The keys of a document's hash tables are pairs: the i-th of ROOT keys of a first collection with the j-th of ROOT keys
of a second one, each made of two minhashes. So ROOT * ROOT tables of four minhashes each cost 4 * ROOT minhashes, not
4 * ROOT * ROOT. Two sets of similarity 0.75 share no table with probability 4e-6.

1. Texts with equal shingle sets become one node. 2. Buckets of the first collection that hold one node are dropped
before anything else is moved; in the others, nodes that share a key of the second collection too, hence a table, are
candidates. A bucket's candidates are connected through leaders: every node goes with each leader whose sketch agrees
with its own at least in part, and is a leader itself unless one agrees almost wholly, so that no pair in a bucket is
lost through the choice of leaders; a bucket gives at most one pair for each of its nodes. A bucket of more than BUCKET
nodes is dealt into parts, and the parts' leaders meet by tables and in pairs of parts, so that no group of rows in a
task grows with the corpus. 3. Clusters of candidates: connected components.
4. Links are confirmed on the full shingle sets within clusters. A cluster of more than CHUNK nodes or SHINGLES
shingles is dealt into chunks; components found within chunks, and those of one node from each, are merged, and then
only pairs of chunks that still differ in component are compared, which is exact whatever the earlier steps gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from .common import add_columns, cut_lineage, fields, n_parts, tuned
from .components import components

WIDTH, PERCENT = 5, 75
#: Keys in each collection; minhashes in each key.
ROOT, PER_KEY = 16, 2
HASHES = 2 * ROOT * PER_KEY
#: Share of equal minhashes from which a node is joined to a leader, and from which it isn't a leader itself.
ATTACH, COVER = 0.3, 0.85
#: The same for two leaders of one wide bucket, which none covers: copies of theirs at 0.75 leave them 0.45 alike at least.
LEADERS = 0.25
#: Nodes and shingles that one task compares at most; nodes of one bucket that are led together.
CHUNK, SHINGLES, BUCKET = 1500, 1_000_000, 1000
#: Words whose hashes a task remembers at most, beside those of one text.
KNOWN_WORDS = 100_000

_r = np.random.default_rng(20)
_MULT = _r.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _r.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + _r.integers(0, 2, HASHES, dtype=np.uint64)
_PLACE = _r.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _r.integers(1, 2**63, (PER_KEY, ROOT), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """The set of 64-bit shingle hashes of a text; remembers words' hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()  # bytes: lower() changes A-Z alone, split() cuts at space and \t \n \v \f \r
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        if len(h) < WIDTH:
            return _mixed((h * _PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
        n = len(h) - WIDTH + 1
        s = h[:n] * _PLACE[0]
        for k in range(1, WIDTH):
            s += h[k : n + k] * _PLACE[k]
        return np.unique(_mixed(s))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of the set under fixed functions, 32 bits each."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, ((shingles[at : at + 2048, None] ^ _XOR) * _MULT).min(0), out)
    return out >> np.uint64(32)


def keys(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ROOT keys of each collection; a table's key is one of the first with one of the second."""
    pairs = m.reshape(2, ROOT, PER_KEY)
    k = _mixed((pairs * _KEY.T).sum(2, dtype=np.uint64) + np.arange(ROOT, dtype=np.uint64))
    return k[0].view(np.int64), k[1].view(np.int64)


def sketches(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' ``keep`` columns with n_shingles, node (hash of the set; null for the empty set), first and rest.

    first: the keys of the first collection. rest: those of the second one, then the sketch, 16 bits a minhash.
    """

    def make():
        shingle = Shingler()

        def compute(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in range(4)]
            for t in texts:
                s = shingle(t)
                row = (0, None, None, None)
                if len(s):
                    m = minhashes(s)
                    a, b = keys(m)
                    row = (len(s), xxhash.xxh128_digest(s.tobytes()), a, b.tobytes() + m.astype(np.uint16).tobytes())
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            return out

        return compute

    return add_columns(docs, "text", fields(n_shingles=LongType(), node=BinaryType(), first=ArrayType(LongType()), rest=BinaryType()), make, keep)


def by_group(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``rows`` rows or one group, from batches sorted by the columns ``names``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= rows:
            last, new = [held[-1].column(c)[-1] for c in names], [b.column(c) for c in names]
            cut = next((i for i in range(b.num_rows) if any(col[i] != v for col, v in zip(new, last, strict=True))), None)
            if cut is None:
                held.append(b)
                n += b.num_rows
                continue
            if cut:
                held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held)
            held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def lead(group: np.ndarray, second: np.ndarray | None, sketch: np.ndarray, attach: float, cover: float, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, others, leaders): pairs of rows that connect each group as its leaders do, at most one for each row; the leaders.

    group: sorted group numbers. second: keys of which a row and its leader must have one in common; none if that is
    known of the group. attach and cover: the shares of equal minhashes from which a row is joined to a leader, and from
    which it isn't one itself. Round after round the first row of each group that no leader covers becomes a leader
    and is compared with all rows of its group at once. A group is done when it's connected, or, where ``whole``, when
    every row is covered.
    """
    n = len(group)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    of = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    covered, part_of = np.zeros(n, bool), np.arange(n)
    parts = np.bincount(of)
    rows, others, leaders = [], [], []
    live = np.arange(n)
    while len(live):
        open_rows = live[~covered[live]]
        leader = np.full(len(first), -1)
        leader[of[open_rows[::-1]]] = open_rows[::-1]  # the first open row of each group is written last
        live = live[leader[of[live]] >= 0]
        leaders.append(leader[leader >= 0])
        covered[leaders[-1]] = True
        for some in np.array_split(live, max(1, len(live) // 20_000)):
            l = leader[of[some]]
            same = (sketch[some] == sketch[l]).mean(1)
            ok = (same >= attach) & (some != l)
            if second is not None:
                ok &= (second[some] == second[l]).any(1)
            covered[some[ok & (same >= cover)]] = True
            r, l = some[ok], l[ok]
            apart = part_of[r] != part_of[l]
            _, one = np.unique(part_of[r[apart]], return_index=True)  # one row of each part that a leader joins to its own
            r, l = r[apart][one], l[apart][one]
            rows.append(r)
            others.append(l)
            into = np.arange(n)
            into[part_of[r]] = part_of[l]
            part_of[live] = into[part_of[live]]
            parts -= np.bincount(of[r], minlength=len(parts))
        go_on = np.zeros(len(first), bool)
        rest = live[~covered[live]]
        go_on[of[rest]] = whole[rest] | (parts[of[rest]] > 1)
        live = live[go_on[of[live]]]
    return np.concatenate(rows), np.concatenate(others), np.concatenate(leaders)


def _candidates(buckets: DataFrame, groups: list[str], attach: float, cover: float, tables: bool) -> DataFrame:
    """(key, a, b): pairs of nodes that connect each group of buckets' rows, and for groups that are ``wide`` the leaders as (key, a, a).

    tables: whether a pair must be seen to share a key of the second collection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, groups, 20_000):
            t = t.combine_chunks()
            change = np.zeros(len(t), bool)
            for c in groups:
                col = t.column(c).to_numpy()
                change[1:] |= col[1:] != col[:-1]
            raw = np.frombuffer(b"".join(t.column("rest").to_pylist()), np.uint8).reshape(len(t), -1)
            second, sketch = raw[:, : 8 * ROOT].copy().view(np.int64), raw[:, 8 * ROOT :].copy().view(np.uint16)
            whole = t.column("wide").to_numpy()
            rows, others, leaders = lead(np.cumsum(change), second if tables else None, sketch, attach, cover, whole)
            leaders = leaders[whole[leaders]]
            left, right = pa.array(np.concatenate([rows, leaders])), pa.array(np.concatenate([others, leaders]))
            node = t.column("node").combine_chunks()
            out = [t.column("key").combine_chunks().take(left), node.take(left), node.take(right)]
            for at in range(0, len(left), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(at, 50_000) for x in out], names=["key", "a", "b"])

    parts = n_parts(buckets)
    return buckets.select("key", *[g for g in groups if g != "key"], "wide", "node", "rest").repartition(parts, *groups).sortWithinPartitions(*groups, "node").mapInArrow(run, "key long, a binary, b binary")


def _narrowed(leaders: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, rest, wide): the leaders of wide buckets in groups of at most BUCKET rows, which hold every pair that shares a table.

    Up to BUCKET leaders of one key stay together. More are dealt by each key of the second collection, since pairs need
    one of those in common too, and where a table is still wider, its rows are dealt into parts and every two parts are
    a group. Groups are named by a hash; two that get the same name by chance are compared together, which adds no pair
    that shares no table.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")

    by_first = counted(leaders)
    few = by_first.where(F.col("n") <= BUCKET).select("key", "node")
    place = F.explode(F.sequence(F.lit(0), F.lit(ROOT - 1))).alias("j")
    second = by_first.where(F.col("n") > BUCKET).select("key", "node").join(nodes.select("node", "rest"), "node").select("key", "node", "rest", place)
    tables = counted(second.select(F.xxhash64("key", "j", F.expr("substring(rest, 8 * j + 1, 8)")).alias("key"), "node"))
    parts = F.ceil(2 * F.col("n") / BUCKET)
    part = F.pmod(F.xxhash64("node", "key"), parts)
    pair = tables.where(F.col("n") > BUCKET).select("key", "node", part.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("q"))
    pair = pair.select(F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("key"), "node")
    all_ = few.unionByName(tables.where(F.col("n") <= BUCKET).select("key", "node")).unionByName(pair)
    return all_.join(nodes.select("node", "rest"), "node").withColumn("wide", F.lit(False))


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, component): clusters of candidate nodes. nodes: distinct node, with first and rest. A lone node has no row."""
    one = nodes.select("node", F.explode("first").alias("key"))
    n = one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BUCKET)).cast("int")
    met = one.join(n, "key").select("node", "key", part.alias("part"), (F.col("n") > BUCKET).alias("wide"))
    buckets = met.join(nodes.select("node", "rest"), "node")
    found = cut_lineage(_candidates(buckets, ["key", "part"], ATTACH, COVER, tables=True))
    links = found.where("a <> b").select("a", "b")
    leaders = cut_lineage(found.where("a = b").select("key", F.col("a").alias("node")))
    if not leaders.isEmpty():
        links = links.unionByName(_candidates(_narrowed(leaders, nodes), ["key"], LEADERS, cover=2.0, tables=False).where("a <> b").select("a", "b"))
    return components(links)


def link(sets: list[np.ndarray], start: list, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of similar sets that, with the components in ``start``, connect all that similarity connects.

    Breadth first: a visited set is compared with all unvisited ones at once; what is in its component already isn't
    compared. Similar: 100 * intersection >= percent * union.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(n), size)
    common = count[token] > 1
    token, owner = token[common], owner[common]
    ends = np.cumsum(np.bincount(owner, minlength=n))
    begins = ends - np.bincount(owner, minlength=n)
    members: dict = {}
    for i, c in enumerate(start):
        members.setdefault(c, []).append(i)
    open_, flag, pairs = np.ones(n, bool), np.zeros(len(count), bool), []
    rest_token, rest_owner, at_build = token, owner, n
    n_open = n
    for root in range(n):
        if not open_[root]:
            continue
        queue = list(members[start[root]])
        open_[queue] = False
        n_open -= len(queue)
        while queue and n_open:
            if n_open < 0.7 * at_build:
                still = open_[rest_owner]
                rest_token, rest_owner, at_build = rest_token[still], rest_owner[still], n_open
            u = queue.pop()
            mine = token[begins[u] : ends[u]]
            flag[mine] = True
            both = np.bincount(rest_owner[flag[rest_token]], minlength=n)
            flag[mine] = False
            near = np.flatnonzero(open_ & (100 * both >= percent * (size + size[u] - both)))
            for v in near.tolist():
                pairs.append((u, v))
                if open_[v]:
                    new = members[start[v]]
                    open_[new] = False
                    n_open -= len(new)
                    queue += new
    return pairs


def _linked(members: DataFrame, groups: list[str]) -> DataFrame:
    """(a, b): confirmed links within each group of members' rows (node, shingles, comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, groups, 1):
            t = t.combine_chunks()
            change = np.zeros(len(t), bool)
            for c in groups:
                col = t.column(c).to_pylist()
                change[1:] |= np.fromiter((x != y for x, y in zip(col[1:], col, strict=False)), bool, max(0, len(t) - 1))
            cuts = [0, *np.flatnonzero(change).tolist(), len(t)]
            a, b = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = t.slice(lo, hi - lo)
                rows = dict(zip(part.column("node").to_pylist(), zip(part.column("shingles").to_pylist(), part.column("comp").to_pylist(), strict=True), strict=True))
                if len(rows) > 1:
                    names = list(rows)
                    for i, j in link([np.frombuffer(s, np.uint64) for s, _ in rows.values()], [c for _, c in rows.values()]):
                        a.append(names[i])
                        b.append(names[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return members.select(*groups, "node", "shingles", "comp").repartition(n_parts(members), *groups).sortWithinPartitions(*groups, "node").mapInArrow(run, "a binary, b binary")


def _with_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with shingles (the set's sorted hashes). nodes: node, doc_id of a document that has the set, and more columns."""
    need = nodes.withColumnRenamed("doc_id", "__id")
    texts = docs.select("doc_id", "text").join(need, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")

    def make():
        shingle = Shingler()

        def compute(texts: list[str]) -> list[list]:
            sets = [shingle(t) for t in texts]
            return [[s.tobytes() for s in sets], [xxhash.xxh128_digest(s.tobytes()) for s in sets]]

        return compute

    return add_columns(texts, "text", fields(shingles=BinaryType(), __node=BinaryType()), make, nodes.columns).where("node = __node").drop("__node")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): confirmed links between nodes, enough to connect all that links connect.

    nodes: node, doc_id, n_shingles, first and rest, one row for each distinct shingle set.
    """
    cluster = cut_lineage(clusters(nodes).join(nodes.select("node", "doc_id", "n_shingles"), "node"))
    size = cluster.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("n_shingles") / SHINGLES)).alias("chunks"))
    dealt = cluster.join(size, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # texts are dealt once, to those that are in a cluster; their sets are written, for their chunk and for what follows
    sets = cut_lineage(_with_sets(docs, dealt.select("node", "doc_id", "component", "chunk", "chunks")))
    found = cut_lineage(_linked(sets.withColumn("comp", F.col("node")), ["component", "chunk"]))
    sets = sets.where("chunks > 1")
    wide = cut_lineage(sets.select("node", "component", "chunk"))
    if wide.isEmpty():
        return found

    def labelled(found: DataFrame) -> DataFrame:
        known = components(found.join(wide.select(F.col("node").alias("a")), "a", "left_semi"))
        return cut_lineage(wide.join(known.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node")))

    # one node of each chunk's largest component: chunks of one large group meet here
    by_comp = labelled(found).groupBy("component", "chunk", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    pivots = by_comp.groupBy("component", "chunk").agg(F.max_by("node", F.struct("n", "node")).alias("node"))
    pivot_sets = sets.select("node", "component", "shingles").join(pivots.select("node"), "node", "left_semi").withColumn("comp", F.col("node"))
    found = cut_lineage(found.unionByName(_linked(pivot_sets, ["component"])))
    # blocks: of one large component, or of small ones; two blocks are compared unless both are of the same component
    now = labelled(found)
    n_of = now.groupBy("component", "comp").agg(F.count(F.lit(1)).alias("n"))
    small = n_of.where(F.col("n") <= CHUNK // 4).groupBy("component").agg(F.ceil(F.sum("n") / CHUNK * 2).alias("packs"))
    pack = F.when(F.col("n") > CHUNK // 4, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK))).otherwise(F.pmod(F.xxhash64("comp"), F.col("packs")))
    blocks = now.join(n_of, ["component", "comp"]).join(small, "component", "left").withColumn("pure", F.when(F.col("n") > CHUNK // 4, F.col("comp")))
    blocks = cut_lineage(blocks.withColumn("block", F.struct(F.coalesce(F.hex("pure"), F.lit("")).alias("of"), pack.cast("int").alias("k"))).select("node", "component", "comp", "pure", "block"))
    b = blocks.select("component", "pure", "block").distinct()
    other = b.select("component", F.col("pure").alias("pure2"), F.col("block").alias("block2"))
    pairs = b.join(other, "component").where("block <= block2 AND (pure IS NULL OR pure2 IS NULL OR pure <> pure2)").select("component", "block", "block2")
    ends = pairs.select("component", "block", F.col("block").alias("x"), F.col("block2").alias("y")).unionByName(
        pairs.where("block < block2").select("component", F.col("block2").alias("block"), F.col("block").alias("x"), F.col("block2").alias("y"))
    )
    members = blocks.select("node", "component", "comp", "block").join(ends, ["component", "block"]).join(sets.select("node", "shingles"), "node")
    members = members.select("node", "shingles", "comp", "component", F.to_json("x").alias("x"), F.to_json("y").alias("y"))
    return cut_lineage(found.unionByName(_linked(members, ["component", "x", "y"])))


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    component_id: the smallest doc_id among the documents that links reach, its own included. Null and empty texts, and
    texts of white space, have no shingles and stand alone. kept: doc_id = component_id; a row with a null id is kept
    only if its whole component has no ids. Rows that repeat a kept doc_id and its text are kept too.
    """
    out = _grouped(docs.select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each row (doc_id among them) with n_shingles, node, component_id and group (null for the empty set)."""
    tuned(docs.sparkSession)
    rows = cut_lineage(sketches(docs, keep))
    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("first").alias("first"), F.min("rest").alias("rest"))
    nodes = cut_lineage(ids)
    comps = components(links(docs, nodes))
    least = comps.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    of_node = comps.join(least, "component").select("node", "component", "least")
    of_node = nodes.select("node", "doc_id").join(of_node, "node", "left").select(
        "node", F.coalesce("component", "node").alias("group"), F.coalesce("least", "doc_id").alias("component_id")
    )
    out = rows.select(*keep, "n_shingles", "node").join(of_node, "node", "left")
    return out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def distinct(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, all columns kept: the one with the smallest doc_id, ties by text.

    Documents without shingles all stay, but of rows equal in id and text one stays.
    """
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    rows = _grouped(keyed.select("doc_id", "text", "__row"), ["doc_id", "__row"])
    best = rows.where("node IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("b")).select("b.__row")
    stay = best.unionByName(rows.where("node IS NULL").select("__row")).distinct()
    return keyed.join(stay, "__row").dropDuplicates(["__row"]).select(*docs.columns)
