"""Near duplicates, components, repeated bytes, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import PROSE, frame
from trellisq.llm import components, minhash_dedup, suffix_dedup


@pytest.mark.parametrize("local", [components.LOCAL, 7])
def test_components_of_random_graphs(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    r = random.Random(8)
    for n, m in ((30, 12), (30, 60), (60, 59)):
        edges = [(i, i + 1) for i in range(m)] if m == 59 else [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: find(x) for x in linked}


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").split("\n") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, (d, _) in zip(comp, rows, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted((repr(d), len(s), repr(least.get(c)), d == least.get(c)) for (d, _), s, c in zip(rows, sets, comp, strict=True))


def families(seed, n=40):
    """Chains of copies with more and more words changed, near 0.75 on both sides; capitals and spaces vary."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, k = [], 0
    for _ in range(n):
        words = [word() for _ in range(r.randint(3, 60))]
        for _ in range(r.randint(1, 8)):
            rows.append((k, r.choice([" ", "\n", "  "]).join(w.upper() if r.random() < 0.2 else w for w in words)))
            k += 1
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = word()
    r.shuffle(rows)
    return rows


def results(df):
    return sorted((repr(x["doc_id"]), x["n_shingles"], repr(x["component_id"]), x["kept"]) for x in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small):
    if small:  # every cluster and bucket is a wide one
        monkeypatch.setattr(minhash_dedup, "CHUNK", 3)
        monkeypatch.setattr(minhash_dedup, "BUCKET", 3)
    rows = families(5) + [(None, None), (900, None), (901, ""), (902, " \n"), (903, PROSE), (903, PROSE), (None, PROSE), (904, "a b"), (905, "A  b")]
    assert results(minhash_dedup.dedup(frame(spark, rows))) == expected(rows)


def test_a_passage_in_many_dissimilar_documents(spark, monkeypatch):
    """Its buckets are wide, their leaders many: groups stay bounded, and no link is lost."""
    monkeypatch.setattr(minhash_dedup, "BUCKET", 40)
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage, rows = [word() for _ in range(40)], []
    for k in range(300):
        words = [word() for _ in range(25)] + passage + [word() for _ in range(25)]
        rows.append((2 * k, " ".join(words)))
        if k % 10 == 0:
            words[3] = word()
            rows.append((2 * k + 1, " ".join(words)))
    docs = frame(spark, rows)
    sketched = minhash_dedup.sketches(docs, ["doc_id"]).where("node IS NOT NULL")
    groups = minhash_dedup._narrowed(sketched.select(F.explode("first").alias("key"), "node"), sketched)
    assert 0 < groups.groupBy("key").count().agg(F.max("count")).first()[0] <= 2 * 40
    assert results(minhash_dedup.dedup(docs)) == expected(rows)


def test_one_of_each_group_stays(spark, odd):
    rows = families(6, 12) + [(903, PROSE), (903, PROSE), (904, PROSE + " end")]
    got = minhash_dedup.distinct(frame(spark, rows).withColumn("extra", F.lit(1)))
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == sorted({int(d) for d, _, _, k in expected(rows) if k}) and "extra" in got.columns
    assert minhash_dedup.distinct(odd.limit(0)).count() == 0
    assert sorted(map(str, (r["doc_id"] for r in minhash_dedup.distinct(odd).collect()))) == ["1", "2", "3", "4", "5", "7", "None"]


def test_tables_meet_as_often_as_they_should():
    r, met = np.random.default_rng(1), 0
    for _ in range(200):
        a = r.integers(0, 2**63, 100).astype(np.uint64)
        b = a.copy()
        b[:14] = r.integers(0, 2**63, 14).astype(np.uint64)  # 86 of 114 in common: 0.754
        (a1, a2), (b1, b2) = minhash_dedup.keys(minhash_dedup.minhashes(a)), minhash_dedup.keys(minhash_dedup.minhashes(b))
        met += (a1 == b1).any() and (a2 == b2).any()
    assert met == 200


def test_links_connect_what_similarity_connects():
    r = random.Random(3)
    sets = [np.unique(np.array([r.randrange(40) for _ in range(r.randint(1, 12))], np.uint64)) for _ in range(60)]
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    pairs = minhash_dedup.link(sets, list(range(60)))
    assert all(near(sets[a], sets[b]) for a, b in pairs)

    def parts(edges):
        c = list(range(60))
        for a, b in edges:
            c = [c[a] if x == c[b] else x for x in c]
        return {frozenset(i for i in range(60) if c[i] == x) for x in c}

    assert parts(pairs) == parts([(i, j) for i in range(60) for j in range(i) if near(sets[i], sets[j])])


def cut(rows, length=400):
    seen, out = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1)), []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((repr(d), len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_pieces_of_a_text_give_what_the_whole_gives(monkeypatch):
    r = random.Random(9)
    raw = bytes(r.choice(b"abc \xc3") for _ in range(5000)) + b"ab" * 600
    raws = [b"short", raw, b"", raw[:400], raw[500:2000], raw[:399]]

    def anchors():
        return [x for rows in suffix_dedup.anchor_rows(raws) for x in zip(*rows, strict=True)]

    def starts():
        return {(int(row), s + k): (int(core), p - s - k) for row, _, core, _, p, s, e in anchors() for k in range(e - s + 1)}

    def runs():
        return {(int(row), int(name), int(n)) for rows in suffix_dedup.chunks(raws) for row, name, n in zip(*rows, strict=True) if n > 0}

    whole, chunks, words = starts(), runs(), suffix_dedup.word_hashes(raw)[0].tolist()
    assert len(whole) == sum(max(0, len(x) - 399) for x in raws)
    for piece, together in ((700, 1 << 18), (700, 1), (1 << 20, 1)):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
        assert starts() == whole and runs() == chunks and suffix_dedup.word_hashes(raw)[0].tolist() == words
        listed = collections.defaultdict(list)
        for rows in suffix_dedup.chunks(raws):
            for row, _, n in zip(*rows, strict=True):
                listed[int(row)].append(n)
        assert [(int(row), int(place)) for row, place, *_ in anchors()] == [(row, k) for row in sorted(listed) for k, n in enumerate(listed[row]) if n > 0]
        todo = pa.array([[{"at": p, "lo": s, "hi": e, "rank": 1} for row, *_, p, s, e in anchors() if row == k] for k in range(len(raws))])
        texts = [x.decode("latin-1").encode("ascii", "replace").decode() for x in raws]
        b = pa.record_batch([pa.array(texts), pa.array([bytes([k]) for k in range(len(raws))]), pa.array([1] * len(raws), pa.int32()), todo], names=["text", "content", "m", "todo"])
        found = [x for rows in suffix_dedup._finer(1)(b) for x in zip(rows[0].to_pylist(), rows[3].tolist(), strict=True)]
        assert sorted(found) == sorted((bytes([row]), s) for row, s in whole)


def test_words_hash_by_their_bytes(monkeypatch):
    r = random.Random(2)
    texts = [b"", b" \n ", b"one", b" a b  a\tb\x0bab ", "é à é".encode(), b"x" * 5000 + b" y " + b"x" * 5000, bytes(r.choice(b"ab \n") for _ in range(3000))]
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    of = {}
    for t in texts:
        got = suffix_dedup.word_hashes(t)[0].tolist()
        assert len(got) == len(t.split())
        for w, h in zip(t.split(), got, strict=True):
            assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def test_doubling_finds_the_runs_that_occur_again(spark):
    """Runs of every length over few names, against a count of all runs."""
    r = random.Random(4)
    texts = [[r.randrange(3) for _ in range(r.randrange(1, 40))] for _ in range(12)]
    texts += [texts[0][:9] + texts[3], [1] * 30]
    rows = []
    for k, t in enumerate(texts):
        rows += [(str(k).encode(), i, n if i + (n := (1, 5, 11)[name]) <= len(t) else 0, name) for i, name in enumerate(t)]
    runs = collections.Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t)) for n in range(1, len(t) - i + 1))
    want = {(c, i, tuple(texts[int(c)][i : i + n])) for c, i, n, _ in rows if n}
    got = suffix_dedup.doubled(spark.createDataFrame(rows, "content binary, i int, n int, name long")).collect()
    of = {}
    for x in got:
        run = tuple(texts[int(x["content"])][x["i"] : x["i"] + x["n"]])
        assert of.setdefault((x["n"], x["k1"], x["k2"]), run) == run
        want.discard((bytes(x["content"]), x["i"], run))
    assert len(of) == len(set(of.values())) and all(runs[run] == 1 for *_, run in want)


def passages(rows):
    words = [[w for w in (t or "").encode().split()] for _, t in rows]
    sets = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in words]
    n = collections.Counter(p for s in sets for p in s)
    return sorted((repr(d), any(n[p] > 1 for p in s)) for (d, _), s in zip(rows, sets, strict=True))


def test_repeated_passages_by_brute_force(spark):
    r = random.Random(12)
    noise = lambda n: [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(n)]
    shared, texts = noise(200), []
    for _ in range(40):  # passages near 51 words on both sides
        i, n = r.randrange(140), r.choice([30, 45, 49, 50, 51, 52, 53, 60])
        texts.append(" ".join(noise(r.randrange(40)) + shared[i : i + n] + noise(r.randrange(60))))
    lone = noise(60)
    texts += [" ".join(lone[:50]), " ".join(lone), "\n".join(lone[9:]), " ".join(lone[10:]), "w " * 80, "w " * 51, "w " * 50, None, "", " ".join(t := noise(55)), " ".join(t), " ".join(x := noise(50)), " ".join(x), " ".join(noise(300))]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    got = sorted((repr(x["doc_id"]), x["repeats_passage"]) for x in suffix_dedup.dedup(frame(spark, rows)).collect())
    assert got == passages(rows)


def test_repeated_bytes_by_brute_force(spark):
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    shared, other = noise(1500), noise(420)
    texts = [noise(300) + shared + noise(200), shared[100:900] + noise(500) + other, noise(50) + other[3:] + shared[880:1400], noise(399), other[:390] + noise(40), "a" * 900, "ab" * 700, "xyz " * 400]
    texts += [noise(r.randrange(200)) + shared[(i := r.randrange(1000)) : i + r.randrange(380, 500)] + noise(r.randrange(200)) for _ in range(12)] + [None, "", texts[3], texts[3], shared, shared + "x", "q" * 400]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    got = sorted((repr(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.dedup(frame(spark, rows)).collect())
    assert got == cut([(d, (t or "").encode()) for d, t in rows])


def test_odd_rows(spark, odd):
    assert suffix_dedup.dedup(odd.withColumn("n_bytes", F.lit("old"))).count() == odd.count()
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0
    assert minhash_dedup.dedup(odd.limit(0)).count() == 0


def test_repeated_texts_are_taken_apart_once(spark, monkeypatch):
    """Before, each step computed its rows from the texts three times."""
    seen, mapped = spark.sparkContext.accumulator(0), suffix_dedup._mapped

    def counted(df, schema, rows):
        def each(b):
            seen.add(b.num_rows)
            yield from rows(b)

        return mapped(df, schema, each if rows is suffix_dedup._anchors else rows)

    monkeypatch.setattr(suffix_dedup, "_mapped", counted)
    r = random.Random(9)
    shared = "".join(r.choice("abcdefgh ") for _ in range(700))
    texts = [f"{k} " * 50 + shared + f" {k * 7}" * 50 for k in range(12)]
    got = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(x["n_removed"] >= 700 for x in got) and seen.value == 12
