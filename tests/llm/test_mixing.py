import random
from fractions import Fraction

from pyspark.sql import functions as F

from tests.llm.conftest import frame
from trellisq.llm import mixing, queries


def water(sizes, weights, share=Fraction(3, 2), most=2):
    """Reshares the excess by weight until none is above its limit."""
    left, free, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] > most * sizes[i] * total}
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            return out
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free -= over
    return out


def test_targets_and_takes(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.choice([0, 1, 5, 40, 300]), r.choice(["a", "b", "c", "é", None, "Z"])) for i in range(400)]
    got = mixing.mix(frame(spark, rows)).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(names, water([size[s] for s in names], [Fraction([5, 2, 1][i % 3]) for i in range(len(names))]), strict=True))
    for s in names:
        mine = [x for x in got if x["source"] == s]
        assert {x["source_size"] for x in mine} == {size[s]} and abs(mine[0]["target"] - float(want[s])) < 1e-6 * (1 + float(want[s]))
        assert sum(x["taken"] for x in mine) == int(mine[0]["target"] + 1e-9)
    assert all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    key = lambda rows: sorted((x["doc_id"], x["taken"], [tuple(t) for t in x["takes"]]) for x in rows)
    assert key(got) == key(mixing.mix(frame(spark, rows[::-1]).repartition(3)).collect())


def test_chunks_give_the_same_running_sizes(spark, monkeypatch):
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else "cold") for i in range(300)]
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 16)
    got = mixing.mix(frame(spark, rows)).collect()
    for s in ("hot", "cold"):
        mine = [x for x in got if x["source"] == s]
        assert sum(x["taken"] for x in mine) == int(mine[0]["target"] + 1e-9)


def test_due_inverts_the_demand(spark):
    rate = F.array(F.lit(1.5), F.lit(1.0), F.lit(0.5))
    got = spark.range(101).select(mixing.due(rate, F.col("id").cast("double"), F.lit(100.0)).alias("t")).collect()
    for i, row in enumerate(got):
        x = row["t"]
        demand = 100 * (1.5 * x - 0.5 * x * x)  # the rate falls from 1.5 to 0.5 evenly, its integral over all is 1
        assert abs(demand - i) < 1e-6
    assert got == sorted(got)


def test_schedule_is_sorted_and_cuts_by_words(spark):
    docs = frame(spark, [(1, " a  b\tc", "x"), (2, "d e f g", "x"), (3, "h", "y")])
    rows = mixing.schedule(mixing.mix(docs), ["doc_id", "text"]).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    original = {1: " a  b\tc", 2: "d e f g", 3: "h"}
    assert all(original[r["doc_id"]].startswith(r["text"]) for r in rows)
    taken = sum(x["taken"] for x in mixing.mix(docs).collect())
    assert sum(len(r["text"].split()) for r in rows) == taken


def test_query_is_sorted_and_has_all_positions(spark, tmp_path):
    docs = frame(spark, [(i, "w " * (i % 9 + 1), "abc"[i % 3] if i % 10 else "c") for i in range(300)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_mixing(spark, str(tmp_path)).collect()
    at = [(r["position"] is None, r["position"] or 0, r["doc_id"]) for r in got]
    assert len(got) == 300 and at == sorted(at)
    want = {r["doc_id"]: [t["position"] for t in r["takes"]] for r in mixing.mix(docs).collect()}
    assert {r["doc_id"]: r["positions"] for r in got} == want and max(map(len, want.values())) == 2
    assert all(r["position"] == (r["positions"] or [None])[0] for r in got)


def test_no_python_in_the_plan(spark):
    plan = mixing.schedule(mixing.mix(frame(spark, [(1, "a", "x")])), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark, odd):
    assert mixing.mix(odd.withColumn("target", F.lit(1)).withColumn("takes", F.lit("x"))).count() == odd.count()
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.taken_rows(odd.limit(0), mixing.mix(odd.limit(0), keep=[], key="k"), "k").count() == 0
    assert {r["taken"] for r in mixing.mix(frame(spark, [(1, "", "a"), (2, None, "b")])).collect()} == {0}


def test_names_that_helpers_might_have(spark, odd):
    """Columns of the input stay as they are, but for those that the operator returns, whatever their case."""
    mine = ["rank", "n_docs", "weight", "Position", "epoch", "limit", "key", "h", "chunk", "level"]
    docs = odd.select("*", *[F.lit(f"my {c}").alias(c) for c in [*mine, "SIZE", "Taken"]])
    out = mixing.mix(docs)
    assert all(r[c] == f"my {c}" for r in out.collect() for c in mine) and {"SIZE", "Taken"}.isdisjoint(out.columns)
    rows = mixing.schedule(out, docs.columns[:15]).collect()
    assert all(r["rank"] == "my rank" and isinstance(r["position"], float) and r["epoch"] in (1, 2) for r in rows)


def test_texts_are_dealt_once_and_repeated_rows_stay(spark):
    docs = frame(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "y"), (2, "d e f g", "x"), (None, None, None), (3, "h", "y"), (4, "", "x")])
    whole = mixing.schedule(mixing.mix(docs), docs.columns).collect()
    dealt = mixing.schedule(mixing.taken_rows(docs, mixing.mix(docs, keep=[], key="k"), "k"), docs.columns).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, dealt)) and len(whole) > 5
