"""Fixpoints, scopes, constraints, sources and streams on small fixtures."""

import random

import pytest

from trellisq.operators.patterns import Var, as_of, body, head, match, range_join
from trellisq.operators.rules import Builtins, fired, fuse, FuseError, graph, implied_by, implies, promote, rule, same_as
from trellisq.operators.scoped import collect_all_in, for_all_in, not_includes
from trellisq.plans.fixpoint import NotSettled, closure, layers, reach, saturate
from trellisq.sources import messages, triples
from trellisq.streaming import streams
from pyspark.sql import functions as F


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def warshall(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return sorted(out)
        out |= more


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(18)}
    assert pairs(closure(spark.createDataFrame(sorted(edges), "s long, o long"))) == warshall(edges)


def test_chain_of_15_links_has_120_pairs(spark):
    chain = spark.range(15).selectExpr("id AS s", "id + 1 AS o")
    assert closure(chain, most_rounds=6).count() == 120


def test_empty_relation(spark):
    assert closure(spark.createDataFrame([], "s long, o long")).count() == 0


def test_reach_asks_only_from_its_starts(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "s long, o long")
    assert pairs(reach(spark.createDataFrame([(1,)], "start long"), edges)) == [(1, 1), (1, 2), (1, 3)]


def test_diamond_gives_one_row_and_nulls_stay_one_fact(spark):
    base = spark.createDataFrame([("x", None), ("x", None), ("y", "c")], "s string, o string")
    assert saturate(base, lambda new, full: new).count() == 2


def test_rules_without_end_are_reported(spark):
    with pytest.raises(NotSettled):
        saturate(spark.range(1), lambda new, full: new.selectExpr("id + 1 AS id"), most_rounds=3)


def test_layers_read_frozen_facts(spark):
    facts = spark.createDataFrame([("a", "is", "man"), ("b", "is", "man"), ("a", "loves", "b")], "s string, p string, o string")

    def lonely(f, frozen):
        loved = match(frozen, Var("y"), "loves", Var("x"))
        return head(not_includes(match(frozen, Var("x"), "is", "man"), loved, ["x"]), (Var("x"), "is", "lonely"))

    assert pairs(layers(facts, [[lonely]]).where("o = 'lonely'")) == [("a", "is", "lonely")]


def test_fuse(spark):
    fuse(spark.range(0))
    with pytest.raises(FuseError) as e:
        fuse(spark.range(3))
    assert e.value.code == 65


def test_patterns(spark):
    f = spark.createDataFrame([("a", "p", "a"), ("a", "p", "b"), ("b", "q", "c")], "s string, p string, o string")
    assert pairs(match(f, Var("x"), "p", Var("x"))) == [("a",)]
    assert pairs(body(match(f, Var("x"), "p", Var("y")), match(f, Var("y"), "q", Var("z"))).select("x", "z")) == [("a", "c")]
    with pytest.raises(ValueError):
        body(match(f, Var("x"), "p", "b"), match(f, Var("y"), "q", "c"))


def test_range_join_and_as_of(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, -3.0)], "id long, v double")
    ranges = spark.createDataFrame([("a", 0.0, 10.0), ("b", 10.0, 30.0), ("c", -9.0, -1.0), ("d", 9.0, 1.0)], "r string, lo double, hi double")
    assert pairs(range_join(points, "v", ranges, "lo", "hi", 4.0).select("id", "r")) == [(1, "a"), (2, "a"), (2, "b"), (3, "c")]
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, at long")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("k", 5, 51)], "k string, t long, v long")
    assert sorted(map(str, pairs(as_of(left, right, "k", "at", "t", "v")))) == ["('k', 1, None)", "('k', 5, 51)", "('z', 9, None)"]


def test_scoped(spark):
    outer = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    scope = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")], "k long, v string")
    assert pairs(collect_all_in(outer, scope, ["k"], F.col("v"), "l")) == [(1, ["a", "a", "b"]), (2, ["c"]), (3, [])]
    then = spark.createDataFrame([("a",), ("b",)], "v string")
    assert pairs(for_all_in(outer, scope, then, ["k"], ["v"])) == [(1,), (3,)]


def test_rules_as_facts(spark):
    f = spark.createDataFrame([("a", "p", "b"), ("p", "implies", "q"), ("q", "implies", "r")], "s string, p string, o string")
    assert {r["p"] for r in promote(f).where("s = 'a'").collect()} == {"p", "q", "r"}


def test_equal_graphs_are_equal_values(spark):
    f = spark.createDataFrame([(1, "a", "p", "b"), (1, "c", "p", "d"), (2, "c", "p", "d"), (2, "a", "p", "b"), (2, "a", "p", "b")], "g long, s string, p string, o string")
    assert graph(f, "g").select("graph").distinct().count() == 1


def test_builtin_registry():
    b = Builtins()
    b.register("x:b", len)
    b.register("x:a", len)
    with pytest.raises(TypeError):
        b.register("x:c", 1)
    assert b.names() == ["x:a", "x:b"] and b.unregister("x:a") and not b.unregister("x:a") and b["x:b"] is len


LINES = [
    '<http://e/a> <http://e/p> "x\\"y\\n"@en-GB .', "_:b1 <http://e/p> <http://e/o> <http://e/g> . # note", "# nothing", "", '<http://e/a> <http://e/p> "1"^^<http://www.w3.org/2001/XMLSchema#int> .',
    "@prefix e: <http://e/> .",
]


def test_triple_lines_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = triples.parse_lines(df)
    assert got.where("s IS NULL").count() == 1
    ok = got.where("s IS NOT NULL")
    assert ok.where("g = 'http://e/g'").count() == 1
    again = triples.parse_lines(triples.lines(ok))
    assert pairs(again.select("s", "p", "o")) == pairs(ok.select("s", "p", "o"))
    assert ok.where("o.lang = 'en-GB'").first()["o"]["lex"] == 'x"y\n'


def test_blank_nodes_of_two_files_stay_apart(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text("_:x <http://e/p> _:x .\n")
    got = triples.read(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert got.select("s.lex").distinct().count() == 2 and got.where("s.lex = o.lex").count() == 2


def test_store_shapes(spark, tmp_path):
    f = spark.createDataFrame([("a", "p", "b"), ("a", "q", "b"), ("c", "p", "d")], "s string, p string, o string")
    triples.save(f, str(tmp_path / "store"))
    count = lambda **k: triples.load(spark, str(tmp_path / "store"), **k).count()
    assert [count(), count(s="a"), count(p="p"), count(o="b"), count(s="a", p="q"), count(p="p", o="d"), count(s="a", o="b"), count(s="c", p="p", o="d"), count(kind="inferred")] == [3, 2, 2, 2, 1, 1, 2, 1, 0]


def test_message_log_with_a_heartbeat(spark):
    lines = ['VERSION "1.2-messages"', "one", "MESSAGE", "# heartbeat", "@message .", "two", "three"]
    log = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream string, line_no long, value string")
    got = messages.envelopes(log).orderBy("offset").collect()
    assert [(r["offset"], r["payload_kind"], r["payload"], r["next_offset"]) for r in got] == [(1, "nonEmpty", ["one"], 2), (2, "empty", None, 3), (3, "nonEmpty", ["two", "three"], None)]


def test_stream_runs_each_batch(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    streams.run_each(streams.stream(spark, str(tmp_path / "in"), spark.range(1).schema), lambda b: b.where("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8]


def test_facts_are_streamed_by_round(spark):
    seen = []
    edges = spark.range(4).selectExpr("id AS s", "id + 1 AS o")
    closure_step = lambda new, full: new.selectExpr("s", "o AS m").join(edges.selectExpr("s AS m", "o"), "m").select("s", "o")
    saturate(edges, closure_step, each=lambda k, new: seen.append((k, new.count())))
    assert seen == [(1, 3), (2, 2), (3, 1)]


def test_content_of_files(spark, tmp_path):
    (tmp_path / "a.n3").write_text("x\ny")
    rows = spark.createDataFrame([(str(tmp_path / "a.n3"), 1)], "path string, k int")
    assert [tuple(r) for r in triples.content(spark, rows).select("k", "content").collect()] == [(1, "x\ny")]


def test_rules_with_several_premises(spark):
    f = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "c"), ("b", "is", "x")], "s string, p string, o string")
    rules = spark.range(1).select(F.inline(F.array(
        rule([("?x", "p", "?y"), ("?y", "p", "?z")], [("?x", "q", "?z")]), rule([("?x", "q", "?x")], [("?x", "is", "loop")]), rule([], [("always", "is", "so")]),
        rule([("?s", "?how", "x")], [("?s", "?how", "y"), ("?s", "lacks", "?nothing")]),
    )))
    got = pairs(saturate(f, lambda new, full: fired(rules, new, full)).join(f, ["s", "p", "o"], "left_anti"))
    assert got == sorted([("a", "q", "c"), ("b", "q", "c"), ("c", "q", "c"), ("c", "is", "loop"), ("always", "is", "so"), ("b", "is", "y")])
    assert implies(rules).count() == implied_by(rules).count() == 4


def test_list_patterns_and_equal_objects(spark):
    f = spark.createDataFrame([(["a", "b", "a"], "r", "z"), (["a", "b"], "r", "z"), (["a", "c", "d"], "r", "z")], "s array<string>, p string, o string")
    assert pairs(match(f, (Var("x"), "b", Var("x")), "r", Var("y"))) == [("a", "z")]
    facts = spark.createDataFrame([("x", "p", "a")], "s string, p string, o string")
    same = spark.createDataFrame([("a", "b"), ("x", "y")], "a string, b string")
    assert len(pairs(same_as(facts, same, objects=True))) == 4


def test_a_hot_predicate_and_a_hot_stream_are_dealt(spark, tmp_path, monkeypatch):
    f = spark.range(2000).selectExpr("string(id) AS s", "if(id < 1900, 'type', 'rare') AS p", "'o' AS o")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one task
    triples.save(f, str(tmp_path / "store"), rows=200)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "store/kind=explicit/p=type").glob("*.parquet"))) > 1 and triples.load(spark, str(tmp_path / "store")).count() == 2000
    monkeypatch.setattr(messages, "BLOCK", 50)
    log = spark.range(1000).selectExpr("'s' AS stream", "id AS line_no", "if(id % 4 = 3, 'MESSAGE # more', string(id)) AS value")
    got = messages.envelopes(log).orderBy("offset").collect()
    assert [r["offset"] for r in got] == list(range(1, 252)) and got[100]["payload"] == ["400", "401", "402"] and got[-1]["next_offset"] is None and got[5]["next_offset"] == 7


def test_text_logs_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("one\nMESSAGE\ntwo\nthree\n")
    (tmp_path / "in/b.log").write_text("VERSION '1.2'\nMESSAGE # first is empty\nfour")
    streams.run_each(streams.text_messages(spark, str(tmp_path / "in")), messages.envelopes, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["stream"], r["offset"], r["payload"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a.log", 1, ["one"]), ("a.log", 2, ["two", "three"]), ("b.log", 2, ["four"])]


def test_facts_one_by_one(spark):
    f = spark.createDataFrame([("a", "p", "b"), ("c", "p", "d")], "s string, p string, o string")
    assert sorted(triples.rows(f)) == [("a", "p", "b"), ("c", "p", "d")]
