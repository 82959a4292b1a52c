"""All queries of the library's own operators by name, and the SQL that gives the same rows.

A query without SQL is one that SQL over the tables can't express: inline graphs, rules as data, message replay, user
functions. The tests hold those against results worked out by hand.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .functions import BUILTINS, datatypes, lists, maths, solve, strings, times
from .functions.logic import INVERSES, known_key, skolem, term, text_uri, unify_key
from .operators.patterns import ALLEN, Var, allen, as_of, body, column_facts, head, match, range_join
from .operators.rules import FuseError, asserted, conclusion, conjunction, existential, fired, fuse, graph, graph_includes, implied_by, implies, patch, project, promote, proof_chains, proved, rule, same_as, trace
from .operators.scoped import aggregate_in, collect_all_in, for_all_in, includes, not_includes
from .plans.fixpoint import closure, layers, levels, reach, saturate
from .sources import messages, triples
from .streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
XSD = "http://www.w3.org/2001/XMLSchema#"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Recursion


@query("""WITH RECURSIVE r AS (
SELECT a.conv_id, a.turn AS s, b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
UNION SELECT r.conv_id, r.s, b.turn FROM r JOIN conversations b ON r.conv_id = b.conv_id AND b.turn = r.o + 1)
SELECT conv_id, s, o FROM r""")
def closure_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{?x next ?y} => {?x reach ?y}, and reach is transitive: saturated with path doubling."""
    c = t(spark, sf_dir, "conversations")
    step = c.select("conv_id", F.col("turn").alias("s")).join(c.select("conv_id", (F.col("turn") - 1).alias("s"), F.col("turn").alias("o")), ["conv_id", "s"])
    return closure(step, by=["conv_id"])


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def subclass_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a customer along customer, nation, region."""
    n = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS s, (s_nationkey * 7 + 3) % 25 AS o FROM supplier),
r AS (SELECT s AS start, o AS node FROM e WHERE s < 5 UNION SELECT r.start, e.o FROM r JOIN e ON r.node = e.s)
SELECT start::BIGINT AS start, node::BIGINT AS node FROM (SELECT start, node FROM r UNION SELECT DISTINCT s, s FROM e WHERE s < 5)""")
def reach_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive backward rule over a cyclic graph, asked for a few starts only."""
    e = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("s")).distinct().withColumn("o", (F.col("s") * 7 + 3) % 25)
    return reach(e.where("s < 5").select(F.col("s").alias("start")), e)


@query("""SELECT n_nationkey::BIGINT AS k, g::BIGINT AS level FROM nation, range(4) x(g) WHERE n_nationkey % (1 << g) = 0""")
def value_invention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that computes new values and stops at its guard: {?x level ?n. ?n lessThan 3. x divides} => {?x level ?n+1}."""
    base = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit(0).cast("long").alias("level"))
    step = lambda new, full: new.where("level < 3").withColumn("level", F.col("level") + 1).where("k % shiftleft(1, cast(level as int)) = 0")
    return saturate(base, step)


# Joins


@query("""SELECT c_custkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey""")
def bgp_join_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body of three patterns; multiplicities are those of derivations."""
    c = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    l = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return body(c, o, l).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def cousins_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One predicate twice, and notEqualTo."""
    s = t(spark, sf_dir, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("a"), "s_nationkey"), s.select(F.col("s_suppkey").alias("b"), "s_nationkey")
    return body(a, b).where(BUILTINS["log:notEqualTo"]("a", "b")).select("a", "b")


@query("""SELECT p_partkey, k::BIGINT AS band FROM part, range(40) x(k) WHERE p_retailprice BETWEEN k * 50 + 880 AND k * 50 + 960""")
def theta_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two comparisons of one variable: a range join over cells, not all pairs."""
    bands = spark.range(40).select(F.col("id").alias("band"), (F.col("id") * 50 + 880).alias("lo"), (F.col("id") * 50 + 960).alias("hi"))
    return range_join(t(spark, sf_dir, "part"), "p_retailprice", bands, "lo", "hi", 80).select("p_partkey", "band")


@query("""SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts = (
SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'click' AND q.ts <= e.ts)) AS click FROM events e WHERE event_type = 'purchase'""")
def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"No later one", as a sort by key and time."""
    e = t(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    return as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "at", "click").select("event_id", "click")


_ALLEN_SQL = " ".join(f"WHEN {c} THEN '{k}'" for k, c in ALLEN.items())


@query(f"""WITH i AS (SELECT o_custkey AS k, o_orderkey AS id, epoch_us(o_orderdate) // 86400000000 AS lo, epoch_us(o_orderdate) // 86400000000 + 1 + o_orderkey % 40 AS hi FROM orders),
p AS (SELECT a.id AS a, b.id AS b, a.lo AS a_start, a.hi AS a_end, b.lo AS b_start, b.hi AS b_end FROM i a JOIN i b ON a.k = b.k AND a.id < b.id)
SELECT relation, count(*) AS n FROM (SELECT CASE {_ALLEN_SQL} END AS relation FROM p) GROUP BY relation""")
def allen_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allen's interval relations between orders of one customer."""
    day = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("long")
    i = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), day.alias("lo")).withColumn("hi", F.col("lo") + 1 + F.col("id") % 40)
    a, b = (i.select("k", F.col("id").alias(x), F.col("lo").alias(f"{x}_start"), F.col("hi").alias(f"{x}_end")) for x in "ab")
    pairs = a.join(b, "k").where("a < b")
    return pairs.select(allen(pairs).alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def semi_large_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body whose later variables aren't used: one proof is enough."""
    large = t(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return includes(t(spark, sf_dir, "orders"), large, ["o_orderkey"]).select("o_orderkey")


# Patterns and heads


@query("""SELECT 'o' || o_orderkey AS s, 'status' AS p, o_orderstatus AS o FROM orders WHERE o_orderstatus = 'F'
UNION SELECT 'o' || o_orderkey, 'closed', 'yes' FROM orders WHERE o_orderstatus = 'F'""")
def head_two_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{?o status "F"} => {?o status "F". ?o closed "yes"}, over facts made from columns."""
    o = t(spark, sf_dir, "orders")
    facts = column_facts(o, F.concat(F.lit("o"), "o_orderkey"), {"o_orderstatus": "status", "o_orderpriority": "priority"})
    return head(match(facts, Var("x"), "status", "F"), (Var("x"), "status", "F"), (Var("x"), "closed", "yes"))


@query("""SELECT p, count(*) AS n, count(DISTINCT o) AS objects FROM (SELECT 'status' AS p, o_orderstatus AS o FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders) GROUP BY p""")
def variable_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = column_facts(t(spark, sf_dir, "orders"), F.col("o_orderkey"), {"o_orderstatus": "status", "o_orderpriority": "priority"})
    return match(facts, Var("x"), Var("p"), Var("o")).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("objects"))


@query("""SELECT l_suppkey AS x, count(*) AS n FROM lineitem WHERE l_suppkey = l_partkey GROUP BY 1""")
def repeated_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{?x soldBy ?x}: a variable twice in one pattern."""
    f = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("s"), F.lit("soldBy").alias("p"), F.col("l_suppkey").alias("o"))
    return match(f, Var("x"), "soldBy", Var("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n, count(*) AS names FROM customer""")
def skolem_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{?x a Customer} => {?x has [ ... ]}: one fresh name for each firing."""
    named = existential(t(spark, sf_dir, "customer").select("c_custkey"), "rule1", "b0", "account")
    return named.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("account").alias("names"))


@query("""SELECT o_orderpriority, o_orderstatus FROM orders GROUP BY ALL""")
def query_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("""SELECT count(*) FILTER (o_totalprice < 0)::BIGINT AS violations FROM orders""")
def fuse_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{?o price ?p. ?p lessThan 0} => false doesn't fire; it would raise FuseError with code 65."""
    fuse(t(spark, sf_dir, "orders").where("o_totalprice < 0"), "no negative price")
    return spark.range(1).select(F.lit(0).cast("long").alias("violations"))


@query("""SELECT (CASE WHEN max(o_totalprice) > 0 THEN 65 ELSE 0 END)::BIGINT AS code FROM orders""")
def fuse_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        fuse(t(spark, sf_dir, "orders").where("o_totalprice > 0"), "must fire")
        code = 0
    except FuseError as e:
        code = e.code
    return spark.range(1).select(F.lit(code).cast("long").alias("code"))


@query("""WITH g AS (SELECT text, min(doc_id) AS a FROM documents GROUP BY text HAVING count(*) > 1),
f AS (SELECT doc_id::VARCHAR AS s, 'source' AS p, source AS o FROM documents), p AS (SELECT g.a::VARCHAR AS a, d.doc_id::VARCHAR AS b FROM documents d JOIN g USING (text) WHERE d.doc_id <> g.a)
SELECT s, p, o FROM f UNION SELECT p.b, f.p, f.o FROM f JOIN p ON f.s = p.a""")
def sameas_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies are the same as their first document: facts go from it to them."""
    d = t(spark, sf_dir, "documents").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    first = d.groupBy("h").agg(F.min("doc_id").alias("a"))
    pairs = d.select("doc_id", "h").join(first, "h").where("doc_id <> a").select(F.col("a").cast("string").alias("a"), F.col("doc_id").cast("string").alias("b"))
    return same_as(column_facts(d, F.col("doc_id"), {"source": "source"}), pairs)


# Scoped negation and aggregation


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def anti_no_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return not_includes(t(spark, sf_dir, "customer"), by, ["c_custkey"]).select("c_custkey")


@query("""SELECT DISTINCT user_id FROM events WHERE event_type = 'error'""")
def semi_has_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return includes(e.select("user_id").distinct(), e.where("event_type = 'error'"), ["user_id"])


@query("""SELECT o_orderkey, coalesce(round(sum(l_quantity), 2), 0) AS quantity, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1""")
def collect_sum_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collectAllIn with sum and length, fused into one aggregation; the sum of the empty list is 0."""
    l = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return aggregate_in(
        t(spark, sf_dir, "orders").select("o_orderkey"), l, ["o_orderkey"], {"quantity": 0.0, "n": 0}, quantity=F.round(F.sum("l_quantity"), 2), n=F.count(F.lit(1))
    )


@query("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def collect_count_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return aggregate_in(t(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], {"n": 0}, n=F.count("o_orderkey"))


@query("""SELECT c_custkey, coalesce(list_aggregate(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), 'string_agg', ','), '') AS keys
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def collect_list_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collectAllIn itself: a list for each outer row, empty where nothing is found."""
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    got = collect_all_in(t(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], F.col("o_orderkey"), "found")
    return got.select("c_custkey", F.array_join(F.col("found").cast("array<string>"), ",").alias("keys"))


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')""")
def forall_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    done = spark.createDataFrame([("F",)], "l_linestatus string")
    return for_all_in(t(spark, sf_dir, "orders"), l, done, ["o_orderkey"], ["l_linestatus"]).select("o_orderkey")


@query("""SELECT o_custkey, min(o_totalprice) AS least, max(o_totalprice) AS most, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY 1""")
def min_max_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list:sort with first and last, as aggregates."""
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top")
    )


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(*) > 100""")
def avg_distinct_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 100").drop("n")


@query("""WITH big AS (SELECT o_custkey AS c FROM orders WHERE o_totalprice > 300000), idle AS (SELECT c_custkey AS c FROM customer EXCEPT SELECT c FROM big)
SELECT DISTINCT c::VARCHAR AS s, 'big' AS p, 'yes' AS o FROM big UNION SELECT c::VARCHAR, 'small', 'yes' FROM idle UNION SELECT c_custkey::VARCHAR, 'customer', 'yes' FROM customer""")
def stratified_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positive layer, then one that negates it over the frozen facts."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("s"), F.lit("customer").alias("p"), F.lit("yes").alias("o"))
    orders = t(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").cast("string").alias("x"))

    def big(new: DataFrame) -> DataFrame:
        return head(includes(match(new, Var("x"), "customer", "yes"), orders, ["x"]), (Var("x"), "big", "yes"))

    def small(frozen: DataFrame) -> DataFrame:
        return head(not_includes(match(frozen, Var("x"), "customer", "yes"), match(frozen, Var("x"), "big", "yes"), ["x"]), (Var("x"), "small", "yes"))

    return layers(c, [[big], [small]])


# Sets


@query("""SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase'""")
def union_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.where("event_type IN ('click', 'purchase')").select("user_id").distinct()


@query("""SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'""")
def intersect_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("""SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 100""")
def except_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return not_includes(e.where("event_type = 'click'").select("user_id").distinct(), e.where("event_type = 'error' AND value > 100"), ["user_id"])


@query("""SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'signup'""")
def union_all_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative backward rules keep their duplicates."""
    e = t(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").unionByName(e.where("event_type = 'signup'").select("user_id"))


# Built-ins


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, l_orderkey + l_partkey AS total, l_quantity * l_extendedprice AS product, l_orderkey - l_partkey AS difference,
l_extendedprice / nullif(l_quantity, 0) AS quotient, l_orderkey // nullif(l_suppkey, 0) AS whole, l_orderkey % nullif(l_suppkey, 0) AS rest, floor(l_extendedprice + 0.5)::BIGINT AS rounded,
abs(l_partkey - l_orderkey) AS absolute, -l_orderkey AS negated, l_quantity * l_quantity AS square FROM lineitem""")
def math_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = BUILTINS
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), m["math:sum"]("l_orderkey", "l_partkey").alias("total"), m["math:product"]("l_quantity", "l_extendedprice").alias("product"),
        m["math:difference"]("l_orderkey", "l_partkey").alias("difference"), m["math:quotient"]("l_extendedprice", "l_quantity").alias("quotient"),
        m["math:integerQuotient"]("l_orderkey", "l_suppkey").alias("whole"), m["math:remainder"]("l_orderkey", "l_suppkey").alias("rest"), m["math:rounded"]("l_extendedprice").cast("long").alias("rounded"),
        m["math:absoluteValue"](F.col("l_partkey") - F.col("l_orderkey")).alias("absolute"), m["math:negation"]("l_orderkey").alias("negated"), m["math:exponentiation"]("l_quantity", 2).alias("square"),
    )


_TRIG = ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "degrees")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, """ + ", ".join(f"round({f}(l_discount), 9) AS {f}_x" for f in _TRIG) + """, round(asinh(l_discount), 9) AS sinh_inverse,
CASE WHEN l_quantity <= 1 THEN round(acos(l_quantity), 9) END AS outside FROM lineitem""")
def trig_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [F.round(BUILTINS[f"math:{f}"]("l_discount"), 9).alias(f"{f}_x") for f in _TRIG]
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), *made, F.round(maths.INVERSES["math:sinh"]("l_discount"), 9).alias("sinh_inverse"), F.round(BUILTINS["math:acos"]("l_quantity"), 9).alias("outside")
    )


@query("""SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 20 AND p_size <> 15 AND p_retailprice >= 905 AND p_retailprice <= 1500""")
def math_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = t(spark, sf_dir, "part"), BUILTINS
    return p.where(m["math:greaterThan"]("p_size", 10) & m["math:lessThan"]("p_size", 20) & m["math:notEqualTo"]("p_size", 15) & m["math:notLessThan"]("p_retailprice", 905) & m["math:notGreaterThan"]("p_retailprice", 1500)).select("p_partkey")


@query("""SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, '+02:00' AS zone FROM events""")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the text, not of the moment: the offset changes nothing."""
    e = t(spark, sf_dir, "events").withColumn("x", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    parts = {"y": "year", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second"}
    return e.select("event_id", *[times.BUILTINS[f"time:{p}"]("x").cast("long").alias(k) for k, p in parts.items()], times.zone("x").alias("zone"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, 'PT' || ((epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000000) || 'S' AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def time_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    l = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_shipdate")
    return l.join(o, "l_orderkey").select("l_orderkey", "line", maths.date_difference("l_shipdate", "o_orderdate").alias("gap"))


@query("""SELECT p_partkey, p_name || '/' || p_brand AS joined, lower(p_name) = lower(upper(p_name)) AS folded, length(p_name) AS n, replace(p_name, ' ', '_') AS replaced,
substr(p_name, 2, 1) AS second, 'X' || substr(p_name, 2) AS changed, 'Part ' || lpad(p_partkey::VARCHAR, 8, '0') || ': ' || p_size AS shown, starts_with(p_type, 'S') AS starts,
contains(lower(p_type), 'steel') AS steel, p_type < p_brand AS less FROM part""")
def string_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = BUILTINS
    return t(spark, sf_dir, "part").select(
        "p_partkey", b["string:concatenation"]("p_name", F.lit("/"), "p_brand").alias("joined"), b["string:equalIgnoringCase"]("p_name", F.upper("p_name")).alias("folded"),
        b["string:length"]("p_name").cast("long").alias("n"), b["string:replace"]("p_name", " ", "_").alias("replaced"), b["string:charAt"]("p_name", 1).alias("second"),
        b["string:setCharAt"]("p_name", 0, F.lit("X")).alias("changed"), b["string:format"]("Part %08d: %s", "p_partkey", "p_size").alias("shown"), b["string:startsWith"]("p_type", F.lit("S")).alias("starts"),
        b["string:containsIgnoringCase"]("p_type", F.lit("STEEL")).alias("steel"), b["string:lessThan"]("p_type", "p_brand").alias("less"),
    )


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://([^/]+)')""")
def regex_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """string:scrape: rows without a match have no solution."""
    return solve(t(spark, sf_dir, "pages").withColumn("p", F.lit(r"^https?://([^/]+)")), "host", "string:scrape", "url", r"^https?://([^/]+)").select("page_id", "host")


@query("""SELECT page_id FROM pages WHERE regexp_matches(url, '[0-9]$')""")
def regex_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages")
    return p.where(strings.matches("url", "[0-9]$") & ~strings.not_matches("url", "[0-9]$") & ~strings.matches("url", "(") & ~strings.not_matches("url", "(")).select("page_id")


@query("""SELECT doc_id, md5(text) AS md5, sha1(text) AS sha, sha256(text) AS sha256 FROM documents""")
def crypto_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", *[BUILTINS[f"crypto:{k}"]("text").alias(k) for k in ("md5", "sha", "sha256")])


@query()
def crypto_sha512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", BUILTINS["crypto:sha512"]("text").alias("sha512"))


@query("""SELECT event_id, regexp_matches(v, '^[+-]?\\d+$') AS is_integer, try_cast(v AS BIGINT) BETWEEN -128 AND 127 AND regexp_matches(v, '^[+-]?\\d+$') AS is_byte,
CASE WHEN regexp_matches(v, '^[+-]?\\d+$') THEN try_cast(v AS BIGINT)::VARCHAR END AS canonical FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '+0' || event_id WHEN 1 THEN '-' || event_id WHEN 2 THEN event_id || 'x' ELSE event_id::VARCHAR END AS v FROM events)""")
def dt_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN concat('+0', event_id) WHEN 1 THEN concat('-', event_id) WHEN 2 THEN concat(event_id, 'x') ELSE string(event_id) END AS v")
    return e.select("event_id", datatypes.valid("v", "integer").alias("is_integer"), datatypes.valid("v", "byte").alias("is_byte"), datatypes.canonical("v", "integer").alias("canonical"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS same FROM events""")
def dt_same_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal values in other spellings, different values, and literals that can't be compared."""
    e = t(spark, sf_dir, "events").selectExpr("event_id", "concat(event_id, '.50') AS a", "CASE event_id % 3 WHEN 0 THEN concat('+', event_id, '.5') WHEN 1 THEN concat(event_id, '.25') ELSE 'x' END AS b")
    return e.select("event_id", datatypes.same_value("a", "decimal", "b", "decimal").alias("same"))


@query("""SELECT count(*) AS n, count(DISTINCT v) AS spellings, count(DISTINCT v IN ('true', '1')) AS matched, count(DISTINCT v) AS known FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'false' ELSE '0' END AS v FROM events)""")
def three_equalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth values match by value, but are different facts when they're spelt differently."""
    v = F.expr("CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'false' ELSE '0' END")
    e = t(spark, sf_dir, "events").select(v.alias("v")).withColumn("t", term("L", "v", F.lit(f"{XSD}boolean")))
    return e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("spellings"), F.countDistinct(unify_key("t")).alias("matched"), F.countDistinct(known_key("t")).alias("known"))


@query("""SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def list_member_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list:iterate over whole lists."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("xs"))
    return lists.iterate(e, "xs", "i", "v").select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


@query("""SELECT p_partkey, list_reverse(w)[1] AS last, w[1] AS first, len(w) AS n, array_to_string(list_sort(w), ' ') AS sorted, array_to_string(list_reverse(w), ' ') AS reversed,
array_to_string(w[2:], ' ') AS rest, array_to_string(list_filter(w, lambda x: x <> w[1]), ' ') AS removed, NOT list_contains(w, 'zzz') AS absent, array_to_string(list_concat(w, w), ' ') AS twice,
w[2] AS at1 FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def list_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = BUILTINS
    p = t(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    text = lambda xs: F.array_join(xs, " ")
    return p.select(
        "p_partkey", b["list:last"]("w").alias("last"), b["list:first"]("w").alias("first"), b["list:length"]("w").cast("long").alias("n"), text(b["list:sort"]("w")).alias("sorted"),
        text(b["list:reverse"]("w")).alias("reversed"), text(b["list:rest"]("w")).alias("rest"), text(b["list:remove"]("w", F.col("w")[0])).alias("removed"),
        b["list:notMember"]("w", F.lit("zzz")).alias("absent"), text(b["list:append"]("w", "w")).alias("twice"), b["list:memberAt"]("w", 1).alias("at1"),
    )


@query("""SELECT p_partkey, array_to_string(w[1:k], ' ') AS a, array_to_string(w[k+1:], ' ') AS b FROM (SELECT p_partkey, w, unnest(range(0, len(w) + 1)) AS k FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))""")
def list_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list:append with a bound result: all ways to split it."""
    p = t(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return lists.splits(p, "w", "a", "b").select("p_partkey", F.array_join("a", " ").alias("a"), F.array_join("b", " ").alias("b"))


@query("""SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def list_map_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list:map with a predicate that has several solutions for an element."""
    c = t(spark, sf_dir, "customer").select("c_custkey", F.array("c_custkey").alias("xs"))
    got = lists.map_relation(c, "c_custkey", "xs", t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderkey").alias("o")), "ys")
    return got.select("c_custkey", F.array_join(F.col("ys").cast("array<string>"), ",").alias("keys"))


@query("""SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id HAVING count(*) = max(turn) - min(turn) + 1""")
def rdf_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first/rest cells become lists by pointer doubling; here each conversation is a chain of its turns."""
    c = t(spark, sf_dir, "conversations")
    cell = lambda turn: F.concat_ws(":", "conv_id", turn)
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("low"), F.count(F.lit(1)).alias("n")).where("n = last - low + 1")
    cells = c.join(ends, "conv_id").select(cell(F.col("turn").cast("string")).alias("node"), F.col("role").alias("first"), F.when(F.col("turn") < F.col("last"), cell((F.col("turn") + 1).cast("string"))).alias("rest"))
    return lists.materialised(cells).select(F.substring_index("head", ":", 1).cast("long").alias("conv_id"), F.array_join("items", " ").alias("roles"))


# Windows, messages, streams


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3""")
def topk_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


@query("""SELECT user_id, event_id, concat_ws(',', lag(event_id, 2) OVER w, lag(event_id) OVER w, event_id) AS last3, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def message_window3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message with the last three of its stream and its successor."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id")
    got = messages.windows(e, ["user_id"], ["event_id"], "event_id", 3, "xs")
    return got.select("user_id", "event_id", F.array_join(F.col("xs").cast("array<string>"), ",").alias("last3"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("next_id"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over events as a stream, run over all input that there is."""
    e = t(spark, sf_dir, "events")
    source = streams.stream(spark, f"{sf_dir}/events.parquet", e.schema)
    out = streams.folder(spark, "daily")
    streams.settle(streams.tumbling_counts(source.withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type"), f"{out}/result", f"{out}/state")
    return spark.read.parquet(f"{out}/result").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'error'""")
def stream_rules_each_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule run over each batch of messages, without state between batches."""
    e = t(spark, sf_dir, "events")
    out = streams.folder(spark, "rules")
    rules = lambda b: b.where("event_type = 'error'").select("event_id", (F.col("value") * 2).alias("doubled"))
    streams.run_each(streams.stream(spark, f"{sf_dir}/events.parquet", e.schema), rules, f"{out}/result", f"{out}/state")
    return spark.read.parquet(f"{out}/result").select("event_id", "doubled")


@query("""SELECT conv_id AS stream, turn - (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id) + 1 AS "offset", role AS payload FROM conversations c
WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) = max(turn) - min(turn) + 1)""")
def message_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as message logs, one delimiter line between turns, and read back as envelopes."""
    c = t(spark, sf_dir, "conversations")
    whole = c.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("top"), F.count(F.lit(1)).alias("n")).where("n = top - low + 1")
    rows = F.array(F.struct((F.col("turn") * 2 - 1).alias("line_no"), F.when(F.col("turn") > F.col("low"), F.lit("MESSAGE")).otherwise('VERSION "1.2-messages"').alias("value")), F.struct((F.col("turn") * 2).alias("line_no"), F.col("role").alias("value")))
    log = c.join(whole, "conv_id").select(F.col("conv_id").alias("stream"), F.inline(rows))
    return messages.envelopes(log).select("stream", F.col("offset").cast("long").alias("offset"), F.array_join("payload", " ").alias("payload"))


# Formulas and rules as data


@query("""SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def graph_includes_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quoted graph for each customer, and a pattern proved in it."""
    o = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o"))
    return graph_includes(graph(o, "o_custkey"), "graph", p="status", o="F").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, count(*) AS source, count(*) FILTER (o_orderstatus <> 'F') + 1 AS patched, count(*) AS merged FROM orders GROUP BY 1""")
def graph_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs as values: deletion, insertion and union."""
    o = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o"))
    g = graph(o, "o_custkey").withColumn("gone", F.filter("graph", lambda x: x["o"] == "F"))
    g = g.withColumn("added", F.array(F.struct(F.lit("c").alias("s"), F.lit("seen").alias("p"), F.lit("yes").alias("o"))))
    n = lambda c: F.size(c).cast("long")
    return g.select("o_custkey", n("graph").alias("source"), n(patch("graph", "gone", "added")).alias("patched"), n(conjunction("graph", "gone")).alias("merged"))


@query("""SELECT n_nationkey::VARCHAR AS key, 3 + (CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS n FROM nation""")
def conclusion_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log:conclusion: the closure of a graph that holds its own rules."""
    start = F.when(F.col("n_nationkey") % 2 == 0, F.lit("on")).otherwise("off")
    g = F.array(F.struct(F.lit("x").alias("s"), F.lit("is").alias("p"), start.alias("o")))
    rules = F.array(rule([("?y", "is", "on")], [("?y", "is", "warm")]), rule([("x", "is", "warm")], [("x", "is", "safe")]))
    closed = conclusion(t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), g.alias("graph"), rules.alias("rules")), "key", "graph", "rules", "closed")
    return closed.select("key", (F.size("closed") + F.size("rules")).cast("long").alias("n"))


@query("""SELECT a.n_nationkey::VARCHAR AS key, 3 + 2 * (count(*) - 1) AS n FROM nation a JOIN nation b USING (n_regionkey) GROUP BY 1""")
def conclusion_two_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log:conclusion with variables and bodies of several triples: {?x in ?r. ?y in ?r} => {?x with ?y}, and neighbours that differ."""
    n = t(spark, sf_dir, "nation")
    home = n.select(F.col("n_nationkey").alias("k"), "n_regionkey").join(n, "n_regionkey")
    same = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r"), "n_regionkey").alias("o"))
    differ = F.when(F.col("k") != F.col("n_nationkey"), F.struct(F.lit("me").alias("s"), F.lit("differs").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("o")))
    g = home.groupBy(F.col("k").cast("string").alias("key")).agg(F.flatten(F.collect_list(F.array_compact(F.array(F.when(F.col("k") == F.col("n_nationkey"), same), differ)))).alias("graph"))
    g = g.withColumn("mine", F.array(F.struct(F.lit("me").alias("s"), F.lit("is").alias("p"), F.concat(F.lit("n"), "key").alias("o"))))
    rules = F.array(rule([("?m", "is", "?x"), ("?x", "in", "?r")], [("?m", "lives", "?r")]), rule([("?m", "lives", "?r"), ("?m", "differs", "?y")], [("?m", "near", "?y")]))
    closed = conclusion(g.select("key", F.concat("graph", "mine").alias("graph"), rules.alias("rules")), "key", "graph", "rules", "closed")
    return closed.select("key", F.size(F.filter("closed", lambda x: x["p"].isin("in", "is", "lives", "near", "differs"))).cast("long").alias("n"))


@query("""SELECT 'c' || a.conv_id || ':' || a.turn AS s, 'second' AS p, 'c' || a.conv_id || ':' || (a.turn + 2) AS o FROM conversations a
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2
UNION ALL SELECT 'c' || a.conv_id || ':' || (a.turn + 2), 'before', 'c' || a.conv_id || ':' || a.turn FROM conversations a
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2""")
def rules_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in a table, with several premises and variables, fired by joins until nothing new comes."""
    c = t(spark, sf_dir, "conversations")
    facts = column_facts(c.withColumn("next", F.concat(F.lit("c"), "conv_id", F.lit(":"), F.col("turn") + 1)), F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn"), {"next": "next", "role": "role"})
    rules = spark.range(1).select(F.inline(F.array(
        rule([("?x", "next", "?y"), ("?y", "next", "?z"), ("?z", "role", "?any")], [("?x", "second", "?z")]), rule([("?x", "second", "?z")], [("?z", "before", "?x")]),
    )))
    return saturate(facts, lambda new, full: fired(rules, new, full)).where("p IN ('second', 'before')")


@query("""SELECT r_name AS rule, 2::BIGINT AS premises, 'r' || r_regionkey AS head FROM region UNION ALL SELECT r_name, 1, 'r' || r_regionkey FROM region WHERE r_regionkey % 2 = 0""")
def rules_introspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log:implies and log:impliedBy: rules as facts between their graphs."""
    r = t(spark, sf_dir, "region")
    head_ = [("?x", "in", F.concat(F.lit("r"), "r_regionkey"))]
    rules = r.select("r_name", F.explode(F.array_compact(F.array(rule([("?x", "is", "place"), ("?x", "lies", F.col("r_name"))], head_), F.when(F.col("r_regionkey") % 2 == 0, rule([("?x", "near", F.col("r_name"))], head_))))).alias("r")).select("r.*")
    there, back = implies(rules), implied_by(rules).select(F.col("s").alias("o"), F.col("o").alias("s"))
    both = there.join(back, ["s", "o"], "left_semi")
    name = F.element_at("s", -1)["o"]
    return both.select(name.alias("rule"), F.size("s").cast("long").alias("premises"), F.col("o")[0]["o"].alias("head"))


@query("""SELECT 's' || n_nationkey AS s, p, 'r' || n_regionkey AS o FROM nation, (VALUES ('in'), ('within'), ('near')) x(p) UNION ALL SELECT * FROM (VALUES ('in', 'implies', 'within'), ('within', 'implies', 'near'))""")
def rule_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are facts take part in the same fixpoint."""
    f = t(spark, sf_dir, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r"), "n_regionkey").alias("o"))
    rules = spark.createDataFrame([("in", "implies", "within"), ("within", "implies", "near")], "s string, p string, o string")
    return promote(f.unionByName(rules))


@query("""SELECT o_orderkey::VARCHAR AS s, 'flag' AS p, 'late' AS o FROM orders WHERE o_orderstatus = 'P'""")
def dynamic_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{?o status "P"; says ?g} => ?g: what a bound graph holds becomes facts."""
    g = F.array(F.struct(F.col("o_orderkey").cast("string").alias("s"), F.lit("flag").alias("p"), F.lit("late").alias("o")))
    return asserted(t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(g.alias("g")), "g")


@query("""SELECT count(*) AS n, (SELECT count(*) FROM nation) AS traced FROM region""")
def traced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, seen = trace(t(spark, sf_dir, "nation"), "nations")
    df.write.format("noop").mode("overwrite").save()
    return t(spark, sf_dir, "region").agg(F.count(F.lit(1)).alias("n")).withColumn("traced", F.lit(seen.get["rows"]).cast("long"))


@query("""SELECT event_id, ((event_id % 5) * 86400 + (event_id % 7) * 3600 + 30)::DOUBLE AS seconds, ((event_id % 5) * 86400 + (event_id % 7) * 3600 + 30) > 200000 AS long FROM events""")
def time_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations compare by their seconds."""
    e = t(spark, sf_dir, "events").selectExpr("event_id", "concat('P', event_id % 5, 'DT', event_id % 7, 'H30S') AS d")
    e = solve(e.withColumn("x", maths.duration_seconds("d")), "seconds", "math:sum", "x")
    return e.select("event_id", "seconds", BUILTINS["math:greaterThan"]("seconds", 200000).alias("long"))


@query("""SELECT c_custkey, 'Customer ' || c_custkey AS lex, 'en' AS lang, CASE WHEN c_custkey % 2 = 0 THEN 'http://e/' || c_custkey END AS iri FROM customer""")
def term_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals from text and tag, IRIs from text; text with a space is no IRI."""
    c = t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Customer "), "c_custkey").alias("x"))
    c = c.withColumn("l", BUILTINS["log:langlit"]("x", F.lit("en"))).withColumn("i", text_uri(F.concat(F.when(F.col("c_custkey") % 2 == 0, "http://e/").otherwise("not one "), "c_custkey")))
    return c.select("c_custkey", BUILTINS["dt:lexicalForm"]("l").alias("lex"), BUILTINS["dt:language"]("l").alias("lang"), BUILTINS["log:uri"]("i").alias("iri"))


# Sources and sinks


@query("""SELECT c_custkey::VARCHAR AS s, c_name AS name, c_mktsegment AS segment FROM customer""")
def triple_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written as lines of N-Triples, read back, and joined."""
    c = t(spark, sf_dir, "customer")
    f = column_facts(c, F.concat(F.lit("http://example.org/c"), "c_custkey"), {"c_name": "http://example.org/name", "c_mktsegment": "http://example.org/segment"})
    lines = triples.lines(f.select(term("I", "s").alias("s"), "p", term("L", "o").alias("o")))
    back = triples.parse_lines(lines)
    get = lambda p, v: back.where(F.col("p") == f"http://example.org/{p}").select(F.col("s")["lex"].alias("s"), F.col("o")["lex"].alias(v))
    return body(get("name", "name"), get("segment", "segment")).withColumn("s", F.regexp_replace("s", "^http://example.org/c", ""))


@query("""SELECT o_orderkey::VARCHAR AS s, 'status' AS p, o_orderstatus AS o, 'explicit' AS kind FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey::VARCHAR, 'status', 'P', 'inferred' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0""")
def store_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet store with explicit and inferred facts, asked with predicate and object bound."""
    f = column_facts(t(spark, sf_dir, "orders"), F.col("o_orderkey"), {"o_orderstatus": "status", "o_orderpriority": "priority"})
    path = streams.folder(spark, "store")
    triples.save(f, path)
    triples.save(f.where("p = 'status' AND cast(s AS long) % 2 = 0"), path, "inferred")
    return triples.load(spark, path, p="status", o="P")


@query("""SELECT string_agg(r_name, '' ORDER BY r_regionkey) AS text FROM region""")
def output_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.output_string(t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("k"), F.col("r_name").alias("v")), "k", "v")


@query("""SELECT 's' || n_nationkey AS s, 'located' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey""")
def derived_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual output: what rules added, without what was asserted."""
    base = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("s"), "n_nationkey").alias("s"), F.lit("in").alias("p"), F.col("r_name").alias("o"))
    full = saturate(base, lambda new, full: head(match(new, Var("x"), "in", Var("y")), (Var("x"), "located", Var("y"))))
    return triples.derived(full, base)


@query("""SELECT 'c' || c_custkey AS s, 'trades' AS p, r_name AS o, 'rule7' AS rule, 'c' || c_custkey || ' nation ' || n_name AS first_premise FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def proof_of_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived facts with the rule and the premises of a proof."""
    g = subclass_geo(spark, sf_dir).withColumn("c", F.concat(F.lit("c"), "c_custkey"))
    got = proved(g, "rule7", [(Var("c"), "nation", Var("n_name")), (Var("n_name"), "region", Var("r_name"))], (Var("c"), "trades", Var("r_name")))
    return got.select("s", "p", "o", "rule", F.col("premises")[0].alias("first_premise"))


@query("""SELECT 's' || s_suppkey || ' serves ' || r_name AS goal, fact, rule FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
(VALUES (0), (1), (2), (3)) x(k), LATERAL (SELECT CASE k WHEN 0 THEN 's' || s_suppkey || ' serves ' || r_name WHEN 1 THEN 's' || s_suppkey || ' lies ' || r_name WHEN 2 THEN 's' || s_suppkey || ' in ' || n_name ELSE n_name || ' of ' || r_name END AS fact,
CASE k WHEN 0 THEN 'r2' WHEN 1 THEN 'r1' END AS rule)""")
def proof_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of proofs: all facts that a derived fact rests on, down to what was asserted."""
    n = t(spark, sf_dir, "nation").join(F.broadcast(t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    g = t(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("x"), F.col("n_name").alias("y"), F.col("r_name").alias("z"))
    lies = proved(g, "r1", [(Var("x"), "in", Var("y")), (Var("y"), "of", Var("z"))], (Var("x"), "lies", Var("z")))
    serves = proved(g, "r2", [(Var("x"), "lies", Var("z"))], (Var("x"), "serves", Var("z")))
    return proof_chains(serves.select(F.concat_ws(" ", "s", "p", "o").alias("goal")), lies.unionByName(serves))


@query("""SELECT p_partkey, p_name AS lex, CASE WHEN p_size % 2 = 0 THEN 'http://www.w3.org/2001/XMLSchema#string' ELSE 'urn:kind' END AS dt FROM part WHERE p_size % 3 <> 0""")
def literal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log:dtlit with a bound result: literals without a tag come apart, plain ones as strings; others have no solution."""
    p = t(spark, sf_dir, "part")
    plain, typed = term("L", "p_name"), term("L", "p_name", F.lit("urn:kind"))
    p = p.withColumn("t", F.when(F.col("p_size") % 3 == 0, term("L", "p_name", None, F.lit("en"))).when(F.col("p_size") % 2 == 0, plain).otherwise(typed))
    got = p.withColumn("parts", INVERSES["log:dtlit"]("t")).where("parts IS NOT NULL")
    return got.select("p_partkey", "parts.lex", "parts.dt")


# User functions


@query("""SELECT p_partkey, length(replace(p_name, ' ', '')) AS n FROM part""")
def udf_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function with one solution, in Arrow batches."""
    def letters(names: pd.Series) -> pd.Series:
        return names.str.replace(" ", "", regex=False).str.len()

    return t(spark, sf_dir, "part").select("p_partkey", F.pandas_udf(letters, LongType())("p_name").alias("n"))


@query("""SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part""")
def udtf_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function with several solutions."""
    def words(names: pd.Series) -> pd.Series:
        return names.str.split(" ")

    return t(spark, sf_dir, "part").select("p_partkey", F.explode(F.pandas_udf(words, "array<string>")("p_name")).alias("word"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE (event_id % 4) WHEN 0 THEN 'log:Formula' WHEN 1 THEN 'log:Literal' WHEN 2 THEN 'rdf:List' ELSE 'log:Other' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def raw_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, "GLTI")), (F.col("event_id") % 4 + 1).cast("int"))
    e = t(spark, sf_dir, "events").select(term("I", F.lit("x")).withField("kind", kind).alias("t"))
    return e.select(BUILTINS["log:rawType"]("t").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(DISTINCT user_id) AS names, count(DISTINCT (user_id, event_type)) AS pairs FROM events GROUP BY 1""")
def skolem_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log:skolem gives one name for one term, and another for a list of two."""
    e = t(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.countDistinct(skolem("user_id")).alias("names"), F.countDistinct(skolem("user_id", "event_type")).alias("pairs"))


# Built-ins over odd inputs


@query("""SELECT p_partkey, contains(p_type, 'STEEL') AS has, ends_with(p_name, right(p_type, 1)) AS ends, lower(p_name) <> lower(p_type) AS differ, p_type > p_brand AS greater,
NOT p_type > p_brand AS not_greater, NOT p_type < p_brand AS not_less FROM part""")
def string_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = BUILTINS
    return t(spark, sf_dir, "part").select(
        "p_partkey", b["string:contains"]("p_type", F.lit("STEEL")).alias("has"), b["string:endsWith"]("p_name", F.substring("p_type", -1, 1)).alias("ends"), b["string:notEqualIgnoringCase"]("p_name", "p_type").alias("differ"),
        b["string:greaterThan"]("p_type", "p_brand").alias("greater"), b["string:notGreaterThan"]("p_type", "p_brand").alias("not_greater"), b["string:notLessThan"]("p_type", "p_brand").alias("not_less"),
    )


@query("""SELECT p_partkey, substr(p_name, 1, 1) AS at2, NULL::VARCHAR AS inside, '' AS beyond, chr(128512) || 'X' || substr(p_name, 2) AS set2, length(p_name) + 2 AS n FROM part""")
def string_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places count UTF-16 units, as lengths do: a character beyond U+FFFF takes two, and half of it is no text."""
    p = t(spark, sf_dir, "part").withColumn("x", F.concat(F.lit("\U0001f600"), "p_name"))
    b = BUILTINS
    return p.select(
        "p_partkey", b["string:charAt"]("x", 2).alias("at2"), b["string:charAt"]("x", 1).alias("inside"), b["string:charAt"]("x", 999).alias("beyond"),
        b["string:setCharAt"]("x", 2, F.lit("X")).alias("set2"), b["string:length"]("x").cast("long").alias("n"),
    )


@query("""SELECT event_id, printf('%.3e', event_id + 0.3) AS e, CASE WHEN event_id < 100000 THEN event_id || '.5' END AS g FROM events""")
def string_format_reals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = BUILTINS["string:format"]
    e = t(spark, sf_dir, "events").withColumn("x", F.col("event_id") + 0.5)
    return e.select("event_id", f("%.3e", F.col("event_id") + 0.3).alias("e"), F.when(F.col("event_id") < 100000, f("%.9g", "x")).alias("g"))


@query("""WITH RECURSIVE p AS (SELECT 0 AS k, 1::HUGEINT AS v UNION ALL SELECT k + 1, v * 3 FROM p WHERE k < 79)
SELECT event_id, (9007199254740990 + event_id % 10)::VARCHAR AS kept, (100000000000000000000::HUGEINT + event_id)::VARCHAR AS long_kept, (event_id + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::VARCHAR AS half_up,
v::VARCHAR AS power, CASE WHEN event_id % 3 = 0 THEN event_id // 7 END AS whole FROM events JOIN p ON k = event_id % 80""")
def math_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers stay exact, ties go upward, and text that is no number has no solution."""
    b, i = BUILTINS, F.col("event_id")
    text = lambda x: x.cast("string")
    e = t(spark, sf_dir, "events").withColumn("odd", F.when(i % 3 == 0, i.cast("string")).otherwise("x"))
    return e.select(
        "event_id", text(b["math:rounded"](F.lit(9007199254740990) + i % 10)).alias("kept"), text(b["math:rounded"](F.concat(F.lit("1"), F.lpad(i.cast("string"), 20, "0")))).alias("long_kept"),
        text(b["math:rounded"](i + F.when(i % 2 == 0, 0.5).otherwise(0.25))).alias("half_up"), text(b["math:exponentiation of integers"](3, i % 80)).alias("power"), b["math:integerQuotient"]("odd", 7).alias("whole"),
    )


@query("""SELECT event_id, event_id % 5 > 2 AS longer, event_id % 4 <> 1 AND event_id % 5 * 86400 = 172800 AS two_days, ts < TIMESTAMP '2024-03-01' AS before, event_id % 4 <> 1 AND event_id % 5 * 86400 >= 86400 AS long FROM events""")
def math_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, dateTimes and numbers on one scale; text that is neither passes no test."""
    b = BUILTINS
    e = t(spark, sf_dir, "events").withColumn("d", F.concat(F.lit("P"), F.col("event_id") % 5, F.lit("D"))).withColumn("odd", F.when(F.col("event_id") % 4 == 1, "soon").otherwise(F.col("d")))
    e = e.withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return e.select(
        "event_id", b["math:greaterThan"]("d", F.lit("PT48H")).alias("longer"), b["math:equalTo"]("odd", 172800).alias("two_days"),
        b["math:lessThan"]("at", F.lit("2024-03-01")).alias("before"), b["math:notLessThan"]("odd", F.lit("P1D")).alias("long"),
    )


@query("""SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 25 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS later, strftime(date_trunc('second', ts) - INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS earlier FROM events""")
def time_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dateTime and a duration, or seconds, give a dateTime in UTC; the text's offset counts."""
    e = t(spark, sf_dir, "events").withColumn("at", F.concat(F.date_format(F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return e.select("event_id", BUILTINS["math:sum of dateTime and duration"]("at", F.lit("P1DT1H")).alias("later"), BUILTINS["math:difference of dateTime and duration"]("at", 90).alias("earlier"))


@query("""SELECT event_id, CASE WHEN event_id % 14 BETWEEN 1 AND 12 AND event_id % 26 < 24 THEN event_id % 14 END AS month, CASE WHEN event_id % 14 BETWEEN 1 AND 12 AND event_id % 26 < 24 THEN event_id % 26 END AS hour FROM events""")
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part out of its range leaves no solution for any part."""
    e = t(spark, sf_dir, "events").selectExpr("event_id", "format_string('2024-%02d-31T%02d:00:59', event_id % 14, event_id % 26) AS x")
    return e.select("event_id", *[times.BUILTINS[f"time:{p}"]("x").cast("long").alias(p) for p in ("month", "hour")])


@query("""SELECT event_id, event_id % 80 - 40 > -45 AND event_id % 80 - 40 < 39 AS is_float, true AS is_double, event_id % 4 = 1 AS is_uri, event_id % 3 <> 0 AS is_name, event_id % 2 = 0 AS is_base64,
(event_id * 100 + 50)::VARCHAR AS plain FROM events""")
def dt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of binary numbers, colons in references, characters of names, blanks in base64, and numbers' shortest text."""
    e = t(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('1E', event_id % 80 - 40) AS f", "concat(element_at(array(':', 'urn:', 'a b', '%zz'), int(event_id % 4 + 1)), event_id) AS u",
        "concat(if(event_id % 3 = 0, '·', 'a·'), event_id) AS n", "concat('AQ', if(event_id % 2 = 0, ' ', ' =='), 'ID') AS b", "concat(event_id, '.5E2') AS d",
    )
    v = datatypes.valid
    return e.select(
        "event_id", v("f", "float").alias("is_float"), v("f", "double").alias("is_double"), v("u", "anyURI").alias("is_uri"), v("n", "NCName").alias("is_name"), v("b", "base64Binary").alias("is_base64"),
        datatypes.canonical("d", "double").alias("plain"),
    )


@query("""SELECT event_id, event_id % 3 = 1 AS differ, CASE WHEN event_id % 2 = 0 THEN 'integer' ELSE 'decimal' END AS dt FROM events""")
def dt_different(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt:datatype, and dt:differentValueFrom: literals that can't be compared aren't different."""
    e = t(spark, sf_dir, "events").selectExpr("event_id", "concat(event_id, '.50') AS a", "CASE event_id % 3 WHEN 0 THEN concat('+', event_id, '.5') WHEN 1 THEN concat(event_id, '.25') ELSE 'x' END AS b")
    literal = BUILTINS["log:dtlit"]("a", F.when(F.col("event_id") % 2 == 0, "integer").otherwise("decimal"))
    return e.select("event_id", BUILTINS["dt:differentValueFrom"]("a", "decimal", "b", "decimal").alias("differ"), BUILTINS["dt:datatype"](literal).alias("dt"))


@query("""SELECT p_partkey, list_contains(w, 'steel') OR list_contains(w, w[1]) AS known, list_contains(w, p_brand) AS brand, w[1] AS first, len(w) - 1 AS others, word FROM (SELECT p_partkey, p_brand, w, unnest(w) AS word FROM (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w FROM part))""")
def list_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = BUILTINS
    p = lists.member(t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("w")), "w", "word")
    split = b["list:firstRest"]("w")
    return p.select("p_partkey", b["list:in"](b["rdf:first"]("w"), "w").alias("known"), b["list:in"]("p_brand", "w").alias("brand"), split["first"].alias("first"), F.size(b["rdf:rest"]("w")).cast("long").alias("others"), "word")


@query("""SELECT l_suppkey AS y, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1""")
def list_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{(?x ?y 1) soldIn ?z}: a list in a pattern takes tuples apart."""
    place = F.array("l_partkey", "l_suppkey", F.col("l_linenumber").cast("long"))
    f = t(spark, sf_dir, "lineitem").select(place.alias("s"), F.lit("soldIn").alias("p"), F.col("l_orderkey").alias("o"))
    return match(f, (Var("x"), Var("y"), 1), "soldIn", Var("z")).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, c_custkey % 2 = 0 AS same, c_custkey % 3 <> 0 AS other, 2 + (c_custkey % 2)::BIGINT AS triples FROM customer""")
def log_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log:equalTo, log:notEqualTo and log:conjunction, which holds a triple once."""
    c, b = t(spark, sf_dir, "customer"), BUILTINS
    one = lambda o: F.struct(F.lit("x").alias("s"), F.lit("p").alias("p"), o.alias("o"))
    a, z = F.array(one(F.lit("1")), one(F.lit("2"))), F.array(one(F.when(F.col("c_custkey") % 2 == 0, "2").otherwise("3")))
    k = F.col("c_custkey")
    return c.select("c_custkey", b["log:equalTo"](k % 2, F.lit(0)).alias("same"), b["log:notEqualTo"](F.lit(0), k % 3).alias("other"), F.size(b["log:conjunction"](a, z)).cast("long").alias("triples"))


@query("""SELECT l_returnflag, count(*) AS n, round(product(1 + l_discount / 1000), 6) AS grown FROM lineitem GROUP BY 1""")
def product_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """math:product over all that collectAllIn finds, as an aggregate."""
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.product(1 + F.col("l_discount") / 1000), 6).alias("grown"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT') SELECT c_custkey::VARCHAR AS s, 'customer' AS p, 'yes' AS o FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'calm', 'yes' FROM customer WHERE c_custkey NOT IN (SELECT c FROM e) UNION ALL SELECT c::VARCHAR, 'urgent', 'yes' FROM e
UNION ALL SELECT c::VARCHAR, 'excited', 'yes' FROM e""")
def scope_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of three levels: each sees the lower levels saturated and frozen."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("s"), F.lit("customer").alias("p"), F.lit("yes").alias("o"))
    orders = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("x"))
    people = lambda f, what: match(f, Var("x"), what, "yes")
    return levels(c, {
        0: [lambda new: head(includes(people(new, "customer"), orders, ["x"]), (Var("x"), "urgent", "yes"))],
        2: [lambda frozen: head(not_includes(people(frozen, "customer"), people(frozen, "calm"), ["x"]), (Var("x"), "excited", "yes"))],
        1: [lambda frozen: head(not_includes(people(frozen, "customer"), people(frozen, "urgent"), ["x"]), (Var("x"), "calm", "yes"))],
    })


@query("""SELECT l_partkey::VARCHAR AS s, 'from' AS p, 's' || l_suppkey AS o FROM lineitem UNION SELECT l_partkey::VARCHAR, 'from', 't' || l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0""")
def sameas_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal terms in the place of objects."""
    f = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("s"), F.lit("from").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("o")).distinct()
    even = t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return same_as(f, even.select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("t"), "s_suppkey").alias("b")), objects=True)


@query("""SELECT conv_id AS stream, turn - (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id) + 1 AS "offset", role AS payload,
CASE WHEN turn < (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id) THEN turn - (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id) + 2 END AS next_offset FROM conversations c
WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) = max(turn) - min(turn) + 1)""")
def message_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiters with a comment behind them, and version lines in either kind of quotes."""
    c = t(spark, sf_dir, "conversations")
    whole = c.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("top"), F.count(F.lit(1)).alias("n")).where("n = top - low + 1")
    rows = F.array(F.struct((F.col("turn") * 2 - 1).alias("line_no"), F.when(F.col("turn") > F.col("low"), F.lit("MESSAGE # next")).otherwise("VERSION '1.2' # form").alias("value")), F.struct((F.col("turn") * 2).alias("line_no"), F.col("role").alias("value")))
    log = c.join(whole, "conv_id").select(F.col("conv_id").alias("stream"), F.inline(rows))
    return messages.envelopes(log).select("stream", F.col("offset").cast("long").alias("offset"), F.array_join("payload", " ").alias("payload"), F.col("next_offset").cast("long").alias("next_offset"))


@query("""SELECT user_id, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1""")
def stream_carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number and a sum carried from message to message for each user; the last row of a user is the state at the end."""
    e = t(spark, sf_dir, "events")
    out = streams.folder(spark, "carried")
    streams.settle_updates(streams.carried(streams.stream(spark, f"{sf_dir}/events.parquet", e.schema), "user_id", "value"), f"{out}/result", f"{out}/state")
    got = spark.read.parquet(f"{out}/result").groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch_no").alias("x"))
    return got.select("user_id", "x.n", F.round("x.total", 4).alias("total"))
