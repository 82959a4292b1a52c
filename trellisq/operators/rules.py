"""What rules do besides joins: constraints, existential heads, equality, graphs as values, and rules as data.

Rules as data are rows (premise, conclusion) of quoted graphs, in which a text that begins with ? is a variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.logic import skolem
from ..plans.fixpoint import reach, saturate

GRAPH = "array<struct<s: string, p: string, o: string>>"


class FuseError(RuntimeError):
    """A constraint ({...} => false) fired; code is what a command line would exit with."""

    code = 65


def fuse(bad: DataFrame, name: str = "constraint") -> None:
    """Raises FuseError if the body of a constraint has any solution; looks for one row only."""
    row = bad.limit(1).collect()
    if row:
        raise FuseError(f"{name}: {row[0].asDict()}")


def existential(bindings: DataFrame, rule: str, label: str, out: str) -> DataFrame:
    """bindings with a fresh name for a head's blank node: one for each rule, binding and label, the same on every run."""
    return bindings.withColumn(out, skolem(F.lit(rule), F.lit(label), *[F.col(c) for c in bindings.columns]))


def same_as(facts: DataFrame, pairs: DataFrame, objects: bool = False) -> DataFrame:
    """facts with the subjects of stored pairs (a, b), and with ``objects`` their objects too, interchangeable from a to b.

    Pairs aren't made symmetric or transitive; every term is the same as itself, so the facts themselves stay.
    """
    swap = pairs.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    out = facts.unionByName(facts.join(swap, F.col("s") == F.col("__a")).select(F.col("__b").alias("s"), "p", "o"))
    if objects:
        out = out.unionByName(out.join(swap, F.col("o") == F.col("__a")).select("s", "p", F.col("__b").alias("o")))
    return out.distinct()


def graph(facts: DataFrame, by: str | None = None, out: str = "graph") -> DataFrame:
    """Facts as one canonical graph value for each ``by``: distinct triples in sorted order, so equal graphs are equal values."""
    value = F.array_sort(F.collect_set(F.struct("s", "p", "o"))).alias(out)
    return facts.groupBy(by).agg(value) if by else facts.agg(value)


def conjunction(*graphs: str):  # noqa: ANN201
    return F.array_sort(F.array_distinct(F.concat(*[F.col(g) for g in graphs])))


def patch(source: str, delete: str, insert: str):  # noqa: ANN201
    """A graph without the deleted triples and with the inserted ones."""
    return F.array_sort(F.array_union(F.array_except(source, delete), insert))


def graph_includes(df: DataFrame, graph: str, **bound: str) -> DataFrame:
    """A row for each triple of the quoted graph that agrees with the given constants, as columns g_s, g_p, g_o."""
    out = df.select("*", F.inline(graph).alias("g_s", "g_p", "g_o"))
    for place, value in bound.items():
        out = out.where(F.col(f"g_{place}") == value)
    return out


def asserted(df: DataFrame, graph: str) -> DataFrame:
    """A dynamic head: the triples of a bound quoted graph as facts."""
    return df.select(F.inline(graph)).distinct()


def trace(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds the number of its rows once an action has run over it; nothing else changes."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def rule(premise: list[tuple], conclusion: list[tuple]):  # noqa: ANN201
    """A rule as a value: two quoted graphs. A text that begins with ? is a variable."""
    quoted = lambda g: F.array(*[F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("string").alias(n) for n, x in zip("spo", t, strict=True)]) for t in g]).cast(GRAPH)
    return F.struct(quoted(premise).alias("premise"), quoted(conclusion).alias("conclusion"))


def implies(rules: DataFrame) -> DataFrame:
    """log:implies: the rules themselves as (s, o), s the premise's graph and o the conclusion's."""
    return rules.select(F.col("premise").alias("s"), F.col("conclusion").alias("o"))


def implied_by(rules: DataFrame) -> DataFrame:
    """log:impliedBy: the same facts the other way round."""
    return rules.select(F.col("conclusion").alias("s"), F.col("premise").alias("o"))


def _order(fresh: int, most: int) -> list[int]:
    """The fresh premise first, then those before it, backwards, then those behind it: neighbours in a body mostly share a variable."""
    return [*range(fresh, -1, -1), *range(fresh + 1, most)]


def _masks(shape: list, before: list[int], k: int) -> str:
    """The places of the k-th premise that are known when the premises ``before`` are solved: constants, and variables of theirs."""
    met = {v for j in before if j < len(shape) for v in shape[j]}
    return "".join(x if v == "" or v in met else "-" for x, v in zip("spo", shape[k], strict=True))


def _solved(bindings: DataFrame, facts: DataFrame, k: int, masks: list[str], by: list[str]) -> DataFrame:
    """bindings, each extended by every fact that agrees with the k-th premise; rules with fewer premises go on as they are.

    Which places of a premise are bound differs between rules, so facts are offered under a key for each set of bound
    places that occurs, of eight at most, and the join is on equal keys.
    """
    done, open_ = bindings.where(F.size("premise") <= k), bindings.where(F.size("premise") > k)
    place = {x: F.col("premise")[k][x] for x in "spo"}
    known = {x: F.when(place[x].startswith("?"), F.try_element_at("__b", place[x])).otherwise(place[x]) for x in "spo"}
    mask = F.concat(*[F.when(known[x].isNull(), "-").otherwise(x) for x in "spo"])
    open_ = open_.withColumn("__at", F.struct(mask.alias("mask"), *[F.coalesce(known[x], F.lit("")).alias(x) for x in "spo"]))
    at = F.array(*[F.struct(F.lit(m).alias("mask"), *[(F.col(x) if x in m else F.lit("")).alias(x) for x in "spo"]) for m in masks])
    offered = facts.select(*[F.col(c).alias(f"__{c}") for c in by], F.struct("s", "p", "o").alias("__f"), F.explode(at).alias("__offer"))
    same = F.col("__at") == F.col("__offer")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = open_.join(offered, same)
    pair = {x: F.when(~F.contains(F.col("__at.mask"), F.lit(x)), F.struct(place[x].alias("key"), F.col("__f")[x].alias("value"))) for x in "spo"}
    agree = F.lit(True)
    for x, y in ("sp", "so", "po"):  # a variable twice in one premise
        agree &= F.coalesce((pair[x]["key"] != pair[y]["key"]) | (pair[x]["value"] == pair[y]["value"]), F.lit(True))
    fresh = F.map_from_entries(F.array_distinct(F.array_compact(F.array(*pair.values()))))
    met = met.where(agree).withColumn("__b", F.map_concat("__b", fresh))
    return done.unionByName(met.select(*done.columns))


def fired(rules: DataFrame, new: DataFrame, full: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, s, p, o): what rules that are rows derive with at least one fact of ``new``. rules: by, premise, conclusion.

    by: columns that keep quoted graphs apart. A rule without premises fires always. Conclusions with an unbound
    variable give nothing. Premises are solved from the new fact on, in the order of the body to both sides.
    """
    by = by or []
    variable = lambda x: F.when(x.startswith("?"), x).otherwise("")
    kinds = F.transform("premise", lambda t: F.array(*[variable(t[x]) for x in "spo"]))
    shapes = [r[0] for r in rules.select(kinds).distinct().collect()]  # how rules are built: variables and where constants are
    most = max([1, *map(len, shapes)])
    masks = {(f, k): sorted({_masks(x, _order(f, most)[:i], k) for x in shapes if max(f, k) < len(x)}) for f in range(most) for i, k in enumerate(_order(f, most))}
    out = None
    for fresh in range(most):
        b = rules.select(*by, "premise", "conclusion", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("__b"))
        b = b.where(F.size("premise") > fresh) if fresh else b
        for k in _order(fresh, most):
            if masks[fresh, k]:
                b = _solved(b, new if k == fresh else full, k, masks[fresh, k], by)
        heads = b.select(*by, "__b", F.inline("conclusion"))
        place = lambda x: F.when(F.col(x).startswith("?"), F.try_element_at("__b", F.col(x))).otherwise(F.col(x)).alias(x)
        found = heads.select(*by, *map(place, "spo")).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def conclusion(df: DataFrame, key: str, graph: str, rules: str, out: str) -> DataFrame:
    """df with the deductive closure of each row's quoted graph under its own rules (an array of ``rule`` values).

    All graphs are saturated together, one relation keyed by the row. Premises may be several, with variables.
    """
    triples = df.select(key, F.inline(graph))
    own = df.select(key, F.inline(rules))
    closed = saturate(triples, lambda new, full: fired(own, new, full, [key]))
    value = closed.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("s", "p", "o"))).alias(out))
    return df.join(value, key, "left").withColumn(out, F.coalesce(out, F.array().cast(GRAPH)))


def promote(facts: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Facts saturated under rules that are facts themselves: (p, 'implies', q) says that every s p o gives s q o.

    Derived rules take part at once: the rules are read from the facts in every round, by a join.
    """

    def fire(f: DataFrame, r: DataFrame) -> DataFrame:
        rules = r.where("p = 'implies'").select(F.col("s").alias("__p"), F.col("o").alias("__q"))
        data = f.select(F.col("s").alias("__s"), F.col("p").alias("__was"), F.col("o").alias("__o"))
        return data.join(rules, F.col("__was") == F.col("__p")).select(F.col("__s").alias("s"), F.col("__q").alias("p"), F.col("__o").alias("o"))

    return saturate(facts, lambda new, full: fire(new, full).unionByName(fire(full, new)), most_rounds=most_rounds)


def proved(bindings: DataFrame, rule: str, premises: list[tuple], conclusion: tuple) -> DataFrame:
    """Facts of a rule's head with why they hold: rule, premises (facts as text) and bindings (variables' values as text); one proof for each fact.

    premises and conclusion are triples of columns (Var) and constants. Of several proofs the least one stays, so that
    reruns agree.
    """
    from .patterns import Var

    place = lambda x: F.col(x) if isinstance(x, Var) else F.lit(x)
    text = lambda t: F.concat_ws(" ", *[place(x).cast("string") for x in t])
    used = sorted({str(x) for t in [*premises, conclusion] for x in t if isinstance(x, Var)})
    s, p, o = (place(x).cast("string") for x in conclusion)
    values = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in used])
    rows = bindings.select(s.alias("s"), p.alias("p"), o.alias("o"), F.struct(F.lit(rule).alias("rule"), F.array(*map(text, premises)).alias("premises"), values.alias("bindings")).alias("why"))
    return rows.groupBy("s", "p", "o").agg(F.min("why").alias("why")).select("s", "p", "o", "why.rule", "why.premises", "why.bindings")


def proof_chains(goals: DataFrame, proofs: DataFrame) -> DataFrame:
    """(goal, fact, rule): every fact that the goals' proofs rest on, as text, with the rule that gave it; rule is null for what was asserted.

    goals: column goal, facts as text 's p o'. proofs: what ``proved`` gives for all rules together.
    """
    of = proofs.select(F.concat_ws(" ", "s", "p", "o").alias("s"), "rule", "premises")
    steps = reach(goals.select(F.col("goal").alias("start")).distinct(), of.select("s", F.explode("premises").alias("o")).distinct())
    least = of.groupBy("s").agg(F.min("rule").alias("rule"))
    return steps.join(least, F.col("node") == F.col("s"), "left").select(F.col("start").alias("goal"), F.col("node").alias("fact"), "rule")


def project(facts: DataFrame, *columns) -> DataFrame:  # noqa: ANN002
    """log:query: the distinct projection of what a body selects from the saturated facts."""
    return facts.select(*columns).distinct()


class Builtins:
    """User functions by name. A scalar is a Python function wrapped for Arrow, a generator a table function."""

    def __init__(self):
        self._known: dict[str, Callable] = {}

    def register(self, name: str, f: Callable) -> None:
        if not callable(f):
            raise TypeError("a built-in must be callable")
        self._known[name] = f

    def unregister(self, name: str) -> bool:
        return self._known.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._known)

    def __getitem__(self, name: str) -> Callable:
        return self._known[name]
