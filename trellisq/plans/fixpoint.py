"""Saturation of recursive rules: semi-naive rounds on DataFrames, and path doubling for transitive relations.

Each round's result is written to the folder of spark.checkpoint.dir, so that plans stay short and a lost executor
costs no recomputation of earlier rounds.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it's unset, as in tests, one under /tmp, but never on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def named(df: DataFrame, prefix: str) -> DataFrame:
    """df with all columns renamed, for joins of a relation with itself."""
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


class NotSettled(RuntimeError):
    """The rules still derive facts after the allowed number of rounds."""


def saturate(base: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: list[str] | None = None, most_rounds: int = 1000, each: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """The least set that holds base and, for all of its rows, what step derives.

    step(new, full) gives what one application of the rules derives with at least one row of ``new``; for a rule with two
    recursive atoms that is the union over the atom that reads ``new``. key: the columns by which a fact is known; the
    first spelling stays. Rounds go on until nothing new comes, so a rule must not invent values without end. each:
    called with the round's number and its new facts, to stream facts as they're derived.
    """
    key = key or base.columns
    full = new = cut(base.dropDuplicates(key))
    done = [full]
    for rounds in range(1, most_rounds + 1):
        found = step(new, full).select(*base.columns).dropDuplicates(key)
        known = full.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in key])
        same = None
        for k in key:
            eq = F.col(f"`{k}`").eqNullSafe(F.col(f"__{k}"))
            same = eq if same is None else same & eq
        new = cut(found.join(known, same, "left_anti"))
        if new.isEmpty():
            return full
        if each:
            each(rounds, new)
        done.append(new)
        if len(done) > 8:
            done = [cut(_union(done))]
        full = _union(done)
    raise NotSettled(f"not settled after {most_rounds} rounds")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure(edges: DataFrame, source: str = "s", target: str = "o", most_rounds: int = 64, by: list[str] | None = None) -> DataFrame:
    """Transitive closure (by, source, target) in about log2 of the longest path rounds: new paths join all known ones.

    by: columns that both ends share, such as a conversation; joins then partition by them too.
    """
    by = by or []
    cols = [*by, source, target]

    def step(new: DataFrame, full: DataFrame) -> DataFrame:
        def joined(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = named(a, "a_"), named(b, "b_")
            on = F.col(f"a_{target}") == F.col(f"b_{source}")
            for c in by:
                on &= F.col(f"a_{c}") == F.col(f"b_{c}")
            return a.join(b, on).select(*[F.col(f"a_{c}").alias(c) for c in by], F.col(f"a_{source}").alias(source), F.col(f"b_{target}").alias(target))

        return joined(new, full).unionByName(joined(full, new))

    return saturate(edges.select(*cols), step, cols, most_rounds)


def reach(starts: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(start, node): nodes reached from given starts, the demand-driven form of a recursive backward rule.

    starts: column start; edges: columns s and o. Only what the starts ask for is derived.
    """
    hop = named(edges.select("s", "o"), "e_")

    def step(new: DataFrame, full: DataFrame) -> DataFrame:
        return new.join(hop, F.col("node") == F.col("e_s")).select("start", F.col("e_o").alias("node"))

    return saturate(starts.select("start", F.col("start").alias("node")), step, ["start", "node"], most_rounds)


def layers(facts: DataFrame, rules: list[list[Callable[..., DataFrame]]], most_rounds: int = 1000) -> DataFrame:
    """Stratified rules over facts: each layer is saturated while it reads the frozen result of the layers before.

    A rule returns facts and names what it reads by its parameters: ``new`` and ``full`` for a rule that joins a round's
    new facts with all (semi-naive), ``frozen`` for one that negates or aggregates. A rule that reads frozen facts alone
    runs once. Other names, first or alone, mean all facts of the layer so far. What a scoped rule doesn't find in the
    frozen facts is false for it, whatever its own layer derives.
    """
    for layer in rules:
        frozen, reads = facts, [list(inspect.signature(r).parameters) for r in layer]
        first = [True]

        def step(new: DataFrame, full: DataFrame, layer=layer, reads=reads, frozen=frozen, first=first) -> DataFrame:  # noqa: ANN001
            given = {"new": new, "full": full, "frozen": frozen}
            run = [(r, names) for r, names in zip(layer, reads, strict=True) if first[0] or names != ["frozen"]]
            first[0] = False
            return _union([r(*[given.get(n, full) for n in names]).select(*facts.columns) for r, names in run] or [full.limit(0)])

        facts = saturate(facts, step, facts.columns, most_rounds)
    return facts


def levels(facts: DataFrame, rules: dict[int, list[Callable[..., DataFrame]]], most_rounds: int = 1000) -> DataFrame:
    """Scopes with levels: a rule of level n fires when all lower levels are saturated, and reads them as ``frozen``."""
    return layers(facts, [rules[n] for n in sorted(rules)], most_rounds)
