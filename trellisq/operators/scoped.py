"""Scoped negation and aggregation: they read a frozen relation, so a join or an aggregation says all there is to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def includes(outer: DataFrame, scope: DataFrame, on: list[str]) -> DataFrame:
    """Rows of outer for which the scope has a row with the same values; each once (EXISTS)."""
    return outer.join(scope.select(*on), on, "left_semi")


def not_includes(outer: DataFrame, scope: DataFrame, on: list[str] | Column) -> DataFrame:
    """Rows of outer for which the scope has none (NOT EXISTS)."""
    return outer.join(scope.select(*on) if isinstance(on, list) else scope, on, "left_anti")


def collect_all_in(outer: DataFrame, scope: DataFrame, on: list[str], template: Column, out: str, order: bool = True) -> DataFrame:
    """outer with the list of all templates of the scope's rows with the same values: a bag; empty where there are none.

    order: sort the list, since derivations have no order of their own. A list holds one outer row's solutions; where
    only their number, sum or extremes are wanted, ``aggregate_in`` keeps no list.
    """
    values = F.collect_list(template)
    got = scope.groupBy(*on).agg((F.array_sort(values) if order else values).alias(out))
    return outer.join(got, on, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(got.schema[out].dataType)))


def aggregate_in(outer: DataFrame, scope: DataFrame, on: list[str], defaults: dict[str, object] | None = None, **aggregates: Column) -> DataFrame:
    """outer with aggregates over the scope's rows with the same values, as partial and final sums, without lists.

    defaults: what an aggregate is over no rows, such as 0 for a sum of the empty list; null otherwise.
    """
    got = outer.join(scope.groupBy(*on).agg(*[a.alias(k) for k, a in aggregates.items()]), on, "left")
    for k, v in (defaults or {}).items():
        got = got.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
    return got


def for_all_in(outer: DataFrame, where: DataFrame, then: DataFrame, on: list[str], shared: list[str]) -> DataFrame:
    """Rows of outer all of whose ``where`` rows have a ``then`` row with equal ``shared`` values; true where there are none."""
    return outer.join(where.join(then.select(*shared), shared, "left_anti").select(*on), on, "left_anti")
