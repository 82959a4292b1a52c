"""The rule language's built-ins as Column functions.

A built-in that has no solution gives null, never an error: a body keeps the rows in which every built-in's result is
not null (functions) or true (tests). ``BUILTINS`` maps names to functions; ``solve`` adds a result and drops the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from . import datatypes, digests, lists, logic, maths, strings, times

BUILTINS: dict[str, Callable[..., Column]] = {}
for _module in (maths, strings, lists, times, digests, datatypes, logic):
    BUILTINS |= _module.BUILTINS


def solve(df: DataFrame, out: str, builtin: str, *args: Column | str) -> DataFrame:
    """Rows of df for which the built-in has a solution, with the solution as column ``out``."""
    return df.withColumn(out, BUILTINS[builtin](*args)).where(f"`{out}` IS NOT NULL")


def test(df: DataFrame, builtin: str, *args: Column | str) -> DataFrame:
    """Rows of df that pass the test."""
    return df.where(BUILTINS[builtin](*args))
