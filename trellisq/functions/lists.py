"""list: functions on arrays, and generators that give several rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, number


def append(*xs) -> Column:  # noqa: ANN002
    return F.concat(*map(col, xs))


def first(xs) -> Column:  # noqa: ANN001
    return F.try_element_at(col(xs), F.lit(1))


def last(xs) -> Column:  # noqa: ANN001
    return F.try_element_at(col(xs), F.lit(-1))


def rest(xs) -> Column:  # noqa: ANN001
    """All but the first element; null for an empty list."""
    return F.when(F.size(col(xs)) > 0, F.slice(col(xs), F.lit(2), F.greatest(F.size(col(xs)) - 1, F.lit(0))))


def member_at(xs, i) -> Column:  # noqa: ANN001
    """The element at a place from 0 on; null beyond the ends."""
    return F.get(col(xs), col(i).cast("int"))


def remove(xs, x) -> Column:  # noqa: ANN001
    return F.filter(col(xs), lambda e: ~e.eqNullSafe(col(x)))


def not_member(xs, x) -> Column:  # noqa: ANN001
    return F.coalesce(~F.array_contains(col(xs), col(x)), F.lit(False)) & col(x).isNotNull() | (F.size(col(xs)) == 0)


def sort(xs) -> Column:  # noqa: ANN001
    """By number where both elements are numbers, else by text."""

    def compare(a: Column, b: Column) -> Column:
        x, y = number(a), number(b)
        by_number = F.when(x < y, -1).when(x > y, 1).otherwise(0)
        return F.when(x.isNotNull() & y.isNotNull(), by_number).when(a < b, -1).when(a > b, 1).otherwise(0)

    return F.array_sort(col(xs), compare)


def mapped(xs, f: Callable[[Column], Column]) -> Column:  # noqa: ANN001
    """Each element's solution, in order; elements without one give nothing."""
    return F.filter(F.transform(col(xs), f), lambda e: e.isNotNull())


def first_rest(xs) -> Column:  # noqa: ANN001
    return F.when(F.size(col(xs)) > 0, F.struct(first(xs).alias("first"), rest(xs).alias("rest")))


def iterate(df: DataFrame, xs: str, index: str, value: str) -> DataFrame:
    """A row for each element, with its place from 0 on."""
    return df.select("*", F.posexplode(xs).alias(index, value))


def member(df: DataFrame, xs: str, value: str) -> DataFrame:
    """A row for each element; repeated elements give repeated rows."""
    return df.select("*", F.explode(xs).alias(value))


def splits(df: DataFrame, xs: str, left: str, right: str) -> DataFrame:
    """A row for each way in which two lists append to the given one."""
    cut = F.explode(F.sequence(F.lit(0), F.size(xs))).alias("__cut")
    return df.select("*", cut).withColumn(left, F.slice(xs, F.lit(1), F.col("__cut"))).withColumn(
        right, F.slice(xs, F.col("__cut") + 1, F.size(xs) - F.col("__cut"))
    ).drop("__cut")


def map_relation(df: DataFrame, key: str, xs: str, relation: DataFrame, out: str) -> DataFrame:
    """list:map over a relation (s, o): for each list, all o of its elements in order, as column ``out``; key names the row.

    Within one element the values come sorted. Lists whose elements have none give an empty list.
    """
    each = df.select(key, F.posexplode(xs).alias("__i", "__e")).join(relation.select(F.col("s").alias("__e"), F.col("o").alias("__o")), "__e")
    got = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__o"))), lambda p: p["__o"]).alias(out))
    return df.join(got, key, "left").withColumn(out, F.coalesce(out, F.array().cast(got.schema[out].dataType)))


def materialised(cells: DataFrame) -> DataFrame:
    """(head, items): lists held as first/rest cells, from cells (node, first, rest) with rest null at the end.

    Pointer doubling: each round joins every prefix with the prefix that its tail begins, so a list of n cells takes
    log2 n joins. Cells in a cycle, and cells with two firsts or rests, belong to no list.
    """
    from ..plans.fixpoint import cut

    one = cells.groupBy("node").agg(F.min("first").alias("first"), F.min("rest").alias("rest"), F.count(F.lit(1)).alias("n")).where("n = 1")
    now = cut(one.select("node", F.array("first").alias("items"), F.col("rest").alias("next")))
    bound = max(1, one.count())
    width = 1
    while width < 2 * bound and not now.where("next IS NOT NULL").isEmpty():
        tails = now.select(F.col("node").alias("t"), F.col("items").alias("more"), F.col("next").alias("after"))
        longer = now.where("next IS NOT NULL").join(tails, F.col("next") == F.col("t")).select("node", F.concat("items", "more").alias("items"), F.col("after").alias("next"))
        now = cut(now.where("next IS NULL").unionByName(longer.where(F.size("items") <= bound)))
        width *= 2
    heads = cells.select(F.col("rest").alias("node")).where("node IS NOT NULL").distinct()
    return now.where("next IS NULL").join(heads, "node", "left_anti").select(F.col("node").alias("head"), "items")


BUILTINS = {
    "list:append": append, "list:first": first, "list:rest": rest, "rdf:first": first, "rdf:rest": rest, "list:last": last,
    "list:memberAt": member_at, "list:remove": remove, "list:length": lambda xs: F.when(col(xs).isNotNull(), F.size(col(xs))),
    "list:notMember": not_member, "list:in": lambda x, xs: F.coalesce(F.array_contains(col(xs), col(x)), F.lit(False)),
    "list:reverse": lambda xs: F.reverse(col(xs)), "list:sort": sort, "list:map": mapped, "list:firstRest": first_rest,
}
#: These give several rows: iterate(df, xs, index, value), member(df, xs, value).
GENERATORS = {"list:iterate": iterate, "list:member": member, "list:append": splits}
