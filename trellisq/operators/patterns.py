"""Triple patterns and bodies over a facts DataFrame (s, p, o), or over any table bound as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Var(str):
    """A variable of a pattern, by name; anything else in a pattern is a constant."""


def match(facts: DataFrame, s, p, o) -> DataFrame:  # noqa: ANN001
    """Bindings of one pattern: a column for each variable. A repeated variable requires equal places.

    Constants become filters that reach the scan; on a store partitioned by predicate a constant p prunes partitions. A
    list in a place takes an array apart: it agrees with arrays of its length, element by element.
    """
    out, seen = facts, {}
    places = []
    for column, x in (("s", s), ("p", p), ("o", o)):
        if isinstance(x, (list, tuple)):
            out = out.where(F.size(column) == len(x))
            places += [(F.get(column, F.lit(k)), e) for k, e in enumerate(x)]
        else:
            places.append((F.col(column), x))
    for place, x in places:
        if not isinstance(x, Var):
            out = out.where(place == F.lit(x))
        elif x in seen:
            out = out.where(place == seen[x])
        else:
            seen[x] = place
    return out.select(*[c.alias(str(v)) for v, c in seen.items()])


def body(*parts: DataFrame) -> DataFrame:
    """Natural join of binding tables on the variables they share; tables that share none are refused.

    Multiplicities are those of derivations; ``head`` makes a set of them.
    """

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError(f"no variable is shared by {a.columns} and {b.columns}")
        return a.join(b, shared)

    return reduce(joined, parts)


def head(bindings: DataFrame, *triples: tuple) -> DataFrame:
    """Facts of a rule's head: for each binding each triple of columns and constants; rows with a null place are dropped."""
    place = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, Var) else F.lit(x)
    rows = F.array(*[F.struct(place(s).cast("string").alias("s"), place(p).cast("string").alias("p"), place(o).cast("string").alias("o")) for s, p, o in triples])
    return bindings.select(F.inline(rows)).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def column_facts(df: DataFrame, subject: Column, columns: dict[str, str]) -> DataFrame:
    """Facts (s, p, o) of a table's columns: columns maps a column to its predicate; nulls give no fact."""
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for c, p in columns.items()])
    return df.select(subject.cast("string").alias("s"), F.inline(rows)).where("o IS NOT NULL")


def range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Rows of points with the ranges that hold their value, low <= value <= high.

    Ranges are dealt into cells of the given width, so that the join is on equal cells; a range gives a row for each
    cell that it touches. Choose a width near that of usual ranges.
    """
    p = points.withColumn("__cell", F.floor(F.col(value) / width))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__cell").where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("__cell")


#: Allen's relations between intervals a and b, by starts and ends.
ALLEN = {
    "before": "a_end < b_start", "meets": "a_end = b_start", "overlaps": "a_start < b_start AND a_end > b_start AND a_end < b_end",
    "starts": "a_start = b_start AND a_end < b_end", "during": "a_start > b_start AND a_end < b_end",
    "finishes": "a_end = b_end AND a_start > b_start", "equals": "a_start = b_start AND a_end = b_end",
    "finished_by": "a_end = b_end AND a_start < b_start", "contains": "a_start < b_start AND a_end > b_end", "started_by": "a_start = b_start AND a_end > b_end",
    "overlapped_by": "a_start > b_start AND a_start < b_end AND a_end > b_end", "met_by": "a_start = b_end", "after": "a_start > b_end",
}


def allen(pairs: DataFrame) -> Column:
    """The relation's name for rows with a_start, a_end, b_start, b_end of proper intervals."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(ALLEN.items()):
        out = F.when(F.expr(condition), name).otherwise(out)
    return out


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, value: str) -> DataFrame:
    """left with the value of right's latest row of the same ``by`` not after ``at``; null if there is none.

    One sort over both sides by key and time: no row is paired with all earlier ones. Of right's rows with equal time the
    greatest value counts.
    """
    from pyspark.sql import Window

    r = right.groupBy(by, right_at).agg(F.max(value).alias("__v")).select(F.col(by), F.col(right_at).alias("__t"), "__v", F.lit(0).alias("__side"))
    l = left.withColumn("__row", F.struct(*left.columns)).select(F.col(by), F.col(at).alias("__t"), "__row", F.lit(1).alias("__side"))
    w = Window.partitionBy(by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__row.*", value)
