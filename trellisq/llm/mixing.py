"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only: no Python on the executors.

Training time runs from 0 to 1. Each source has a weight schedule, piecewise linear over the knots; its integral gives
the source's cumulative token demand D(t), scaled so that D(1) is the source's target. A document that supplies the
tokens from c to c + size of its source is due when the demand reaches c: its position is the inverse of D at c.
Rows are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of all sources together that the mix takes, as a share of the corpus, and how often a source may be repeated.
SHARE, MOST_EPOCHS = 1.5, 2
#: Knots of training time, and the rate of a source there relative to its mean, by the same repeated order: the heavy
#: sources fade, the middle ones peak halfway, the light ones grow.
KNOTS = (0.0, 0.5, 1.0)
RATES = ((1.5, 1.0, 0.5), (0.5, 1.5, 0.5), (0.5, 1.0, 1.5))
#: Documents of one source are ordered in chunks of about so many rows; a chunk is what one window group holds.
CHUNK_ROWS = 4096


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """One row for each source: source, source_size, n_docs, rank, weight, target.

    Targets: level * weight, at most ``most`` times the source's size, with the one level at which they add up to
    ``share`` times all sizes. That is where resharing the excess by weight, again and again, ends. In order of
    size / weight the sources that stay at their limit come first, so running sums find the level without a loop.
    The windows here run over one row a source, a table as small as the mix's own configuration.
    """
    if share > most:
        raise ValueError("the share can't exceed what the sources give at most")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * F.lit(float(most))
    s = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("limit", limit)
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the level if this source and all later ones are below their limits; it holds where it doesn't exceed this one's ratio
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("holds", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    return (
        s.withColumn("level", F.min(F.when(F.col("holds"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))))
        .select("source", "source_size", "n_docs", "rank", "weight", "target")
    )


def due(rate: Column, demand: Column, target: Column, knots=KNOTS) -> Column:
    """The training time at which a source's cumulative demand reaches ``demand``; demand beyond the target gives 1.

    rate: array with the source's relative rate at each knot. Between knots the rate is linear, so the cumulative
    demand is a parabola there and its inverse the root of a quadratic.
    """
    area = [(F.element_at(rate, i + 1) + F.element_at(rate, i + 2)) / 2 * (knots[i + 1] - knots[i]) for i in range(len(knots) - 1)]
    whole = sum(area[1:], area[0])
    want = F.when(target > 0, demand / target * whole).otherwise(F.lit(0.0))
    start, out = F.lit(0.0), F.lit(1.0)
    pieces = []
    for i, a in enumerate(area):
        width, r0, r1 = knots[i + 1] - knots[i], F.element_at(rate, i + 1), F.element_at(rate, i + 2)
        rest = F.greatest(want - start, F.lit(0.0))
        slope = (r1 - r0) / width
        # r0 x + slope x^2 / 2 = rest, in the form that also holds for slope 0
        root = 2 * rest / (r0 + F.sqrt(F.greatest(r0 * r0 + 2 * slope * rest, F.lit(0.0))))
        pieces.append((start + a, knots[i] + F.least(root, F.lit(width))))
        start = start + a
    for end, x in reversed(pieces):
        out = F.when(want <= end, x).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


OUT = ("size", "source_size", "target", "taken", "takes")


def _without(columns: list[str], names: tuple[str, ...]) -> list[str]:
    return [c for c in columns if c.lower() not in names]


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row: rows that have it in common are equal, hence interchangeable."""
    return F.xxhash64(F.lit(23), *[F.col(f"`{c}`") for c in docs.columns])


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, knots=KNOTS, rates=RATES, seed: int = 17, keep: list[str] | None = None, key: str | None = None) -> DataFrame:
    """One row for each document: its columns (``keep``; all by default) and size, source_size, target, taken, and takes.

    takes: array of struct(epoch, words, position), one entry for each time that the document is taken; the document at
    which a source's target ends is taken for its first ``words`` words only, so taken words equal the target, rounded
    down. taken is the sum. A source's documents come in an order that hashes of id and text fix; rows equal in both
    are interchangeable, so reruns agree. A cumulative size over a hot source is a sum over chunks of CHUNK_ROWS rows
    and, over the chunks' totals, a second one: no task gets a source's rows together. Texts are read once; what is
    kept is written to the checkpoint folder, so keep no texts of a large table. key: name of a column for the row's hash.

    Null text: size 0. Null source: a source of its own, the last. Sizes of 0 everywhere: targets 0, nothing taken.
    Input columns of the names above are replaced, whatever their case; all others stay.
    """
    kept = _without(docs.columns if keep is None else keep, OUT)
    lean = docs.select(
        *[F.col(f"`{c}`") for c in kept], F.struct(words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), row_key(docs).alias("key"), "doc_id", "source").alias("__d")
    )
    lean = cut_lineage(lean)
    sized = lean.select(F.col("__d.source").alias("source"), F.col("__d.size").alias("size"))
    plan = cut_lineage(source_plan(sized, weights, share, most).select(F.struct("*").alias("__s")))
    base = lean.join(plan, F.col("__d.source").eqNullSafe(F.col("__s.source")))
    base = base.withColumn("__chunk", F.pmod("__d.h", F.ceil(F.col("__s.n_docs") / CHUNK_ROWS))).withColumn("__rank", F.col("__s.rank"))
    before = Window.partitionBy("__rank").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy("__rank", "__chunk")
        .agg(F.sum("__d.size").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy("__rank", "__chunk").orderBy("__d.h", "__d.doc_id", "__d.size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        base.join(offsets, ["__rank", "__chunk"])
        .withColumn("__start", F.col("__before") + F.coalesce(F.sum("__d.size").over(inside), F.lit(0)))
    )
    rate = F.element_at(F.array(*[F.array(*map(F.lit, map(float, r))) for r in rates]), (F.col("__rank") % len(rates) + 1).cast("int"))
    target = F.col("__s.target")
    goal = F.floor(target).cast("long")

    def take(epoch: int) -> Column:
        first = F.col("__start") + F.col("__s.source_size") * epoch
        n = F.least(F.greatest(goal - first, F.lit(0)), F.col("__d.size"))
        return F.struct(F.lit(epoch + 1).alias("epoch"), n.alias("words"), due(rate, first.cast("double"), target, knots).alias("position"))

    takes = F.filter(F.array(*[take(e) for e in range(most)]), lambda t: t["words"] > 0)
    out = placed.withColumn("__takes", takes)
    return out.select(
        *[F.col(f"`{c}`") for c in kept], F.col("__d.size").alias("size"), F.col("__s.source_size").alias("source_size"), target.alias("target"),
        F.aggregate("__takes", F.lit(0).cast("long"), lambda a, t: a + t["words"]).alias("taken"), F.col("__takes").alias("takes"), *([F.col("__d.key").alias(key)] if key else []),
    )


def taken_rows(docs: DataFrame, mixed: DataFrame, key: str) -> DataFrame:
    """The rows of docs that the mix takes, with takes and size; a row for each distinct row of docs, with the takes of all that equal it.

    mixed: mix(docs, keep=[], key=key), which holds no texts; here they are dealt once, by the rows' hashes.
    """
    of = mixed.where("taken > 0").groupBy(key).agg(F.flatten(F.collect_list("takes")).alias("takes"), F.first("size").alias("size"))
    rows = docs.select(*[F.col(f"`{c}`") for c in _without(docs.columns, OUT)], row_key(docs).alias(key)).dropDuplicates([key])
    return rows.join(of, key).drop(key)


def schedule(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The training order: a row for each take, range-sorted by position over the cluster, with columns epoch and position.

    A document that is taken in part has its text cut after the words taken, white space between them unchanged. Input
    columns epoch and position are replaced.
    """
    names = _without(columns, ("epoch", "position"))
    t = mixed.select(*[F.col(f"`{c}`") for c in {*names, "doc_id", "text", "size"} if c in mixed.columns], F.explode("takes").alias("__t"))
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.when(F.col("__t.words") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("__t.words").cast("int")), "")).otherwise(F.col("text"))
    t = t.withColumn("text", cut).orderBy("__t.position", "__t.epoch", "doc_id")
    return t.select(*[F.col(f"`{c}`") for c in names], F.col("__t.epoch").alias("epoch"), F.col("__t.position").alias("position"))
