"""What the text operators share: word pattern, Arrow row mapping, table loading.

Shared conventions, which each operator's docstring adds to:

* A null text counts as the empty text, unless an operator says otherwise.
* Rows may repeat and ids may be null; each input row gives one output row.
* ``add_columns`` keeps every input column; an input column that has the name of an output column is replaced.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..plans.fixpoint import shared_folder

#: A word: a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)

#: Bounds on one Arrow batch, so that a run of very long texts stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def tuned(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> None:
    """Has checkpoints written to the folder that driver and executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    # Shuffle files of finished steps go when the driver's garbage collector finds that nothing refers to them. An
    # iterative job has many such steps and little garbage, so it asks for a collection.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def n_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def add_columns(
    docs: DataFrame,
    text_col: str,
    added: StructType,
    make: Callable[[], Callable[[list[str]], list[list]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row of docs with the columns of ``added``, computed from whole texts in Arrow batches.

    make() runs once in each task and returns a function from a list of texts (no nulls) to one list for each added
    column. keep: the input columns that stay; all by default.
    """
    tuned(docs.sparkSession)
    new = {f.name.lower() for f in added.fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    schema = StructType([docs.schema[c] for c in kept] + list(added.fields))
    arrow = to_arrow_schema(added)
    # a text that stays travels once; else it comes last and goes again
    at = kept.index(text_col) if text_col in kept else len(kept)
    need = docs.select(*[F.col(f"`{c}`") for c in kept], *([F.col(f"`{text_col}`").alias("__text")] if at == len(kept) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in batches:
            out = compute(["" if t is None else t for t in b.column(at).to_pylist()])
            cols = b.columns[: len(kept)]
            cols += [pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *arrow.names])

    return need.mapInArrow(run, schema)


def fields(**kinds) -> StructType:
    return StructType([StructField(k, v, True) for k, v in kinds.items()])


def learnable(doc_id: Column) -> Column:
    """True for the rows whose labels may be learnt from: crc32 of the id's text, modulo 3, is not 1. Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[int, str, int]]:
    """(doc_id, whole text, label) of at most ``most`` learnable labelled documents, the same ones on every run.

    The ids with the smallest hashes are taken first (a distributed top-k over ids alone), then only their texts are
    fetched, one for each id: where ids repeat in docs, the text whose hash is least. ``most`` is the documented bound of
    what a classifier is fitted on; scoring covers every row.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("__label"))
        .orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id")
        .limit(most)
    )
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "__label")
        .agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
        .select("doc_id", "__text", "__label")
        .collect()
    )
    return sorted((r[0], r[1], int(r[2])) for r in rows)
