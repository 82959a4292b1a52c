"""Structured Streaming: message-wise rule runs, windows with watermarks, and sinks that take each batch once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.fixpoint import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the one that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream; a single file is taken by its name in its folder."""
    at, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(at) if name.endswith(".parquet") and _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run_each(source: DataFrame, rules: Callable[[DataFrame], DataFrame], out: str, state: str) -> None:
    """Runs rules over each batch of messages on its own, without state between batches, until all input is taken.

    A batch is written under its number, so that a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        rules(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(source: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Numbers of events in each window; events later than the watermark allows are dropped by the engine."""
    w = F.window(at, width)
    return source.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))


def settle(result: DataFrame, out: str, state: str) -> None:
    """Runs a stateful query over all input that there is and writes its final state: complete mode, once for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def text_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message logs as a stream of lines (stream, line_no, value): files of a folder, each a log with its name as stream.

    ``messages.envelopes`` of a batch, inside ``run_each``, gives its messages: a file comes whole with one batch.
    """
    logs = spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("stream"), F.split("value", r"\r?\n").alias("l"))
    return logs.select("stream", F.posexplode("l").alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))


def carried(source: DataFrame, by: str, value: str) -> DataFrame:
    """State that goes from message to message: (by, n, total) of all messages so far, a row for each key that a batch touches.

    The engine keeps a number and a sum for each key in its state store; keys are dealt over the cluster.
    """

    def run(key: tuple, batches, state):  # noqa: ANN001, ANN202
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    kind = source.schema[by].dataType.simpleString()
    return source.select(by, value).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def settle_updates(result: DataFrame, out: str, state: str) -> None:
    """Runs a query in update mode over all input that there is; each batch's rows are written under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
