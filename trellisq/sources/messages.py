"""Message logs: lines of triples with delimiter lines between messages, as a table of envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed forms of the lines between messages and of version lines, with a comment behind them or without.
DELIMITER = r"^\s*@?(?i:MESSAGE)\s*\.?\s*(#.*)?$"
VERSION = r"""^\s*@?(?i:VERSION)\s+("[^"]*"|'[^']*')\s*\.?\s*(#.*)?$"""
#: Line numbers that one task counts delimiters over.
BLOCK = 100_000


def envelopes(log: DataFrame, stream: str = "stream", at: str = "line_no", line: str = "value") -> DataFrame:
    """(stream, offset, payload_kind, payload, next_offset) from lines of one or more streams; ``at`` is a whole number.

    offset counts from 1. Delimiters stand between messages, so a stream with d of them has d + 1; a message without
    content is a heartbeat: payload_kind empty, payload null. Version lines, comments and blank lines are no content.
    Delimiters are counted in blocks of line numbers and then over a stream's blocks, so a long stream is many groups.
    """
    lines = log.where(~F.col(line).rlike(VERSION)).withColumn("__mark", F.col(line).rlike(DELIMITER).cast("int")).withColumn("__block", F.floor(F.col(at) / BLOCK))
    blocks = lines.groupBy(stream, "__block").agg(F.sum("__mark").alias("__n"))
    over = Window.partitionBy(stream)
    before = over.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col(stream).alias("__s"), F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), (F.sum("__n").over(over) + 1).alias("__last"))
    inside = Window.partitionBy(stream, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.join(blocks, F.col(stream).eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    numbered = numbered.withColumn("offset", F.col("__before") + F.sum("__mark").over(inside) + 1)
    content = F.when((F.col("__mark") == 0) & ~F.col(line).rlike(r"^\s*(#.*)?$"), F.struct(F.col(at).alias("at"), F.col(line).alias("line")))
    m = numbered.groupBy(stream, "offset", "__last").agg(F.transform(F.array_sort(F.collect_list(content)), lambda x: x["line"]).alias("payload"))
    empty = F.size("payload") == 0
    return m.select(
        stream, "offset", F.when(empty, "empty").otherwise("nonEmpty").alias("payload_kind"), F.when(~empty, F.col("payload")).alias("payload"),
        F.when(F.col("offset") < F.col("__last"), F.col("offset") + 1).alias("next_offset"),
    )


def windows(messages: DataFrame, by: list[str], order: list[str], value: str, width: int, out: str) -> DataFrame:
    """messages with the values of the last ``width`` messages, the current one included, oldest first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - width, 0)
    return messages.withColumn(out, F.collect_list(value).over(w))
