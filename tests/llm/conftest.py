import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
PROSE = "the quick brown fox jumps over a lazy dog while seven small ships sail past the old stone harbour wall at dawn"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


#: Nulls in every column, empty and blank texts, a very long text, ties, repeated rows.
ODD = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "w " * 60_000, "b"), (5, PROSE, "b"), (5, PROSE, "b"), (6, PROSE, None), (7, "é😀 日本語\x0b tab", "c")]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)
