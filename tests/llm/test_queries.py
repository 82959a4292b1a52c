"""The registered queries on the smallest tables: columns, one row for each document, and their SQL where there is some."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trellisq.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_sentencepiece": ["doc_id", "ids_sha256", "n_tokens", "round_trip", "parity"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op6_sharding": ["doc_id", "slot", "shard"],
    "op7_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats_passage"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= set(df.columns)
    got = df.collect()
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in got) == ids
    if name in queries.ORACLE:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = con.sql(queries.ORACLE[name])
        assert sorted(want.columns) == sorted(df.columns)
        at = [df.columns.index(c) for c in want.columns]
        assert sorted(repr(tuple(r[i] for i in at)) for r in got) == sorted(map(repr, want.fetchall()))


def test_toxic_documents_are_told(spark):
    """Held-out rows: labels that the model has not seen."""
    got = queries.op3_toxicity(spark, SF.replace("0.001", "0.01")).where("held_out").join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"), "doc_id")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
    assert r["found"] >= 0.7 and r["wrong"] <= 0.03
