import os

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import ODD, PROSE, frame
from trellisq.llm import minhash_dedup, mixing, secrets_scan, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.collect())


def test_every_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        if k == 0:
            bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
            assert ids(out) == sorted(str(r["doc_id"]) for r in before if r["doc_id"] not in bad)
        elif k == 1:
            assert ids(out) == ids(minhash_dedup.dedup(docs).where("kept"))
        elif k == 2:
            assert ids(out) == ids(docs) and all(not secrets_scan.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in out.collect())
        elif k == 3:
            want = sum(x["taken"] for x in mixing.mix(docs).collect())
            assert sum(len(r["text"].split()) for r in out.collect()) == want
        else:
            assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out.collect()) and out.count() == len(before)
        docs = out


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = frame(spark, [*ODD, (40, PROSE + " token = \"0123456789abcdef0123456789abcdef\"", "a")])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
