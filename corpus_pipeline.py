"""A training corpus from raw documents: toxic documents go, one of each group of near copies stays, secrets are masked,
the sources are mixed to their weights in training order, and the texts become token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
docs. All but the last return the columns of ``documents``, with n_chars brought up to date where a text changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.llm import minhash_dedup, mixing, secrets_scan, sentencepiece_codec, toxicity
from trellisq.llm.common import checkpoint_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: trained models, candidate search and a tokenizer. Tests hold the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of a bounded sample of docs, doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where("predicted = 0").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that links of similarity 0.75 or more connect."""
    return minhash_dedup.distinct(docs.select(COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    masked = secrets_scan.redact(docs.select(COLUMNS), secrets_scan.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order."""
    docs = docs.select(COLUMNS)
    order = mixing.schedule(mixing.taken_rows(docs, mixing.mix(docs, keep=[], key="row"), "row"), COLUMNS)
    return order.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, n_fallback, round_trip and parity of each row, in the order of docs."""
    return sentencepiece_codec.encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what lies between them is Parquet in the shared checkpoint folder."""
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
