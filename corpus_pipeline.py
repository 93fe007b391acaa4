"""The corpus pipeline: each stage one operator over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bpe, langid, minhash, mixing, pii
from runlens.llm.common import held_out, table
from runlens.llm.queries import VOCAB
from runlens.session import scratch_path

#: Least share of a text's trigrams that its language must explain.
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in none of the learned languages."""
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"))
    found = langid.predict(rows, langid.learn(docs.where(~held_out())), ["_row"], row="_row")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of five-word-shingle similarity 0.8 or more."""
    return minhash.deduplicated(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and generalises the words that disclose it."""
    return pii.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's blocks up to its target; a document is its taken words."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, source, n_tokens, ids."""
    return bpe.encode(docs, VOCAB, ["doc_id", "source"])


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: Learned filters, similarity groups and token merges have no SQL; tests/llm/test_pipeline.py
#: holds every stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
