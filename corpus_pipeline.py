"""A training-corpus pipeline of five stages over ``documents``; each stage works on what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup as exact
from gleaner.llm.common import delete_folder, scratch_root
from gleaner.llm.minhash_dedup import near_dedup
from gleaner.llm.packing import pack_documents
from gleaner.llm.substring_dedup import substring_dedup
from gleaner.llm.toxicity import drop_toxic, fit_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the lexicon is learned from labels of rows that aren't held out."""
    return drop_toxic(docs, fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact.exact_dedup(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest id stays."""
    return near_dedup(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but their first place; documents of which nothing is left go."""
    cleaned = substring_dedup(docs)
    cleaned = cleaned.where("n_removed = 0 or length(trim(text)) > 0")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of the remaining documents in sequences of permitted lengths; one row per piece."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring),
    ("best_fit_packing", packing),
]

#: SQL can't express the learned score, the hashed tables and the packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again, all but the last are
    deleted when the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_root(spark).rstrip('/')}/gleaner/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete_folder(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
