"""A corpus pipeline of five stages, each written as Parquet and read again: language, near-duplicates, secrets, mixing, BPE.

Every stage works on all documents that the one before kept. Language identification lets documents go that have no
letters or that none of the learned languages explains; of near-duplicates (five-word shingles, likeness 0.8 or more)
the smallest doc_id stays; secrets are replaced by a mark, and their documents stay; mixing takes each document as often
as its source's target says (0, 1 or 2 times); the last stage gives token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, langid, minhash, mixing, secrets
from tickloom.llm.common import cut, documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.kept(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids; a document that the mix takes twice has two rows."""
    return bpe.encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mixing", mix), ("bpe", encode)]

#: Language identification and BPE cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
