"""Training-data pipeline over ``documents``: quality, near-duplicates, secrets, mixing, tokens; operators of ``marketflow.llm``.

Each stage works on all rows its predecessor kept, takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``. Stages are written to the shared folder and reread, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketflow.llm import bpe, minhash, mixing, quality, secret_scan
from marketflow.llm.common import land, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go; null, empty and blank texts are rejected."""
    return quality.classify(docs).filter("keep").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, 0.8): the one with the smallest doc_id."""
    return minhash.deduplicate(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of source, language and topic."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of token ids and of the decoded text of every sampled document."""
    return bpe.digests(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_copies), ("secrets", hide_secrets), ("mixing", sample_mix), ("encoding", encode)]
# Raking, expectation-maximisation and byte-pair encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
