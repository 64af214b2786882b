"""A pipeline from raw documents to packed training sequences: run it by ``run``, or stage by stage.

Each stage takes (session, documents, dataset folder) and works on all that the stage before it kept; all but the last
return documents, all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import block_naming, near_texts, packing, secret_scan, toxicity
from orbweave.llm.common import stage, table
from orbweave.llm.queries import VOCABULARY


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity grammar rejects; learned from those labelled and not held out."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, keep the longest."""
    return block_naming.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (0.8 or more over shingles of five words), keep the one of the smallest id."""
    return near_texts.drop_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    return secret_scan.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: a row per piece, with its token ids."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL expresses neither learning nor packing; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
