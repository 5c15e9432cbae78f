"""From documents to packed sequences: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage works on all that the one before kept. Stages are written below the shared folder and read again; a stage is
deleted when the next one is written.

Defined cases: a null text is empty and is rejected by the quality rules, as every text of under 50 words is; a null doc_id is an
id of its own; rows of one doc_id with different texts are different documents, and equal rows are copies, of which one stays; an
empty table gives no rows; columns beyond those of documents pass through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontaminate, nearcopies, packing, quality, secrets
from tessel.llm.common import drop, new_path, scratch, stage
from tessel.llm.queries import table, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies stays (five-word shingles, similarity 0.8 or more); see keep_one for null and repeated ids."""
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select(F.col("doc_id"), F.col("source"), F.col("text")), *tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: SQL has neither the fingerprints, nor the template hashes, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        with scratch(spark) as keep:  # what the operator staged goes when the stage is written
            path = new_path(spark, name)
            keep.append(path)
            docs = stage(step(spark, docs, sf_dir), name, path)
        drop(spark, last)
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
