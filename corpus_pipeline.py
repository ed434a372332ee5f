"""The corpus pipeline: language ID, line dedup, near-dedup, secret scan, packing, each over all that the one before kept.

Rules: a document goes if it has no language that the model accepts or if it is not the one that stays of its
near-duplicate class; lines that repeat earlier ones and secrets go from the texts. Stages before the last return the
columns of documents. An empty table runs through and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bagminhash, langid, lines, packing, secrets
from millrace.sources.tables import load, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents themselves; those without an accepted language go."""
    return langid.accept(docs, langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly do, go."""
    return lines.deduplicate(docs).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return bagminhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("secret scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express segmentation sums, signatures or packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes its table, which the next reads."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
