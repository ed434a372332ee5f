"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bagminhash, bpe, k2treap, langid, lines, media, packing, resample, secrets, simhash, spotsigs, toxicity, words64
from millrace.llm.oracle import ORACLE
from millrace.sources.tables import load


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of every text, of its edited text, and their likeness to each other and the next."""
    return spotsigs.with_next(load(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line equals or is within one edit of."""
    found = lines.deduplicate(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), "text")


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads stored in content-defined chunks, each chunk once, read back and verified."""
    return media.read(media.write(load(spark, sf_dir, "documents")))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in Simple-8b words, written and read back."""
    return words64.read(words64.write(load(spark, sf_dir, "documents")))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return bagminhash.classes(load(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a weighted lexicon."""
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit decreasing packing into windows of 2048 tokens."""
    return packing.pack(load(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text."""
    return secrets.digest(secrets.scan(load(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by segmentation-marginalised unigrams."""
    docs = load(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op10_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtracking byte-pair encoding and offset-table decoding."""
    return bpe.round_trip(load(spark, sf_dir, "documents"))


def op11_k2treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item, from K2-treaps over all documents."""
    return k2treap.search(k2treap.build(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.components(load(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of the documents towards the benchmark's distribution."""
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OPERATORS = (op1_spotsigs, op2_line_dedup, op3_media_chunks, op4_simple8b, op5_bagminhash, op6_toxicity, op7_best_fit_packing, op8_secret_scan, op9_language_id, op10_backtracking_bpe, op11_k2treap, op12_simhash, op13_resample)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries and the pipeline by name."""
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the tests hold the others against brute force."""
    return ORACLE
