"""The corpus pipeline: quality, lines, near copies, benchmark passages, mixture.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame with the
columns of ``documents`` (the last adds ``n_tokens, domain, posterior, rate``); the caller
writes it as Parquet and hands it, read again, to the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, line_align, mixing, near_dup, repetition
from quernstone.llm.cluster import checkpoint_dir, delete_folder, documents


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids``; rows without an id stay."""
    named = ids.select("doc_id").filter("doc_id is not null").distinct()
    rest = docs.filter(F.col("doc_id").isNull())
    return docs.join(named, "doc_id", "left_semi").select(*docs.columns).unionByName(rest)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.  No shuffle: the rows pass through the measuring task."""
    return repetition.keep_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines they share with earlier ones; those left without a word go."""
    left = line_align.align_rows(docs)
    return left.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies."""
    return _only(docs, near_dup.near_duplicates(docs).filter("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.  No shuffle."""
    return decontaminate.keep_rows(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their rates in the mix whose expected domain totals match the targets."""
    return mixing.mix_rows(docs, documents(spark, sf_dir, "labels"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Suffix arrays, alignment and classifiers are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's folder is deleted when the next one is written; the last, which
    holds the result, stays.  Rows with a null id pass the stages that look for
    earlier or smaller ids, and a null or empty text ends at the quality rules.
    """
    docs = documents(spark, sf_dir)
    top = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete_folder(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
