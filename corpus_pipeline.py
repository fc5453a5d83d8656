"""The corpus pipeline: five operators in turn, each stage written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``; the last returns
the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from chatlens.llm import decontaminate, jaccard, langid, packing, quality
from chatlens.llm.base import checkpoint, share_library, small_batches, table, without_ids


def frugal(stage: Callable) -> Callable:
    """The stage with small Arrow batches for all that it runs while it is called: executors keep what the stages before it took."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        share_library(spark)  # first of all: workers with other settings are other processes
        with small_batches(spark):
            return stage(spark, docs, sf_dir)
    return run_stage


@frugal
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told."""
    return langid.keep_identified(docs)


@frugal
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects; rows of one doc_id go together."""
    scores = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    return without_ids(docs, scores.where("predicted = 0").select("doc_id"), "doc_id")


@frugal
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard.keep_one_of_each(docs)


@frugal
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window. Written here, as whole rows pass the workers and batches are small only while the stage is called."""
    return checkpoint(decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")), "pipeline-clean")


@frugal
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("quality", good_quality), ("ngram_jaccard", one_of_each),
          ("decontamination", decontaminated), ("packing", packed)]
ORACLE_SQL = None  # learned and iterative stages; tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
