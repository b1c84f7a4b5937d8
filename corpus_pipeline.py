"""The corpus pipeline: stages that each take what their predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages rows are written as Parquet, to the shared
checkpoint folder, and read again, so an executor that is lost costs one stage's tasks at most. All stages but the last
return the columns of documents. Stages read their models and labels from the tables in ``sf_dir``; what they learn
from documents they learn from their own input.

Null texts count as empty. Extra columns are passed through. Empty tables pass: without labels nothing is rejected, without
a benchmark nothing is contaminated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import bpe, decontaminate, near_dup, suffix_dedup, zstd_quality
from strataframe.llm.common import checkpoint_dir, table
from strataframe.llm.queries import bpe_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts as good."""
    return zstd_quality.keep_good(docs, zstd_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id."""
    return near_dup.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that stand in a document with a smaller id; n_chars follows the text."""
    return suffix_dedup.cut_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text that they decode to."""
    return bpe.digests(docs, bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: Classes, near-duplicates and token ids can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
