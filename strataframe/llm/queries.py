"""The registered training-data queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, gru_lm, langid, licences, near_dup, ngram_rules, oracles, substring_index, suffix_dedup, zstd_quality
from .common import table

#: Rank file of the byte-level vocabulary.
BPE_RANKS = "byte_bpe_50k.tiktoken"


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_RANKS)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op2_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rules.judge(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe_path())


def op9_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_gru_lm": op2_gru_lm,
    "op3_ngram_rules": op3_ngram_rules,
    "op4_language_id": op4_language_id,
    "op5_near_dup": op5_near_dup,
    "op6_decontaminate": op6_decontaminate,
    "op7_licences": op7_licences,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_zstd_quality": op9_zstd_quality,
    "op10_substring_index": op10_substring_index,
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op6_decontaminate": oracles.DECONTAMINATE,
    "op10_substring_index": oracles.SUBSTRING_INDEX,
}
