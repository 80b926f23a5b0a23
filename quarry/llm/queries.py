"""Queries of the training-data operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import alignment, ann, byte_bpe, decontaminate, dialogues, licenses, line_dedup, near_dedup, ngrams, outliers, paragraphs, quality, toxicity
from quarry.llm._work import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components_of(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op2_nn_descent(table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.op4_paragraph_dedup(table(spark, sf_dir, "documents"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.op5_katz(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op6_licenses(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op9_line_dedup(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op10_byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.op11_outliers(table(spark, sf_dir, "documents"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.op12_dialogue_repair(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op13_token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_nn_descent, op3_decontaminate, op4_paragraph_dedup, op5_katz, op6_licenses, op7_toxicity, op8_quality, op9_line_dedup, op10_byte_bpe, op11_outliers, op12_dialogue_repair, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": near_dedup.ORACLE, "op3_decontaminate": decontaminate.ORACLE}
