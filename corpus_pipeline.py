"""A training-data pipeline over documents: quality, lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from quarry.llm._work import saved, small_batches, table

#: Documents that score less are rejected.
QUALITY = 0.3


def _without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Documents but those whose id is removed; rows without id stay."""
    return docs.join(removed.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("score") >= QUALITY).select(docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are like an earlier one; n_chars counts what is left."""
    small_batches(spark)
    cut = line_dedup.without_lines(docs, line_dedup.removals(docs).where("NOT kept"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8 or more).

    Rows with the same id and text are one document, of which one stays; rows without id stay.
    """
    small_batches(spark)
    kept = _without(docs, near_dedup.components_of(docs, width=5, percent=80).where("NOT kept"))
    repeated = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    small_batches(spark)
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to: doc_id, n_tokens, ids, text."""
    small_batches(spark)
    vocabulary = byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded="decoded")
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality", good_quality), ("line_dedup", distinct_lines), ("near_dedup", no_near_copies), ("decontaminate", no_benchmark), ("byte_bpe", tokens)]

#: SQL can't express the classifier; the stages are tested against plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again: doc_id, n_tokens, ids and text of what is kept.

    Null texts count as empty; rows without doc_id are judged by the classifier and the benchmark alone; repeated rows
    become one in the near-copy stage; an empty table gives no rows; columns beside those of documents stay until the last.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs) if k + 1 < len(STAGES) else docs
    return docs
