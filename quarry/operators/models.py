"""Slots for models: an encoder, a reranker and an extractor are functions on batches, given by the caller.

Each runs in Arrow batches of a map.  The offline ones here need no model: they hash words, so they are deterministic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], np.ndarray]
Reranker = Callable[[str, Sequence[str]], Sequence[float]]
Extractor = Callable[[Sequence[str]], Sequence[str]]


def hashed_vectors(texts: Sequence[str], size: int = 64) -> np.ndarray:
    """Unit vectors of word counts, words put into places by their hashes; zero for texts without words."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in enumerate(texts):
        for word in text.lower().split():
            digest = hashlib.md5(word.encode()).digest()
            out[row, int.from_bytes(digest[:4], "little") % size] += 1 if digest[4] & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def shared_words(query: str, texts: Sequence[str]) -> list[float]:
    """The share of a query's words that each text has."""
    asked = set(query.lower().split())
    return [len(asked & set(t.lower().split())) / max(1, len(asked)) for t in texts]


def encoded(chunks: DataFrame, encoder: Encoder = hashed_vectors) -> DataFrame:
    """Vectors of texts (chunk_id, text): chunk_id, vector; null texts count as empty."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "vector": list(encoder(list(batch["text"].fillna(""))))})

    return chunks.select("chunk_id", F.col("text").cast("string").alias("text")).mapInPandas(encode, f"chunk_id {kind}, vector array<float>")


def reranked(pool: DataFrame, query: str, reranker: Reranker = shared_words) -> DataFrame:
    """Adds a reranker's logit to a pool of hits with text."""

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        return pd.Series(list(reranker(query, list(texts.fillna("")))), dtype=float)

    return pool.withColumn("logit", logit(F.col("text")))


def extracted(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """Adds an extractor's answer (response: a JSON object as text) to chunks with text."""

    @F.pandas_udf("string")
    def answer(texts: pd.Series) -> pd.Series:
        return pd.Series(list(extractor(list(texts.fillna("")))), dtype=object)

    return chunks.withColumn("response", answer(F.col("text")))
