"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are numpy sums over a batch's bytes, words and lines.  Trees are fitted on a bounded sample of
labelled rows (the rows of smallest hash, so any order of input gives the same sample) and flattened into
arrays of equal depth, which tasks walk level by level for all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text

#: Most labelled rows that trees are fitted on; all other work covers every row.
SAMPLE_ROWS = 20_000

# fixed values: classes of bytes that are counted
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",;:", b"!?", b"\"'", b"|", b"()[]{}<>", b"#$%&*@^~_=+/\\`-"]
_CLASS = np.full(256, len(CLASSES), dtype=np.int64)
for _k, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _k


def statistics(texts: _text.Texts) -> np.ndarray:
    """One row of statistics for each text of a slice (texts as they stand, not lower-cased)."""
    n, size = len(texts), np.diff(texts.bounds)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * (len(CLASSES) + 1) + _CLASS[texts.data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
    starts, stops, first = texts.spans(_text.NOT_SPACE)
    hashes, length = texts.hashes(starts, stops), stops - starts
    words = np.diff(first)
    line_starts, line_stops, line_first = texts.lines()
    line_hashes = texts.hashes(line_starts, line_stops)
    lines = np.diff(line_first)
    some = np.maximum(words, 1)

    def mean(values: np.ndarray, bounds: np.ndarray, over: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / over

    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(same)]] = False
    upper = (texts.data[starts] >= 65) & (texts.data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    distinct, top, pairs, repeated = (np.zeros(n) for _ in range(4))
    for i in range(n):
        own = hashes[first[i] : first[i + 1]]
        if len(own):
            _, often = np.unique(own, return_counts=True)
            distinct[i], top[i] = len(often) / len(own), often.max() / len(own)
            pairs[i] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) / max(1, len(own) - 1)
        own = line_hashes[line_first[i] : line_first[i + 1]]
        repeated[i] = 1 - len(np.unique(own)) / len(own)
    long = mean(length, first, some)
    spread = np.sqrt(np.maximum(0, mean(length.astype(np.float64) ** 2, first, some) - long**2))
    columns = [np.log1p(size), np.log1p(words), np.log1p(lines), size / np.maximum(lines, 1), long, spread, mean(length <= 2, first, some), mean(length > 14, first, some), mean(same, first, some), mean(upper, first, some), distinct, top, pairs, repeated]
    return np.column_stack([*columns, counts / np.maximum(size, 1)[:, None]]).astype(np.float32)


@dataclass
class Trees:
    """Complete trees as arrays: node k's children are 2k+1 and 2k+2; leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosts trees on the logistic loss; each split is sought over histograms of binned statistics."""
    rate_of_ones = (float(y.sum()) + 1) / (len(y) + 2)
    model = Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.float32), np.zeros((0, 2**depth)), float(np.log(rate_of_ones / (1 - rate_of_ones))))
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    score, parts = np.full(len(y), model.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            nodes, base = 2**level, 2**level - 1
            best = np.full(nodes, 1e-6)
            local = at - base
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * (bins + 1) + binned[:, f]
                g = np.cumsum(np.bincount(cell, slope, nodes * (bins + 1)).reshape(nodes, -1), axis=1)
                h = np.cumsum(np.bincount(cell, bend, nodes * (bins + 1)).reshape(nodes, -1), axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(h < least) | (h[:, -1:] - h < least)] = 0
                gain = gain[:, : len(e)]
                cut = gain.argmax(axis=1)
                better = gain[np.arange(nodes), cut] > best
                best[better] = gain[np.arange(nodes), cut][better]
                feature[base : base + nodes][better] = f
                threshold[base : base + nodes][better] = e[cut][better]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        local = at - (2**depth - 1)
        leaf = rate * np.bincount(local, slope, 2**depth) / (np.bincount(local, bend, 2**depth) + ridge)
        score += leaf[local]
        parts.append((feature, threshold, leaf))
    feature, threshold, leaf = map(np.array, zip(*parts, strict=True))
    return Trees(feature, threshold, leaf, model.base)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the part that is kept from learning; null ids do."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits trees on labelled rows outside the held-out part, at most `sample_rows` of them."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in _text.slices(batch.column(2), lower=False):
                x = statistics(part)
                own = batch.slice(row, len(part))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), _text.list_column(list(x), pa.float32())], names=["doc_id", "y", "x"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "y", "text").mapInArrow(measure, f"doc_id {kind}, y int, x array<float>").toPandas().sort_values("doc_id")
    if not len(rows):
        return fit(np.zeros((0, 1), np.float32), np.zeros(0))
    return fit(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(dtype=np.float64))


def scored(documents: DataFrame, model: Trees) -> DataFrame:
    """Adds to every row of documents its quality score (0 to 1); a column of that name is replaced.

    Null texts count as empty.  Rows are kept as they are, repeated ones included.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        model, out = held.value, []
        for _, part in _text.slices(pa.array(texts, pa.large_string(), from_pandas=True), lower=False):
            out.append(model.score(statistics(part)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return documents.withColumn("score", score(F.col("text").cast("string")))


def op8_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted (1 if score >= threshold).

    One row for each row of documents; null texts count as empty; null ids are held out.  Several labels of a
    document are averaged, null ones ignored; without labels, or with one kind only, the score is the share of ones.
    """
    found = scored(documents.select("doc_id", "text"), train(documents, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
