"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union by components.

A line is compared without white space at its ends and with A-Z in lower case.  Its shingles are all runs of
`SHINGLE` bytes of UTF-8.  Lines shorter than `least` bytes are left alone (blank lines, braces, headings).  Equal
lines are one content; MinHash signatures of contents (over all shingles) fall into bands, candidates are confirmed by exact Jaccard similarity of all shingles, and of each component of contents only
the first line stays: that of the smallest (doc_id, line number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text
from quarry.llm._work import MaybeAmong, outlasting, passing_tables, saved
from quarry.llm.linking import VALUES, Sets, band_keys, linked_components, shared_buckets, sketch_bits

#: Bytes of a shingle; bands and minwise values of each (a pair at 0.85 shares a band with a chance of 0.9998).
SHINGLE, BANDS, ROWS = 8, 12, 4
#: Least bytes of a line, and percent of similarity.
LEAST, PERCENT = 24, 85

_SEEDS = _text.seeds(BANDS * ROWS, salt=9).astype(np.uint32)
#: Signatures of lines have minwise values of 16 bits up to some SHORT shingles, and of 32 bits from SHORT on.
SHORT, _SHORT_SEEDS = 4096, _SEEDS.astype(np.uint16)
_SKETCH_SEEDS = _text.seeds(VALUES, salt=109).astype(np.uint16)
#: Bytes of white space that are taken off all lines together.
STEPS = 16


def _trimmed(texts: _text.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines without ASCII white space at their ends; lines of white space alone end where they start."""
    starts, stops, first = texts.lines()
    left, right = starts.copy(), stops.copy()
    for edge, at, step in ((left, 0, 1), (right, -1, -1)):
        open_ = np.flatnonzero(left < right)
        for _ in range(STEPS):
            open_ = open_[~_text.NOT_SPACE[texts.data[edge[open_] + at]]]
            edge[open_] += step
            open_ = open_[left[open_] < right[open_]]
            if not len(open_):
                break
        for k in open_:  # long runs of white space
            shown = np.flatnonzero(_text.NOT_SPACE[texts.data[left[k] : right[k]]])
            edge[k] = left[k] + (shown[0] if step > 0 else shown[-1] + 1) if len(shown) else left[k] if step < 0 else right[k]
    blank = left >= right
    left[blank] = right[blank] = starts[blank]
    return left, right, first


def _windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number: a view."""
    padded = np.concatenate([data, np.zeros(SHINGLE, np.uint8)])
    return np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))


def _distinct(windows: np.ndarray) -> np.ndarray:
    """Sorted distinct windows (np.unique takes five times as long over so few)."""
    ordered = np.sort(windows)
    new = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def _minwise(windows: np.ndarray, starts: np.ndarray, stops: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minwise values of lines, one row a line."""
    return _text.minwise(windows, starts, stops - starts - SHINGLE + 1, seeds, raw=True)


def _long_lines(texts: _text.Texts, least_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lines of a slice that are long enough: ids (hashes of their content), starts and stops."""
    starts, stops, _ = _trimmed(texts)
    long = stops - starts >= max(least_bytes, SHINGLE)
    starts, stops = starts[long], stops[long]
    ids, at = np.unique(texts.hashes(starts, stops).view(np.int64), return_index=True)
    return ids, starts[at], stops[at]


def _signatures(texts: _text.Texts, least_bytes: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of a slice's contents, and the id of each.

    Similar sets differ in size by percent at most, so two share a kind of value: both have 16 bits if the
    smaller is below SHORT, else both have 32.
    """
    ids, starts, stops = _long_lines(texts, least_bytes)
    windows, size = _windows(texts.data), stops - starts - SHINGLE + 1
    keys, owners = [], []
    for own, seeds, salt in ((size <= SHORT * 100 // percent, _SHORT_SEEDS, 0), (size >= SHORT, _SEEDS, 1)):
        bands = band_keys(_minwise(windows, starts[own], stops[own], seeds), ROWS, salt)
        keys.append(bands.ravel())
        owners.append(np.repeat(ids[own], bands.shape[1]))
    return np.concatenate(keys), np.concatenate(owners)


def _buckets(source: DataFrame, least_bytes: int, percent: int) -> DataFrame:
    """Buckets of contents: key, id."""

    def signatures(texts: _text.Texts) -> tuple[np.ndarray, np.ndarray]:
        return _signatures(texts, least_bytes, percent)

    return shared_buckets(source, signatures)


def _places(source: DataFrame, least_bytes: int) -> DataFrame:
    """Every line: doc_id, line (from 0), id (hash of its content; null for short lines)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _text.slices(batch.column(1)):
                starts, stops, first = _trimmed(texts)
                owner = np.repeat(np.arange(row, row + len(texts)), np.diff(first))
                number = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
                long = stops - starts >= max(least_bytes, SHINGLE)
                ids = pa.array(texts.hashes(starts, stops).view(np.int64), mask=~long)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(number.astype(np.int32)), ids], names=["doc_id", "line", "id"])

    return source.mapInArrow(cut, "doc_id bigint, line int, id bigint")


def _texts_of(source: DataFrame, wanted: MaybeAmong, least_bytes: int) -> DataFrame:
    """Contents of wanted ids (and a few others), once a slice: id, n (distinct shingles), b1, b2 (sketch), content."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _text.slices(batch.column(1)):
                ids, starts, stops = _long_lines(texts, least_bytes)
                some = wanted.mask(ids)
                ids, starts, stops = ids[some], starts[some], stops[some]
                body, windows = texts.data.tobytes(), _windows(texts.data)
                sizes = [len(_distinct(windows[a : b - SHINGLE + 1])) for a, b in zip(starts, stops, strict=True)]
                bits = sketch_bits(_minwise(windows, starts, stops, _SKETCH_SEEDS))
                content = [body[a:b] for a, b in zip(starts, stops, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes, pa.int64()), *map(pa.array, bits), pa.array(content, pa.binary())], names=["id", "n", "b1", "b2", "content"])

    return source.mapInArrow(cut, "id bigint, n bigint, b1 bigint, b2 bigint, content binary")


def _shingles(content: pa.Scalar) -> np.ndarray:
    data = np.frombuffer(content.as_buffer(), dtype=np.uint8)
    return _distinct(np.ndarray(len(data) - SHINGLE + 1, dtype="<u8", buffer=data, strides=(1,)))


def _sets(source: DataFrame, ids: DataFrame, least_bytes: int, percent: int) -> Sets:
    """The lines of some ids as sets: their contents travel, and shingles are made where two are compared."""

    @F.arrow_udf("boolean")
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x, y, strict=True):
            left, right = _shingles(a), _shingles(b)
            both = np.concatenate([left, right])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(100 * shared >= percent * (len(left) + len(right) - shared))
        return pa.array(out, pa.bool_())

    @F.arrow_udf("array<bigint>")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        return _text.list_column([_text.mix(np.setxor1d(_shingles(a), _shingles(b), assume_unique=True)).view(np.int64) for a, b in zip(x, y, strict=True)], pa.int64())

    kept = saved(_texts_of(source, MaybeAmong(ids), least_bytes).join(ids, "id", "left_semi").dropDuplicates(["id"]))

    def sides(pairs: DataFrame) -> DataFrame:
        left = kept.select(F.col("id").alias("a"), F.col("n"), F.col("content").alias("x"))
        right = kept.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("content").alias("y"))
        return pairs.join(left, "a").join(right, "b")

    def differences(pairs: DataFrame) -> DataFrame:
        both = sides(pairs.select(F.col("id").alias("a"), F.col("p").alias("b")))
        return both.select(F.col("a").alias("id"), F.col("b").alias("p"), "n", "m", apart("x", "y").alias("d"))

    return Sets(kept.select("id", "n", "b1", "b2"), lambda pairs: sides(pairs.select("a", "b")).where(similar("x", "y")).select("a", "b"), differences)


def removals(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_bytes: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """Every line that has others like it: doc_id, line, keeper_doc_id, keeper_line, kept.

    Null texts have no lines that count; rows without a doc_id are left alone.  Rows that share a doc_id share
    line numbers: of equal places the lines of all rows stay or go together.
    """
    source = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with passing_tables(documents.sparkSession):
        components = linked_components(_buckets(source, least_bytes, percent), lambda ids: _sets(source, ids, least_bytes, percent), percent)
        places = saved(_places(source, least_bytes).where("id IS NOT NULL"))
        # most lines have no other like them, so only ids leave the first grouping
        repeated = places.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.col("id").alias("component"))
        groups = saved(components.unionByName(repeated.join(components, "id", "left_anti")))
        among = saved(places.join(groups, "id").select("component", "doc_id", "line"))
        keepers = among.groupBy("component").agg(F.min(F.struct("doc_id", "line")).alias("keeper"))
        found = among.join(keepers, "component")
        return outlasting(found.select("doc_id", "line", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.line").alias("keeper_line"), (F.struct("doc_id", "line") == F.col("keeper")).alias("kept")))


def without_lines(documents: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without some of their lines (doc_id, line); other rows and columns stay as they are."""
    lists = removed.groupBy(F.col("doc_id").alias("removed_from")).agg(F.sort_array(F.collect_set("line")).alias("removed_lines"))
    joined = documents.join(lists, F.col(doc_id) == F.col("removed_from"), "left")

    @F.arrow_udf("string")
    def rest(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for whole, gone in zip(texts, removed, strict=True):
            gone = set(gone.as_py() or ())
            out.append("\n".join(line for k, line in enumerate(whole.as_py().split("\n")) if k not in gone) if gone and whole.is_valid else whole.as_py())
        return pa.array(out, pa.string())

    return joined.withColumn(text, F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(rest(text, "removed_lines"))).drop("removed_from", "removed_lines")


def op9_line_dedup(documents: DataFrame) -> DataFrame:
    """Of every document: doc_id, n_lines, n_removed, removed (line numbers from 0, sorted).

    One row for each row of documents; null texts have 0 lines, empty ones 1.
    """
    found = removals(documents).where("NOT kept").groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    every = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).alias("n_lines"))
    return every.join(found, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
