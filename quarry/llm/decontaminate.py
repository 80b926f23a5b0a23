"""Benchmark decontamination by a prefix-filtered containment join.

A *window* is `width` consecutive words of a benchmark item; an item with fewer words (but not none)
is one window.  A document contains a window where the same words stand in the same order.  Containment
of a whole window makes one token of it a sufficient prefix, so each window is indexed by its rarest
word, by frequency over all documents.  A document word equal to that token proposes one placement
(positional bound: the token's offset in the window), which must lie inside the document (length bound)
and is then verified word by word.

The window index is cut into blocks of a bounded number of windows, and each block is matched against
all documents, so the part of the benchmark that tasks hold never grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text
from quarry.llm._work import saved

#: Windows that one block may hold; a window takes about 200 bytes in a task.
BLOCK_WINDOWS = 200_000


def _words(texts: _text.Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, first = texts.spans(_text.ALNUM)
    return texts.hashes(starts, stops), first


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows of items: item_id (string), words (hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _text.slices(batch.column(1)):
                words, first = _words(texts)
                owners, windows = [], []
                for i in range(len(texts)):
                    own = words[first[i] : first[i + 1]].view(np.int64)
                    for k in range(max(1, len(own) - width + 1) if len(own) else 0):
                        owners.append(row + i)
                        windows.append(own[k : k + width])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), _text.list_column(windows, pa.int64())], names=["item_id", "words"])

    # array positions would tie a huge item to one task; distinct windows spread over all tasks instead
    return items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).mapInArrow(cut, "item_id string, words array<bigint>").distinct()


class _Lookup:
    """Membership of hashes in a fixed set: a bitmap turns most away, a sorted array settles the rest."""

    BITS = 20

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        self.bitmap = np.zeros(1 << self.BITS, dtype=bool)
        self.bitmap[(self.values >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known words, and their places in the sorted values."""
        at = np.flatnonzero(self.bitmap[(words >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        place = np.searchsorted(self.values, words[at])
        place[place == len(self.values)] = 0
        known = self.values[place] == words[at]
        return at[known], place[known]


def word_frequencies(documents: DataFrame, text: str, vocabulary: np.ndarray) -> DataFrame:
    """How often all documents together hold each word of a bounded vocabulary: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(vocabulary)
        total = np.zeros(len(lookup.values), dtype=np.int64)
        for batch in batches:
            for _, texts in _text.slices(batch.column(0)):
                words, _ = _words(texts)
                total += np.bincount(lookup.find(words)[1], minlength=len(total))
        seen = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(lookup.values[seen].view(np.int64)), pa.array(total[seen])], names=["word", "n"])

    return documents.select(F.col(text).cast("string")).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class _Block:
    """One block of windows, indexed by each window's rarest word."""

    def __init__(self, windows: list[tuple[tuple[int, ...], list[str]]], frequency: dict[int, int]):
        keys, offsets = [], []
        for words, _ in windows:
            rarest = min(range(len(words)), key=lambda k: (frequency.get(words[k], 0), words[k], k))
            keys.append(words[rarest])
            offsets.append(rarest)
        order = np.argsort(np.array(keys, dtype=np.int64).view(np.uint64), kind="stable")
        self.lookup = _Lookup(np.array(keys, dtype=np.int64).view(np.uint64))
        self.offset = np.array(offsets, dtype=np.int64)[order]
        self.length = np.array([len(w) for w, _ in windows], dtype=np.int64)[order]
        self.words = np.zeros((len(windows), max(len(w) for w, _ in windows)), dtype=np.uint64)
        for row, k in enumerate(order):
            self.words[row, : len(windows[k][0])] = np.array(windows[k][0], dtype=np.int64).view(np.uint64)
        self.items = [windows[k][1] for k in order]
        sorted_keys = np.array(keys, dtype=np.int64).view(np.uint64)[order]
        self.first = np.searchsorted(sorted_keys, self.lookup.values, side="left")
        self.count = np.searchsorted(sorted_keys, self.lookup.values, side="right") - self.first

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (word positions in the slice) of verified windows, and their numbers."""
        at, key = self.lookup.find(words)
        repeat = self.count[key]
        at, window = np.repeat(at, repeat), np.repeat(self.first[key], repeat)
        window = window + np.arange(len(window)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        text = np.searchsorted(first, at, side="right") - 1
        start = at - self.offset[window]
        stop = start + self.length[window]
        fits = (start >= first[text]) & (stop <= first[text + 1])
        start, stop, window = start[fits], stop[fits], window[fits]
        for k in range(self.words.shape[1]):  # word by word; few placements outlive the second word
            same = (k >= self.length[window]) | (words[np.minimum(start + k, len(words) - 1)] == self.words[window, k])
            start, stop, window = start[same], stop[same], window[same]
        return start, stop, window


_SCAN = "doc_key string, text_key bigint, n_words bigint, spans array<struct<s:int,e:int>>, items array<string>"


def _scan(documents: DataFrame, block: _Block | None) -> DataFrame:
    """One row a document: its number of words, its merged hit spans and the items found."""
    held = documents.sparkSession.sparkContext.broadcast(block)
    span = pa.struct([("s", pa.int32()), ("e", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            for row, texts in _text.slices(batch.column(2)):
                words, first = _words(texts)
                n = len(texts)
                spans: list[list] = [[] for _ in range(n)]
                items: list[list] = [[] for _ in range(n)]
                if block is not None and len(words):
                    start, stop, window = block.occurrences(words, first)
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, stop, -1)
                    covered = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
                    edges = np.flatnonzero(covered[1:] != covered[:-1])
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        while a < b:  # spans of texts that touch are cut at the text's end
                            text = int(np.searchsorted(first, a, side="right")) - 1
                            end = min(b, first[text + 1])
                            spans[text].append({"s": int(a - first[text]), "e": int(end - first[text])})
                            a = end
                    owner = np.searchsorted(first, start, side="right") - 1
                    for text, w in np.unique(np.stack([owner, window]), axis=1).T:
                        items[text].extend(block.items[w])
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(span)), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))], names=["doc_key", "text_key", "n_words", "spans", "items"])

    return documents.mapInArrow(scan, _SCAN)


def _merged(spans: F.Column) -> F.Column:
    """Number of positions that half-open spans cover together."""
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], s["to"]))).alias("n"), F.greatest(s["to"], x["e"]).alias("to"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"].cast("bigint")


def contaminated(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Which documents hold benchmark windows: doc_id, n_words, n_hit, items (sorted strings), contaminated.

    One row for each row of documents, repeated and equal ones included.  Null and empty texts have no
    words and hold nothing; items that are null, empty or lack an id have no windows; an empty benchmark hits
    nothing.  Items that share a window are all reported.  Other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    windows = saved(item_windows(items, item_id, item_text, width).groupBy("words").agg(F.collect_set("item_id").alias("items")))
    blocks = max(1, -(-windows.count() // block_windows))
    kind = documents.schema[doc_id].dataType
    source = documents.select(F.col(doc_id).cast("string").alias("doc_key"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    scans = []
    for k in range(blocks):  # a block is bounded, so it may be held by the driver and each task
        rows = (windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) if blocks > 1 else windows).toArrow()
        if len(rows):
            vocabulary = np.unique(rows["words"].combine_chunks().flatten().to_numpy()).view(np.uint64)
            counted = word_frequencies(documents, text, vocabulary).toArrow()
            frequency = dict(zip(counted["word"].to_pylist(), counted["n"].to_pylist(), strict=True))
            held = sorted((tuple(words), sorted(found)) for words, found in zip(rows["words"].to_pylist(), rows["items"].to_pylist(), strict=True))
            scans.append(_scan(source, _Block(held, frequency)))
    if not scans:
        scans.append(_scan(source, None))
    found = scans[0]
    if len(scans) > 1:
        for other in scans[1:]:
            found = found.unionByName(other)
        both = F.flatten(F.collect_list("spans")), F.flatten(F.collect_list("items"))
        found = found.groupBy("doc_key", "text_key", "n_words").agg(F.count("*").alias("n"), both[0].alias("spans"), both[1].alias("items"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / len(scans)).cast("int"))))
    hit = _merged(F.col("spans"))
    return found.select(F.col("doc_key").cast(kind).alias("doc_id"), "n_words", hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), (hit > 0).alias("contaminated"))


def op3_decontaminate(documents: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The digest of `contaminated`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated(documents, items, width=width)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bench WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT g.doc_id, g.i, g.k, v.item_id FROM grams g JOIN win v ON g.k = v.k AND g.gram = v.gram),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
