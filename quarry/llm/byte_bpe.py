"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Texts are cut into pieces by the vocabulary's pattern.  A piece that is in the vocabulary as it stands is one
token; any other starts as its bytes' tokens, and the adjacent pair of lowest rank (the leftmost of equals) is
replaced by its merged token until no pair has a rank.  A task merges the distinct pieces that it meets, all
of a slice at once: each step finds every piece's best pair in numpy arrays, asking a rank map of fixed size.
Pieces of more than `LONG_PIECE` bytes (runs without spaces) are merged by a heap, with the same result.
Decoding concatenates the tokens' bytes.

The form named first, a fold by Spark's higher-order functions with a literal rank map, gave the same ids but
took several times the time allowed; the README has the figures.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text

#: Bytes of text that are merged together, of the longest piece that the arrays take, and pieces that a task remembers.
SLICE_BYTES, LONG_PIECE, KNOWN_PIECES = 1 << 19, 128, 200_000
#: Ids that are decoded together.
SLICE_IDS = 1 << 16

#: Sizes of the two halves of the rank map (primes); a pair is in the one place or the other.
FIRST, SECOND = 181_081, 229_937
#: Bits that hold a merged token in an entry; above them stands the pair.
BITS = 17
NONE = (1 << BITS) - 1


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def rank_map(vocabulary: dict[bytes, int]) -> list[int]:
    """Every mergeable pair of tokens in one of its two places: pair << BITS | merged token; empty places hold -1."""
    slots = [-1] * (FIRST + SECOND)
    for merged, rank in vocabulary.items():
        for k in range(1, len(merged)):
            left, right = vocabulary.get(merged[:k]), vocabulary.get(merged[k:])
            if left is None or right is None:
                continue
            entry = (left << 16 | right) << BITS | rank
            place = (entry >> BITS) % FIRST
            for _ in range(500):
                entry, slots[place] = slots[place], entry
                if entry < 0:
                    break
                key = entry >> BITS
                place = FIRST + key % SECOND if place == key % FIRST else key % FIRST
            else:
                raise ValueError("the rank map is too small for this vocabulary")
    return slots


class Merger:
    """Merges pieces of one task; it remembers the distinct pieces met, up to a bound, as arrays of tokens."""

    def __init__(self, vocabulary: dict[bytes, int], slots: np.ndarray, most: int = KNOWN_PIECES):
        self.vocabulary, self.slots, self.most = vocabulary, slots, most
        self.byte_token = np.array([vocabulary[bytes([b])] for b in range(256)], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.bounds = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 16 | right
        one, other = self.slots[key % FIRST], self.slots[FIRST + key % SECOND]
        return np.where(one >> BITS == key, one & NONE, np.where(other >> BITS == key, other & NONE, NONE))

    def learn(self, pieces: list[bytes]) -> None:
        """Merges new pieces and appends their tokens to the arrays."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active, raws = [], []
        for k, raw in enumerate(pieces):
            whole = self.vocabulary.get(raw)
            if whole is None and len(raw) <= LONG_PIECE:
                active.append(k)
                raws.append(raw)
            else:
                ids = [whole] if whole is not None else merge_long(raw, self.vocabulary)
                done.append((np.array([k]), np.array([len(ids)]), np.array(ids)))
        number, size = np.array(active, dtype=np.int64), np.array([len(r) for r in raws], dtype=np.int64)
        tokens = self.byte_token[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        while len(number):
            first = np.cumsum(size) - size
            rank = np.full(len(tokens), NONE, dtype=np.int64)
            rank[:-1] = self.rank(tokens[:-1], tokens[1:])
            rank[first + size - 1] = NONE
            best = np.minimum.reduceat(rank << 40 | np.arange(len(tokens)), first)
            ended = best >> 40 == NONE
            if ended.any():
                of_ended = np.repeat(ended, size)
                done.append((number[ended], size[ended], tokens[of_ended]))
            keep = ~np.repeat(ended, size)
            at = best[~ended] & ((1 << 40) - 1)
            tokens[at] = best[~ended] >> 40
            keep[at + 1] = False
            tokens, number, size = tokens[keep], number[~ended], size[~ended] - 1
        numbers, sizes, flat = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(numbers, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        self.tokens = np.concatenate([self.tokens, flat[_ranges(starts, sizes[order])].astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes[order])])

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The tokens of texts, each given as its pieces."""
        if len(self.known) > self.most:
            self.forget()
        known, new, codes = self.known, [], []
        for found in texts:
            for piece in dict.fromkeys(found):
                if piece not in known:
                    known[piece] = len(known)
                    new.append(piece.encode())
            codes.append(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)))
        if new:
            self.learn(new)
        return [self.tokens[_ranges(self.bounds[c], self.bounds[c + 1] - self.bounds[c])] for c in codes]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def merge_long(piece: bytes, vocabulary: dict[bytes, int]) -> list[int]:
    """The same merges by a heap, for pieces too long to be looked through at every merge."""
    n = len(piece)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    rank = lambda i: vocabulary.get(piece[i : end[after[i]]]) if after[i] < n else None
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of its tokens has been merged meanwhile
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [vocabulary[piece[i : end[i]]] for i in range(n) if alive[i]]


class Pieces:
    """The bytes of every token of a vocabulary, end to end."""

    def __init__(self, vocabulary: dict[bytes, int]):
        size = max(vocabulary.values()) + 1
        pieces = [b""] * size
        for token, rank in vocabulary.items():
            pieces[rank] = token
        self.flat, self.bounds = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum([0, *map(len, pieces)])
        self.given = np.isin(np.arange(size), list(vocabulary.values()))

    def _joined(self, column: pa.ListArray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
        value = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = (value >= 0) & (value < len(self.given))
        value = np.where(known, value, 0)
        known &= self.given[value]
        sizes = (self.bounds[value + 1] - self.bounds[value]) * known
        body = self.flat[_ranges(self.bounds[value], sizes)]
        at = np.concatenate([[0], np.cumsum(sizes)])[ends]
        wrong = np.concatenate([[0], np.cumsum(~known)])[ends]
        null = (np.diff(wrong) > 0) | pc.is_null(column).to_numpy(zero_copy_only=False)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)])
        return pc.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())

    def decode(self, column: pa.ListArray) -> pa.Array:
        """The bytes of each row's ids; null where the row is null or holds a null or unknown id."""
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()])
        row, parts = 0, [pa.array([], pa.binary())]
        while row < len(column):  # bounded ids at a time, or one longer row
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE_IDS, side="right")) - 1)
            parts.append(self._joined(column.slice(row, stop - row)))
            row = stop
        return pa.concat_arrays(parts)


def encode(documents: DataFrame, vocabulary: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """Token ids of every whole text: doc_id, ids (array of int); with a name given, a column `decoded` from the ids.

    One row for each row of documents, repeated ones included; null and empty texts have no ids.  Special
    tokens are ordinary text.  Other columns are ignored, whatever their names.  Decoding here does what `decode`
    does, in the same Python worker: a task of both apart holds two.
    """
    held = documents.sparkSession.sparkContext.broadcast((vocabulary, np.array(rank_map(vocabulary), dtype=np.int64), Pieces(vocabulary) if decoded else None))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        vocabulary, slots, pieces = held.value
        merger, find = Merger(vocabulary, slots), regex.compile(pattern).findall
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            sizes = np.cumsum([0, *pc.binary_length(texts).to_pylist()])
            row = 0
            while row < len(texts):
                stop = max(row + 1, int(np.searchsorted(sizes, sizes[row] + SLICE_BYTES, side="right")) - 1)
                ids = _text.list_column(merger.encode([find(text) for text in texts.slice(row, stop - row).to_pylist()]), pa.int32())
                own = {"doc_id": batch.column(0).slice(row, stop - row), "ids": ids} | ({decoded: pieces.decode(ids)} if decoded else {})
                yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))
                row = stop

    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(cut, f"doc_id {kind}, ids array<int>" + (f", {decoded} binary" if decoded else ""))


def decode(encoded: DataFrame, vocabulary: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that ids stand for (binary); null where ids is null or holds a null or unknown id."""
    held = encoded.sparkSession.sparkContext.broadcast(Pieces(vocabulary))

    @F.arrow_udf("binary")
    def join(column: pa.Array) -> pa.Array:
        return held.value.decode(column)

    return encoded.withColumn(out, join(F.col(ids)))


def op10_byte_bpe(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = encode(documents, ranks(path), pattern, decoded="decoded")
    listed = F.btrim(F.to_json("ids"), F.lit("[]"))  # to_json writes [1,2,3]
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
