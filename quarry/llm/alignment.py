"""Cross-tokenizer alignment: where two tokenizers' tokens of the same text end together, and which tokens share bytes.

Both tokenizers' tokens cover the same bytes, so their ends are two rising sequences.  A batch's sequences are merged in
lockstep: one state vector holds a pointer pair for each document (a long one has several, each from a byte onward),
every step advances the side that ends first or, at a common end, both and notes a cut, and finished pairs are
compacted away.  Cuts part the tokens into groups; all pairs of a group are links.

How often documents hold a pair of ids linked is counted over the corpus by chunks of documents: a chunk lists its
distinct pairs, Spark sums them, and cells of bounded size answer what chunks ask.  No pair gathers its documents
anywhere; a document is only read with its own chunk.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text
from quarry.llm._work import saved
from quarry.llm.ngrams import _pack, _split, _steps, _unpack

#: Bytes of text that are aligned together; tokens of one pointer pair; tokens of a chunk; pairs of a cell.
SLICE_BYTES, LANE, CHUNK_TOKENS, CELL_PAIRS = 1 << 20, 512, 2_000_000, 1_000_000
#: Groups with more pairs than this are counted by distinct ids first.
WIDE = 64
_SPACE_MARK = "▁"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Pieces:
    """The bytes that each id of a vocabulary stands for."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_ranges(self.first[ids], self.size[ids])]


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Tokens by a byte-level vocabulary file; special tokens in texts are plain text.

    Where a file numbers its merges in their order and cuts texts by the usual pattern, ranks say the same as merges,
    and the rank encoder takes the place of the file's own, with the same ids at a fraction of the time.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        letters, entries = byte_alphabet(), whole["model"]["vocab"]
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        pieces = [b""] * (max(*entries.values(), *special.values()) + 1)
        for entry, k in (entries | special).items():
            pieces[k] = bytes(letters[c] for c in entry)
        self.pieces = Pieces(pieces)
        merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        numbered = [entries[left + right] for left, right in merges]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        before = {k: v for k, v in (whole["pre_tokenizer"] or {}).items() if k in usual}
        # every entry but single bytes is the result of one merge, and later merges have larger ids
        ordered = all(x < y for x, y in itertools.pairwise(numbered)) and len(entries.keys() - special.keys()) == 256 + len(set(numbered))
        if before == usual and ordered and not whole["normalizer"]:
            import tiktoken

            ranks = {bytes(letters[c] for c in entry): k for entry, k in entries.items() if entry not in special}
            by_rank = tiktoken.Encoding("entries", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._encode = lambda texts: [by_rank.encode_to_numpy(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(json.dumps(whole))
            tokenizer.encode_special_tokens = True
            self._encode = lambda texts: [np.array(e.ids, dtype=np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self._encode([" " + t for t in texts])


class SentencePieces:
    """Tokens by a sentence-piece model, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.pieces = Pieces([bytes([int(name[3:5], 16)]) if model.is_byte(k) else name.replace(_SPACE_MARK, " ").encode() for k, name in enumerate(names)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.model.encode_as_numpy(texts, num_threads=1)


def cuts(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens (ends a and b, rising over all documents) that end together, in order.

    Document k has the tokens from first[k] to first[k + 1].  A document of more than LANE tokens is merged by several
    pointer pairs, which start after every LANE-th token of a and all tokens of b that end no later.
    """
    lanes = -(-np.diff(a_first) // LANE)
    i = _ranges(np.zeros(len(lanes), dtype=np.int64), lanes) * LANE + np.repeat(a_first[:-1], lanes)
    j = np.searchsorted(b, a[i - 1], side="right")
    fresh = np.cumsum(lanes) - lanes
    j[fresh[lanes > 0]] = b_first[:-1][lanes > 0]
    i_end, j_end = np.append(i[1:], len(a)), np.append(j[1:], len(b))
    found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    alive = (i < i_end) & (j < j_end)
    while True:
        if not alive.all():
            i, j, i_end, j_end = i[alive], j[alive], i_end[alive], j_end[alive]
        if not len(i):
            break
        x, y = a[i], b[j]
        same = x == y
        found_a.append(i[same])
        found_b.append(j[same])
        i, j = i + (x <= y), j + (x >= y)
        alive = (i < i_end) & (j < j_end)
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _flat(ids: list[np.ndarray], given: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts that are given and not empty, end to end, and where each text's begin."""
    kept = [x if t else x[:0] for x, t in zip(ids, given, strict=True)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *kept]).astype(np.int64), np.cumsum([0, *map(len, kept)])


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))


def _aligned(texts: list[str], one: ByteLevel, other: SentencePieces) -> list[pa.ListArray]:
    """Ids of both sides and, at each cut, how many tokens of the document end there or before."""
    raw = [(" " + t).encode() if t else b"" for t in texts]
    some = [t or "" for t in texts]
    (a, a_first), (b, b_first) = _flat(one.encode(some), texts), _flat(other.encode(some), texts)
    whole = np.cumsum([0, *map(len, raw)])
    same = np.ones(len(texts), dtype=bool)
    for side, ids, first in ((one, a, a_first), (other, b, b_first)):
        ends = np.concatenate([[0], np.cumsum(side.pieces.size[ids])])[first]
        same &= np.diff(ends) == np.diff(whole)
    if same.any():  # documents of the right length: their bytes must be the text's
        data = np.frombuffer(b"".join(x for x, s in zip(raw, same, strict=True) if s), dtype=np.uint8)
        owner = np.repeat(np.flatnonzero(same), np.diff(whole)[same])
        for side, ids, first in ((one, a, a_first), (other, b, b_first)):
            same[owner[side.pieces.joined(ids[np.repeat(same, np.diff(first))]) != data]] = False
            data, owner = data[same[owner]], owner[same[owner]]
    a, b = a[np.repeat(same, np.diff(a_first))], b[np.repeat(same, np.diff(b_first))]
    a_first, b_first = (np.concatenate([[0], np.cumsum(np.diff(f) * same)]) for f in (a_first, b_first))
    at, bt = cuts(np.cumsum(one.pieces.size[a]), np.cumsum(other.pieces.size[b]), a_first, b_first)
    cut_first = np.searchsorted(at, a_first)
    groups = np.diff(cut_first)
    return [_lists(a, a_first), _lists(b, b_first), _lists(at + 1 - np.repeat(a_first[:-1], groups), cut_first), _lists(bt + 1 - np.repeat(b_first[:-1], groups), cut_first)]


def aligned(documents: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text by both vocabularies and where they end together: doc_id, a, b (ids), a_cuts, b_cuts
    (at the k-th common end, how many tokens of each side lie before it).

    One row for each row of documents, repeated ones included.  Texts that are null, empty, or of which either side's
    tokens don't give back a space and the text, have none.  Other columns are ignored, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = None, None
        for batch in batches:
            if one is None:
                one, other = ByteLevel(a_path), SentencePieces(b_path)
            sizes = np.cumsum([0, *pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()])
            row = 0
            while row < len(batch):
                stop = max(row + 1, int(np.searchsorted(sizes, sizes[row] + SLICE_BYTES, side="right")) - 1)
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([part.column(0), *_aligned(part.column(1).to_pylist(), one, other)], names=["doc_id", "a", "b", "a_cuts", "b_cuts"])
                row = stop

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, f"doc_id {kind}, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>")


class _Batch:
    """Alignments of one batch, end to end."""

    def __init__(self, batch: pa.RecordBatch):
        lists = [batch.column(k) for k in range(1, 5)]
        sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        self.a, self.b, at, bt = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        self.n_a, self.n_b, self.groups = sizes[:3]
        self.owner = np.repeat(np.arange(len(batch)), self.groups)
        self.a_stop = at + (np.cumsum(self.n_a) - self.n_a)[self.owner]
        self.b_stop = bt + (np.cumsum(self.n_b) - self.n_b)[self.owner]
        # tokens of a document end with its last group, so a group begins where the one before ends
        self.a_size, self.b_size = (np.diff(x, prepend=0) for x in (self.a_stop, self.b_stop))
        self.links = np.bincount(self.owner, self.a_size * self.b_size, len(batch)).astype(np.int64)

    def digests(self) -> list[str]:
        """Of each document's groups as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        a_group, b_group = (np.repeat(np.arange(len(self.owner)), x) for x in (self.a_size, self.b_size))
        place_a = np.arange(len(self.a)) + (self.b_stop - self.b_size)[a_group]
        place_b = np.arange(len(self.b)) + self.a_stop[b_group]
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[self.a_stop - 1]], after[place_b[self.b_stop - 1]] = ord("|"), ord(";")
        digits = np.ones(len(ids), dtype=np.int64)
        for k in range(1, len(str(int(ids.max(initial=0))))):
            digits += ids >= 10**k
        ends = np.cumsum(digits + 1)
        body = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        body[ends - 1] = after
        for k in range(int(digits.max(initial=0))):
            some = np.flatnonzero(digits > k)
            body[ends[some] - 2 - k] = 48 + ids[some] // 10**k % 10
        stops = np.concatenate([[0], ends])[np.cumsum(self.n_a + self.n_b)]
        starts = np.concatenate([[0], stops[:-1]])
        return [hashlib.sha256(body[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair of ids and links of each distinct pair that a document holds linked, by document and pair."""
        many = self.a_size * self.b_size
        wide = many > WIDE
        g = np.flatnonzero(~wide)
        inside = _ranges(np.zeros(len(g), dtype=np.int64), many[g])
        own = np.repeat(g, many[g])
        width = self.b_size[own]
        doc, key = self.owner[own], self.a[(self.a_stop - self.a_size)[own] + inside // width] << 32 | self.b[(self.b_stop - self.b_size)[own] + inside % width]
        parts = [(doc, key, np.ones(len(key), dtype=np.int64))]
        for k in np.flatnonzero(wide).tolist():
            ua, ca = np.unique(self.a[self.a_stop[k] - self.a_size[k] : self.a_stop[k]], return_counts=True)
            ub, cb = np.unique(self.b[self.b_stop[k] - self.b_size[k] : self.b_stop[k]], return_counts=True)
            pair = (ua[:, None] << 32 | ub[None, :]).ravel()
            parts.append((np.full(len(pair), self.owner[k]), pair, (ca[:, None] * cb[None, :]).ravel()))
        doc, key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, doc))
        doc, key, count = doc[order], key[order], count[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return doc[at], key[at], np.add.reduceat(count, at) if len(at) else count


_CHUNK = "chunk bigint, doc_id array<{}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, held binary, pairs binary, entries bigint"
_ASKED = "part bigint, salt bigint, chunk bigint, data binary"


def _chunks(found: DataFrame) -> DataFrame:
    """Chunks of documents: what is known of each, its pairs as places in the chunk's list of pairs, and this list with
    how many documents of the chunk hold each."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[pa.RecordBatch] = []
        kept: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            sizes, keys, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
            pairs, place = np.unique(keys, return_inverse=True)
            held = _pack(sizes.astype(np.uint32), np.diff(place.astype(np.int64), prepend=0).astype(np.uint32), counts.astype(np.uint32))
            of_chunk = _pack(_steps(pairs.view(np.uint64)), np.bincount(place, minlength=len(pairs)).astype(np.uint32))
            columns = pa.Table.from_batches(rows).columns
            lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), c.combine_chunks()) for c in columns]
            rows.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([held]), pa.array([of_chunk]), pa.array([len(pairs)], pa.int64())], names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "pairs", "entries"])

        for batch in batches:
            own = _Batch(batch)
            doc, key, count = own.pairs()
            kept.append((np.bincount(doc, minlength=len(batch)), key, count))
            rows.append(pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (own.n_a, own.n_b, own.groups, own.links)), pa.array(own.digests(), pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]))
            waiting += len(own.a) + len(own.b)
            if waiting >= CHUNK_TOKENS:
                yield flush()
                number, waiting = number + 1, 0
        if rows:
            yield flush()

    return found.mapInArrow(work, _CHUNK.format(kind))


def _part(pairs: np.ndarray, parts: int) -> np.ndarray:
    return (_text.mix(pairs) % np.uint64(parts)).astype(np.int64)


def _weights(chunks: DataFrame) -> DataFrame:
    """For each pair how many documents of the corpus hold it linked, and whether none of its a has more: pair, count, best."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                pairs, counts = _unpack(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(pairs).view(np.int64)), pa.array(counts.astype(np.int64))], names=["pair", "n"])

    total = saved(chunks.select("pairs").mapInArrow(each, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("count")))
    side = F.shiftright("pair", 32)
    most = total.groupBy(side.alias("side")).agg(F.max("count").alias("most"))
    return total.join(most, side == F.col("side")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _answers(chunks: DataFrame, weights: DataFrame) -> DataFrame:
    """What each chunk's pairs count, cell by cell: chunk, part, data.

    A cell is a part of the pairs for some of the chunks.  It holds at most about CELL_PAIRS pairs and as many questions,
    since there are as many copies of the weights as fit into what all chunks ask.
    """
    pairs, asked = weights.count(), chunks.agg(F.sum("entries")).first()[0] or 0
    parts = max(1, -(-pairs // CELL_PAIRS))
    salts = max(1, asked // max(1, pairs))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.cumsum(_unpack(blob.as_py())[0])
                sent = [(p, _pack(_steps(own[at]))) for p, at in _split(_part(own, parts))]
                salt = int(_text.mix(np.array([chunk], dtype=np.uint64))[0] % np.uint64(salts))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in sent], pa.int64()), pa.array([salt] * len(sent), pa.int64()), pa.array([chunk] * len(sent), pa.int64()), pa.array([d for _, d in sent], pa.binary())], names=["part", "salt", "chunk", "data"])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _part(batch.column(0).to_numpy().view(np.uint64), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], names=["part", *batch.schema.names])

    def packed(table: pa.Table) -> pa.Table:
        pair, count, best = (table.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair.view(np.uint64))
        blob = _pack(_steps(pair[order].view(np.uint64)), count[order], best[order].astype(np.uint8))
        return pa.table({"part": table.column("part").slice(0, 1), "data": pa.array([blob], pa.binary())})

    def answer(weight: pa.Table, questions: pa.Table) -> pa.Table:
        if not len(weight) or not len(questions):
            return pa.table({"chunk": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        pair, count, best = _unpack(weight.column("data")[0].as_py())
        pair, out = np.cumsum(pair), []
        for blob in questions.column("data"):
            at = np.searchsorted(pair, np.cumsum(_unpack(blob.as_py())[0]))
            out.append(_pack(count[at], best[at]))
        return pa.table({"chunk": questions.column("chunk"), "part": questions.column("part"), "data": pa.array(out, pa.binary())})

    told = weights.mapInArrow(parted, "part bigint, pair bigint, count bigint, best boolean").groupBy("part").applyInArrow(packed, "part bigint, data binary")
    copies = told.select("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), "data")
    questions = chunks.select("chunk", "pairs").mapInArrow(ask, _ASKED)
    return copies.groupBy("part", "salt").cogroup(questions.groupBy("part", "salt")).applyInArrow(answer, "chunk bigint, part bigint, data binary"), parts


_RESULT = "doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def counted(found: DataFrame) -> DataFrame:
    """Links of `aligned` documents against the whole corpus: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair
    of ids no pair of the same a-id exceeds in documents, ties included), count_sum (those documents, summed over links),
    groups_sha256.

    One row for each row given; those without tokens have zeros and an empty digest.
    """
    chunks = saved(_chunks(found))
    answers, parts = _answers(chunks, saved(_weights(chunks)))
    given = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "data")).alias("answers"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                sizes, steps, counts = _unpack(row.column("held")[0].as_py())
                pairs = np.cumsum(_unpack(row.column("pairs")[0].as_py())[0])
                place = np.cumsum(steps.view(np.int32).astype(np.int64))
                count, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
                told = {a["part"]: a["data"] for a in row.column("answers")[0].as_py() or []}
                for p, own in _split(_part(pairs, parts)):
                    count[own], best[own] = _unpack(told[p])
                doc, counts = np.repeat(np.arange(len(sizes)), sizes), counts.astype(np.int64)
                sums = []
                for value in (best, count):
                    total = np.zeros(len(sizes), dtype=np.int64)
                    np.add.at(total, doc, counts * value[place])
                    sums.append(pa.array(total))
                lists = [row.column(c)[0].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*lists, *sums, row.column("groups_sha256")[0].values], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return chunks.join(given, "chunk", "left").mapInArrow(work, _RESULT.format(found.schema["doc_id"].dataType.simpleString()))


def op13_token_alignment(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The result of `counted` over all documents, doc_id as long."""
    return counted(aligned(documents.withColumn("doc_id", F.col("doc_id").cast("long")), a_path, b_path))
