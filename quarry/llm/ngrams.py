"""Katz backoff n-grams (pairs or triples of words) whose vocabulary and tables grow with the texts.

Tokens are words (A-Z lower-cased, between ASCII white space) and one end for each text; the start stands before
each text and is never predicted.  With h' the history h without its first word, a token x has probability

    s(h) * d(c) * c(h, x) / c(h)    if h was seen and x was seen c times after it, with d(c) < 1 for c of 1 to 5,
    alpha(h) * P(x | h')            if h was seen but never before x,
    P(x | h')                       if h was never seen,

recursively down to words: P(x) = s * d(c) * c(x) / tokens, discounted likewise, and what is left for all words never
seen, which are one.  alpha(h) makes the sum over all x one; s(h) is 1, but c(h) / (c(h) + 1) where discounts leave
nothing (so for words, with their number).  A text's first token has the start alone as its history.

How it runs: texts become chunks of bounded size.  A chunk sends its distinct words to partitions once and gets back
their numbers and counts; then, order by order, its distinct n-grams, with their training counts and the
probabilities that the lower order gives them.  A partition sums what all chunks sent and answers each chunk
in its order.  Frequent histories are cut by the predicted word.  Through the driver go sums over everything, and
those of the histories that were cut (fewer than one for each `PART_ENTRIES` tokens and order).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text
from quarry.llm._work import saved
from quarry.llm.katz import TOP, discounts, held_out

#: Tokens of a chunk; entries of a partition, and those that it looks at together (whole histories).
CHUNK_TOKENS, PART_ENTRIES, RANGE_ENTRIES = 1_000_000, 2_000_000, 200_000
UNKNOWN, END, START, WORDS = 0, 1, 2, 3


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value, equal bytes of their numbers side by side."""
    import zstandard

    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    head = np.array([len(arrays), *map(len, arrays)], dtype=np.int64).tobytes() + "".join(a.dtype.str[1:] for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at = np.frombuffer(raw, np.int64, count, 8), 8 + 8 * count
    kinds, out = [np.dtype(raw[at + 2 * k : at + 2 * k + 2].decode()) for k in range(count)], []
    at += 2 * count
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; where each of the given ones stands in them; one place of each among the given."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, order[new]


class _Gram:
    """A chunk's n-grams of one order: at (token of each), h and w (distinct), place, some (one token's row of each)."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray, order: int):
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[first[:-1]] = START
        self.at = np.arange(len(tokens))
        key, self.place, self.some = _distinct(before.astype(np.uint64) << np.uint64(32) | tokens)
        self.h, self.w, self.lower = key >> np.uint64(32), key.astype(np.uint32), None
        if order == 3:  # by the place of its first pair
            self.lower, pair, pairs = self.place, self.place, key
            inner = np.ones(len(tokens), dtype=bool)
            inner[first[:-1]] = False
            self.at = np.flatnonzero(inner)
            key, self.place, self.some = _distinct(pair[self.at - 1].astype(np.uint64) << np.uint64(32) | tokens[self.at])
            self.h, self.w = pairs[key >> np.uint64(32)], key.astype(np.uint32)


class _Chunk:
    """A chunk as saved: tokens, known words (numbers, counts in training, in all), and what is known of its pairs."""

    def __init__(self, row: dict, texts: tuple[int, int]):
        self.row, self.texts = row, texts
        self.sizes = np.array(row["sizes"])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.trained = np.repeat(~np.array(row["held"]), self.sizes)
        self.tokens, self.vocabulary, self.n, self.all = _unpack(row["data"])
        if row["last"] is not None:  # of distinct pairs: training and all counts; divisor, and probability where not seen
            self.c, self.seen, self.divisor, self.p = _unpack(row["last"])

    @cached_property
    def counts(self) -> np.ndarray:
        return self.n[np.searchsorted(self.vocabulary, self.tokens)].astype(np.int64)


def _asks(chunk: _Chunk, order: int, parts: int) -> tuple[_Gram, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of an order; training counts and divisors of their lower order; which are asked, their parts and histories' cuts."""
    gram = _Gram(chunk.tokens, chunk.first, order)
    if order == 2:
        lower, divisor = chunk.counts[gram.some], np.zeros(len(gram.h), np.int64)
        history = np.minimum(np.searchsorted(chunk.vocabulary, gram.h.astype(np.uint32)), len(chunk.vocabulary) - 1)
        start = gram.h == START
        count, every = np.where(start, chunk.texts[0], chunk.n[history]), np.where(start, chunk.texts[1], chunk.all[history])
    else:
        at = gram.at[gram.some]
        own, history = gram.lower[at], gram.lower[at - 1]
        lower, divisor = chunk.c[own].astype(np.int64), chunk.divisor[own]
        count, every = chunk.c[history], chunk.seen[history]
    cuts = np.maximum(np.ceil(every / PART_ENTRIES), 1).astype(np.uint64)
    part = _text.mix(gram.h + (gram.w.astype(np.uint64) % cuts) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)
    return gram, lower, divisor, count > 0, part.astype(np.int64), cuts


class _Words:
    """The lowest order: Good-Turing discounted counts of words, and what they leave for words never seen."""

    def __init__(self, tokens: int, distinct: int, seen: np.ndarray):
        """seen: how many words were seen once to TOP + 1 times."""
        self.tokens, self.base = tokens, tokens + distinct + 1
        self.discount = np.concatenate([[0], discounts(seen), [1]])
        left = float(((1 - self.discount[1 : TOP + 1]) * np.arange(1, TOP + 1) * seen[:TOP]).sum()) / max(tokens, 1)
        bare = left < 1e-9  # all words are frequent, or there are none: one more count goes to the unseen
        self.divisor = tokens + 1 if bare else tokens
        self.unseen = 1 / (tokens + 1) if bare else left

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discount[np.minimum(count, TOP + 1)] * count / self.divisor, self.unseen)


def _lower(count: np.ndarray, divisor: np.ndarray, discount: np.ndarray | None, words: _Words) -> np.ndarray:
    """Probabilities by the lower order: of words, or (given discounts) of pairs that were seen."""
    return words(count) if discount is None else discount[np.minimum(count, TOP + 1)] * count / np.maximum(divisor, 1)


def _split(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of each part, in order."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    names, begin = np.unique(part[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, begin[1:]), strict=True))


def _sent(chunk: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["part", "chunk", "data"])


_CHUNK = "chunk bigint, ids array<bigint>, held array<boolean>, sizes array<int>, data binary, last binary"
_SENT = "part bigint, chunk bigint, data binary"


def _chunks(source: DataFrame) -> DataFrame:
    """Chunks of texts: each token's place among the chunk's distinct words (the end comes after all), and their hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept, held, sizes, hashes, ends = TaskContext.get().partitionId() << 32, [], [], [], [], []

        def flush() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate(hashes), return_inverse=True)
            size = np.concatenate(sizes)
            tokens = np.insert(place, np.cumsum(size - 1), len(words)).astype(np.uint32)
            out = _chunk_row(number, kept[:], held[:], size, _pack(tokens, _steps(words)))
            for part in (kept, held, sizes, hashes):
                part.clear()
            return out

        waiting = 0
        for batch in batches:
            for row, texts in _text.slices(batch.column(2)):
                starts, stops, first = texts.spans(_text.NOT_SPACE)
                hashes.append(texts.hashes(starts, stops))
                sizes.append(np.diff(first) + 1)
                kept.extend(batch.column(0).slice(row, len(texts)).to_pylist())
                held.extend(batch.column(1).slice(row, len(texts)).to_pylist())
                waiting += len(starts) + len(texts)
                if waiting >= CHUNK_TOKENS:
                    yield flush()
                    number, waiting = number + 1, 0
        if kept:
            yield flush()

    return source.mapInArrow(cut, _CHUNK)


def _chunk_row(number: int, ids: list, held: list, sizes: np.ndarray, data: bytes, last: bytes | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    values = [number, ids, held, np.asarray(sizes, dtype=np.int32), data, last]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["chunk", "ids", "held", "sizes", "data", "last"])


def _each(frame: DataFrame, work: Callable[[dict], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield work(batch.slice(k, 1).to_pylist()[0])
                pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)


def _answered(sent: DataFrame, answer: Callable[[int, list[list[np.ndarray]]], tuple[list[bytes], bytes]]) -> DataFrame:
    """What partitions answer: part, chunk, data; a row without chunk holds the part's sums."""

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        answers, sums = answer(part, [_unpack(b.as_py()) for b in table.column("data")])
        return pa.table({"part": pa.array([part] * (len(answers) + 1), pa.int64()), "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "data": pa.array([*answers, sums], pa.binary())})

    return saved(sent.groupBy("part").applyInArrow(meet, _SENT))


def _with_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    given = answers.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("part", "data")).alias("answers"))
    return chunks.join(given, "chunk", "left")


def _numbered(chunks: DataFrame, parts: int, texts: tuple[int, int]) -> tuple[DataFrame, _Words]:
    """Chunks with numbers for words (frequent ones small), and what is known of words."""

    def ask(row: dict) -> pa.RecordBatch:
        tokens, words = _unpack(row["data"])
        words = np.cumsum(words)
        trained = np.repeat(~np.array(row["held"]), row["sizes"])
        n, every = np.bincount(tokens, trained, len(words) + 1), np.bincount(tokens, minlength=len(words) + 1)
        return _sent(row["chunk"], [(p, _pack(_steps(words[own]), n[own].astype(np.uint32), every[own].astype(np.uint32))) for p, own in _split((words % np.uint64(parts)).astype(np.int64))])

    def answer(part: int, asked: list[list[np.ndarray]]) -> tuple[list[bytes], bytes]:
        hashes = [np.cumsum(a[0]) for a in asked]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        n, every = (np.bincount(place, np.concatenate([a[k] for a in asked]), len(words)).astype(np.int64) for k in (1, 2))
        known = np.flatnonzero(n > 0)
        known = known[np.argsort(-n[known], kind="stable")]
        number = np.zeros(len(words), dtype=np.int64)
        number[known] = WORDS + np.arange(len(known)) * parts + part
        if len(known) and number.max() > 0xFFFFFFFF:
            raise ValueError("more distinct words than 32-bit numbers")
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        return [_pack(number[p].astype(np.uint32), n[p], every[p]) for p in np.split(place, ends)], _pack(np.array([n.sum(), len(known), *((n == r).sum() for r in range(1, TOP + 2))], dtype=np.int64))

    answers = _answered(_each(chunks, ask, _SENT), answer)
    sums = [_unpack(r["data"])[0] for r in answers.where("chunk IS NULL").select("data").toLocalIterator()]
    tokens, distinct, *seen = (np.sum(sums, axis=0) if sums else np.zeros(TOP + 3, dtype=np.int64)).tolist()
    seen = np.array(seen) + (np.arange(1, TOP + 2) == texts[0])  # the end is a word too

    def number(row: dict) -> pa.RecordBatch:
        tokens, words = _unpack(row["data"])
        numbers, n, every = np.zeros(len(words) + 1, np.uint32), np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
        given = {a["part"]: a["data"] for a in row["answers"] or []}
        for p, own in _split((np.cumsum(words) % np.uint64(parts)).astype(np.int64)):
            numbers[own], n[own], every[own] = _unpack(given[p])
        numbers[-1], n[-1], every[-1] = END, *texts
        vocabulary, some = np.unique(numbers, return_index=True)
        n, every = n[some], np.where(vocabulary == UNKNOWN, 0, every[some])
        return _chunk_row(row["chunk"], row["ids"], row["held"], row["sizes"], _pack(numbers[tokens], vocabulary, n, every))

    numbered = saved(_each(_with_answers(chunks, answers), number, _CHUNK))
    _dropped(chunks, answers)
    return numbered, _Words(tokens + texts[0], distinct + (texts[0] > 0), seen)


def _sums(history: np.ndarray, total: np.ndarray, lower: np.ndarray, rows: int) -> np.ndarray:
    """By history: count; n-grams seen once to TOP times; lower probabilities of the seen ones."""
    return np.stack([np.bincount(history, total, rows), *(np.bincount(history, total == r, rows) for r in range(1, TOP + 1)), np.bincount(history, np.where(total > 0, lower, 0), rows)])


def _bounds(asked: list[list[np.ndarray]]) -> list[int | None]:
    """Histories at which ranges of some `RANGE_ENTRIES` entries end; the last has no bound."""
    ranges = -(-sum(len(a[2]) for a in asked) // RANGE_ENTRIES)
    if ranges < 2:
        return [None]
    some = np.sort(np.concatenate([np.repeat(a[0], a[1])[::16] for a in asked]))
    return [*np.unique(some[np.arange(1, ranges) * len(some) // ranges]), None]


def _answerer(discount: np.ndarray | None, words: _Words) -> Callable[[int, list[list[np.ndarray]]], tuple[list[bytes], bytes]]:
    """What answers each chunk: its n-grams' totals in training and in all; sums of its histories, in its order.

    The sum of lower probabilities is left out (0) for histories after which the chunk has only seen words.
    """

    def answer_range(asked: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        joined = [np.concatenate(x) for x in zip(*asked, strict=True)]
        names, mine, some = _distinct(joined[0])
        key, place, one = _distinct(np.repeat(mine, joined[1]).astype(np.uint64) << np.uint64(32) | joined[2])
        row = (key >> np.uint64(32)).astype(np.int64)
        n, held = (np.bincount(place, joined[k], len(key)).astype(np.int64) for k in (3, 4))
        lower = _lower(joined[5][one].astype(np.int64), joined[6][some][row], discount, words)
        cut = joined[7][some] > 1
        sums, out, at, begin = _sums(row, n, lower, len(names)), [], 0, 0
        for a in asked:
            own, p = mine[begin : begin + len(a[0])], place[at : at + len(a[2])]
            begin, at = begin + len(own), at + len(p)
            open_ = np.bincount(np.repeat(np.arange(len(own)), a[1]), n[p] == 0, len(own)) > 0
            out.append([n[p].astype(np.uint32), held[p].astype(np.uint32), *sums[: TOP + 1, own].astype(np.uint32), np.where(open_, sums[-1, own], 0)])
        return out, np.array([(n == r).sum() for r in range(1, TOP + 2)], dtype=np.int64), names[cut], sums[:, cut]

    def answer(part: int, asked: list[list[np.ndarray]]) -> tuple[list[bytes], bytes]:
        for a in asked:
            a[0] = np.cumsum(a[0])
        ends = [np.concatenate([[0], np.cumsum(a[1], dtype=np.int64)]) for a in asked]
        found, at = [], [0] * len(asked)
        for bound in _bounds(asked):
            to = [len(a[0]) if bound is None else int(np.searchsorted(a[0], bound)) for a in asked]
            found.append(answer_range([[*(x[b:t] for x in a[:2]), *(x[e[b] : e[t]] for x in a[2:6]), *(x[b:t] for x in a[6:])] for a, e, b, t in zip(asked, ends, at, to, strict=True)]))
            at = to
        out = [_pack(*map(np.concatenate, zip(*pieces, strict=True))) for pieces in zip(*(f[0] for f in found), strict=True)]
        return out, _pack(np.sum([f[1] for f in found], axis=0), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found], axis=1).ravel())

    return answer


def _dropped(*frames: DataFrame) -> None:
    """Deletes tables that `saved` wrote and nothing needs any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        for file in frame.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _raised(chunks: DataFrame, order: int, last: bool, parts: int, texts: tuple[int, int], words: _Words, below: np.ndarray | None) -> tuple[DataFrame, np.ndarray]:
    """Chunks with what is known of their n-grams of an order (of the last one, the scores), and its discounts."""
    def ask(row: dict) -> pa.RecordBatch:
        chunk, out = _Chunk(row, texts), []
        gram, lower, divisor, asked, part, cuts = _asks(chunk, order, parts)
        n = np.bincount(gram.place, chunk.trained[gram.at], len(gram.h))
        held = np.bincount(gram.place, minlength=len(gram.h)) - n
        chosen = np.flatnonzero(asked)
        for p, own in _split(part[chosen]):
            own = chosen[own]
            new = np.ones(len(own), dtype=bool)
            new[1:] = gram.h[own[1:]] != gram.h[own[:-1]]
            at = np.flatnonzero(new)
            h, size = gram.h[own[at]], np.diff(at, append=len(own))
            out.append((p, _pack(_steps(h), size.astype(np.uint32), gram.w[own], n[own].astype(np.uint32), held[own].astype(np.uint32), lower[own].astype(np.uint32), divisor[own[at]], cuts[own[at]])))
        return _sent(row["chunk"], out)

    answers = _answered(_each(chunks, ask, _SENT), _answerer(below, words))
    seen, cut = np.zeros(TOP + 1, dtype=np.int64), {}
    for r in answers.where("chunk IS NULL").select("data").toLocalIterator():
        found, names, sums = _unpack(r["data"])
        seen += found
        for name, own in zip(names.tolist(), sums.reshape(TOP + 2, -1).T, strict=True):
            cut[name] = cut.get(name, 0) + own
    whole, discount = sorted(cut), np.concatenate([[0], discounts(seen), [1]])
    known = chunks.sparkSession.sparkContext.broadcast((np.array(whole, np.uint64), np.array([cut[h] for h in whole]).reshape(-1, TOP + 2)))

    def answered(row: dict) -> pa.RecordBatch:
        whole, whole_sums = known.value
        chunk = _Chunk(row, texts)
        gram, lower, divisor, asked, part, _ = _asks(chunk, order, parts)
        n, held = np.zeros(len(gram.h), np.int64), np.zeros(len(gram.h), np.int64)
        kept, left = np.full(len(gram.h), 2, np.int64), np.ones(len(gram.h))  # divisors of seen n-grams; what is left for each unit below
        given, chosen = {a["part"]: a["data"] for a in row["answers"] or []}, np.flatnonzero(asked)
        for p, own in _split(part[chosen]):
            own = chosen[own]
            n[own], held[own], *of_history = _unpack(given[p])
            new = np.zeros(len(own), dtype=np.int64)
            new[1:] = gram.h[own[1:]] != gram.h[own[:-1]]
            sums = np.stack(of_history)  # one column a history
            if len(whole):
                names = gram.h[own[np.concatenate([[True], new[1:] > 0])]]
                at = np.minimum(np.searchsorted(whole, names), len(whole) - 1)
                same = whole[at] == names
                sums[:, same] = whole_sums[at[same]].T
            count = np.maximum(sums[0], 1)
            taken = 1 - ((1 - discount[1 : TOP + 1]) * np.arange(1, TOP + 1)) @ sums[1 : TOP + 1] / count
            bare = 1 - taken < 1e-9  # all n-grams are frequent: one more count goes to the unseen
            at = np.cumsum(new)
            kept[own] = (count + bare).astype(np.int64)[at]
            left[own] = ((1 - np.where(bare, count / (count + 1), 1) * taken) / np.maximum(1 - sums[-1], 1e-12))[at]
        lower = _lower(lower, divisor, below, words)
        if below is not None:
            pair = gram.lower[gram.at[gram.some]]
            lower = np.where(chunk.c[pair] > 0, lower, chunk.p[pair])
        p = np.where(n > 0, _lower(n, kept, discount, words), left * lower)
        p = np.where(asked, p, lower)
        if not last:
            return _chunk_row(row["chunk"], row["ids"], row["held"], row["sizes"], row["data"], _pack(n.astype(np.uint32), n + held, kept, np.where(n > 0, 0, p)))
        token = np.empty(len(chunk.tokens))
        if below is not None:  # a text's first token has no longer history
            heads = chunk.first[:-1]
            pair = gram.lower[heads]
            token[heads] = np.where(chunk.c[pair] > 0, _lower(chunk.c[pair].astype(np.int64), chunk.divisor[pair], below, words), chunk.p[pair])
        token[gram.at] = p[gram.place]
        add = lambda x: np.add.reduceat(x, chunk.first[:-1])
        base = np.log10((chunk.counts + 1) / words.base)
        return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(chunk.sizes.astype(np.int64)), pa.array(add((chunk.counts > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(token)))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    joined = _with_answers(chunks, answers)
    if last:
        return _each(joined, answered, _SCORE), discount
    raised = saved(_each(joined, answered, _CHUNK))
    _dropped(chunks, answers)
    return raised, discount


_SCORE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def scored(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """Scores of all texts by words (2) or pairs of words (3) before each: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    One row for each row of documents.  Null and empty texts are one end.  Without training texts every word
    is unknown and the model is the base's.  Other columns are ignored, whatever their names.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    source = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id)).alias("held"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chunks = saved(_chunks(source))
    size = chunks.agg(F.sum(F.size(F.filter("held", lambda x: ~x))), F.sum(F.size("held")), F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()
    texts, parts = (size[0] or 0, size[1] or 0), -(-(size[2] or 1) // PART_ENTRIES)
    chunks, words = _numbered(chunks, parts, texts)
    discount = None
    for n in range(2, order + 1):
        chunks, discount = _raised(chunks, n, n == order, parts, texts, words, discount)
    return chunks.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op5_katz(documents: DataFrame) -> DataFrame:
    """The result of `scored` over all documents, by pairs of words before each."""
    return scored(documents)
