"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard similarity, components.

Two kinds of units are compared.  A paragraph is a line of at least `PARAGRAPH` words.  A passage is a piece of the whole
text between cuts that the words themselves decide: a text is cut before each three-word run whose hash is the smallest
within `REACH` words on both sides, whatever its lines are.  So what is repeated inside different texts is cut alike in
both, but for some words at its ends.  A unit's set: distinct shingles of `WIDTH` words (A-Z lower-cased, words between
ASCII white space).  Bands of minwise values are tuned for recall, candidates are confirmed on full sets, and of each
component of like units the first stays: that of the smallest (doc_id, place).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import _text
from quarry.llm._work import MaybeAmong, saved
from quarry.llm.linking import VALUES, Sets, band_keys, linked_components, sets_of_items, shared_buckets, sketch_bits

#: Words of a shingle; percent of similarity; least words of a paragraph; words on both sides that decide on a cut; least
#: words of neighbouring repeated passages together.
WIDTH, PERCENT, PARAGRAPH, REACH, SPAN = 5, 80, 40, 5, 30
#: Bands and minwise values of each, for paragraphs (a pair at 0.8 shares a band with a chance of 0.9998) and for
#: passages (0.986; a repeated text has several).
BANDS = {"paragraph": (16, 4), "passage": (6, 3)}
KINDS = tuple(BANDS)

_SEEDS = {kind: _text.seeds(bands * rows, salt=4 + k).astype(np.uint32) for k, (kind, (bands, rows)) in enumerate(BANDS.items())}
_SKETCH_SEEDS = _text.seeds(VALUES, salt=104).astype(np.uint32)


def _cuts(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words before which texts are cut, in order, the first word of each text among them.  first: where texts begin."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = _text.sequence_hashes(words, 3)
    # texts lie apart by REACH places that never are the smallest, as are runs that would leave their text
    spread = np.full(len(words) + REACH * (len(counts) + 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    place = np.arange(len(words)) + REACH * (owner + 1)
    inside = np.flatnonzero(np.arange(len(words)) + 3 <= first[owner + 1])
    spread[place[inside]] = order[inside]
    least = np.ones(len(inside), dtype=bool)
    at = place[inside]
    for k in range(1, REACH + 1):
        least &= (spread[at] < spread[at - k]) & (spread[at] <= spread[np.minimum(at + k, len(spread) - 1)])
    return np.union1d(inside[least], first[:-1][counts > 0])


class _Units:
    """Units of a slice: kind (an index of KINDS), text, number in the text, first word, words, and id of the content."""

    def __init__(self, texts: _text.Texts):
        word_starts, word_stops, first = texts.spans(_text.NOT_SPACE)
        words = texts.hashes(word_starts, word_stops)
        self.shingles = _text.sequence_hashes(words, WIDTH)
        starts, stops, of_text = texts.lines()
        begin, end = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, stops)
        cuts = _cuts(words, first)
        ends = np.append(cuts[1:], len(words)) if len(cuts) else cuts
        found = []
        for kind, b, e, owner, least in ((0, begin, end, np.repeat(np.arange(len(texts)), np.diff(of_text)), PARAGRAPH), (1, cuts, ends, np.searchsorted(first, cuts, side="right") - 1, WIDTH)):
            long = e - b >= least
            b, e, owner = b[long], e[long], owner[long]
            number = np.arange(len(b)) - np.searchsorted(owner, owner)
            ids = texts.hashes(word_starts[b], word_stops[e - 1]) if not kind else _text.mix(_runs(words, b, e))
            found.append((np.full(len(b), kind, np.int8), owner, number.astype(np.int32), b, (b - first[owner]).astype(np.int32), (e - b).astype(np.int32), (ids ^ np.uint64(kind)).view(np.int64)))
        self.kind, self.owner, self.number, self.begin, self.place, self.words, self.ids = map(np.concatenate, zip(*found, strict=True))

    def distinct(self) -> np.ndarray:
        return np.unique(self.ids, return_index=True)[1]

    def minwise(self, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return _text.minwise(self.shingles, self.begin[at], self.words[at] - WIDTH + 1, seeds)

    def items(self, k: int) -> np.ndarray:
        return np.unique(self.shingles[self.begin[k] : self.begin[k] + self.words[k] - WIDTH + 1]).view(np.int64)


def _runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words, whatever white space is between them."""
    power = np.multiply.accumulate(np.full(max(1, int((end - begin).max(initial=1))), 0x9E3779B97F4A7C15, dtype=np.uint64))
    sizes = end - begin
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    scaled = words[np.repeat(begin, sizes) + at] * power[at]
    return np.add.reduceat(scaled, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) if len(sizes) else np.zeros(0, np.uint64)


def _buckets(source: DataFrame) -> DataFrame:
    """Buckets of contents: key, id."""

    def signatures(texts: _text.Texts) -> tuple[np.ndarray, np.ndarray]:
        units = _Units(texts)
        distinct, keys, ids = units.distinct(), [], []
        for k, kind in enumerate(KINDS):
            at = distinct[units.kind[distinct] == k]
            bands = band_keys(units.minwise(at, _SEEDS[kind]), BANDS[kind][1], salt=k)
            keys.append(bands.ravel())
            ids.append(np.repeat(units.ids[at], bands.shape[1]))
        return np.concatenate(keys), np.concatenate(ids)

    return shared_buckets(source, signatures)


def _places(source: DataFrame) -> DataFrame:
    """Every unit: doc_id, kind, number, begin, n_words, id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _text.slices(batch.column(1)):
                units = _Units(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(units.owner + row)), *map(pa.array, (units.kind, units.number, units.place, units.words, units.ids))], names=["doc_id", "kind", "number", "begin", "n_words", "id"])

    return source.mapInArrow(cut, "doc_id bigint, kind tinyint, number int, begin int, n_words int, id bigint")


def _sets(source: DataFrame, ids: DataFrame, percent: int) -> Sets:
    wanted = MaybeAmong(ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _text.slices(batch.column(1)):
                units = _Units(texts)
                at = units.distinct()
                at = at[wanted.mask(units.ids[at])]
                items = [units.items(k) for k in at]
                bits = sketch_bits(units.minwise(at, _SKETCH_SEEDS))
                yield pa.RecordBatch.from_arrays([pa.array(units.ids[at]), pa.array(list(map(len, items)), pa.int64()), *map(pa.array, bits), _text.list_column(items, pa.int64())], names=["id", "n", "b1", "b2", "items"])

    made = source.mapInArrow(cut, "id bigint, n bigint, b1 bigint, b2 bigint, items array<bigint>")
    return sets_of_items(saved(made.join(ids, "id", "left_semi").dropDuplicates(["id"])), percent)


def repeated_units(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, span: int = SPAN, across: bool = False) -> DataFrame:
    """Every unit that has others like it: doc_id, kind (paragraph or passage), number (of its kind in the text, from 0),
    begin (first word, from 0), n_words, span_words, keeper_doc_id, keeper_begin, kept.

    Units of a kind are linked if 100 * shared >= percent * union of their shingle sets.  span_words counts the words of
    a passage and of its repeated neighbours; passages count from `span` such words on.  With across, units that repeat
    inside one document alone are left out.  Null and empty texts have no units; rows without a doc_id are left alone; rows that share one share numbers, and count as one text.
    """
    source = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    components = linked_components(_buckets(source), lambda ids: _sets(source, ids, percent), percent)
    places = saved(_places(source))
    firsts = places.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "begin")).alias("first"), F.max("doc_id").alias("last"))
    named = firsts.join(components, "id", "left").where("component IS NOT NULL OR n > 1")
    named = saved(named.select("id", "first", "last", F.coalesce("component", "id").alias("component")))
    groups = named.groupBy("component").agg(F.min("first").alias("keeper"), F.max("last").alias("last"))
    groups = groups.where("keeper.doc_id < last") if across else groups
    found = places.join(named.join(groups, "component").select("id", "keeper"), "id")
    by_text = Window.partitionBy("doc_id", "kind")
    runs = found.withColumn("run", F.col("number") - F.dense_rank().over(by_text.orderBy("number")))
    spans = runs.withColumn("span_words", F.when(F.col("kind") == 1, F.sum("n_words").over(Window.partitionBy("doc_id", "kind", "run"))).otherwise(F.col("n_words")))
    kind = F.element_at(F.lit(list(KINDS)), F.col("kind") + 1)
    kept = F.struct("doc_id", "begin") == F.col("keeper")
    return spans.where((F.col("kind") == 0) | (F.col("span_words") >= span)).select("doc_id", kind.alias("kind"), "number", "begin", "n_words", "span_words", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.begin").alias("keeper_begin"), kept.alias("kept"))


def without_units(documents: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the words of some units (doc_id, begin, n_words); other rows and columns stay as they are.

    What stands between removed words goes with them; null texts and rows without a doc_id stay.
    """
    cuts = removed.groupBy(F.col("doc_id").alias("removed_from")).agg(F.collect_set(F.struct("begin", "n_words")).alias("removed_units"))
    joined = documents.join(cuts, F.col(doc_id) == F.col("removed_from"), "left")

    @F.arrow_udf("string")
    def rest(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for row, whole in _text.slices(texts, lower=False):
            starts, stops, first = whole.spans(_text.NOT_SPACE)
            for k in range(len(whole)):
                stay = np.ones(whole.bounds[k + 1] - whole.bounds[k], dtype=bool)
                for unit in removed[row + k].as_py() or ():
                    a, b = first[k] + unit["begin"], min(first[k] + unit["begin"] + unit["n_words"], first[k + 1])
                    if a < b:
                        stay[starts[a] - whole.bounds[k] : (starts[b] if b < first[k + 1] else stops[b - 1]) - whole.bounds[k]] = False
                out.append(whole.data[whole.bounds[k] : whole.bounds[k + 1]][stay].tobytes().decode())
        return pa.array(out, pa.string())

    changed = F.when(F.col("removed_units").isNull() | F.col(text).isNull(), F.col(text)).otherwise(rest(text, "removed_units"))
    return joined.withColumn(text, changed).drop("removed_from", "removed_units")


def op4_paragraph_dedup(documents: DataFrame) -> DataFrame:
    """What documents share: the result of `repeated_units` across documents; those without such units don't appear."""
    return repeated_units(documents, across=True)
