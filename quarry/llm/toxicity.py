"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: case, look-alike letters of other scripts, full-width forms, digits and signs that
stand in for letters, and invisible characters.  The lexicon (whole words and word beginnings, written
`stem*`) and its weights (log ratio of a term's rate in toxic and in other texts) come from labelled
rows.  Phrases of two words that hold a lexicon term but are no more common in toxic texts than elsewhere
become exceptions: a match inside one does not count.  A text's evidence is the sum of its matches' weights,
as it is and by its length in words; a logistic curve fitted on labelled rows turns both into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._work import MaybeAmong, saved
from quarry.llm.quality import held_out

#: Bounds of what the driver and tasks hold of the lexicon, and of rows that fit the curve.
CANDIDATES, TERMS, EXCEPTIONS, CURVE_ROWS = 50_000, 5_000, 5_000, 20_000

# fixed values: look-alikes of Latin letters in Cyrillic and Greek, and digits and signs that stand for letters
HOMOGLYPHS = dict(zip("абсԁеһіјӏкмнорԛѕтухѵԝαβεικνορτυχ", "abcdehijlkmhopqstyxvwabeiknoptux", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    table |= {c: chr(c).lower() for c in range(65, 91)}
    table |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
    for glyph, letter in HOMOGLYPHS.items():
        table[ord(glyph)] = table[ord(glyph.upper()[0])] = letter
    table |= {ord(digit): letter for digit, letter in DIGITS.items()} | {ord("l"): "i", ord("L"): "i", 0xFF2C: "i", 0xFF4C: "i", ord("ӏ"): "i"}
    return table | {ord(c): None for c in INVISIBLE} | {c: " " for c in (0xA0, 0x85, *range(0x2000, 0x200B), *range(0x2010, 0x2030), 0x3000)}


FOLD = _table()


def folded(text: str | None) -> str:
    """Words of a folded text, with one space before and after each (l and i fold together, as 1 does for both)."""
    return f" {' '.join((text or '').translate(FOLD).lower().split())} "


def _terms(words: set[str]) -> set[str]:
    """A text's candidate terms: its words, and beginnings of 4 to 8 letters of longer words."""
    return {w for w in words if len(w) > 2} | {w[:k] + "*" for w in words for k in range(4, min(len(w), 9))}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def matcher(self) -> Callable[[str], list[tuple[int, int, float]]]:
        """A function that finds (start, end, weight) of matched words of a folded text; one match a word, the heaviest."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            key = " " + (term[:-1] if term.endswith("*") else term + " ")
            automaton.add_word(key, (len(key), weight))
        if self.weights:
            automaton.make_automaton()

        def find(text: str) -> list[tuple[int, int, float]]:
            best: dict[int, float] = {}
            for end, (length, weight) in automaton.iter(text) if self.weights else ():
                start = end - length + 2
                best[start] = max(weight, best.get(start, 0.0))
            found = []
            for start, weight in best.items():
                stop = text.index(" ", start)
                if self.exceptions and not self.exceptions.isdisjoint(phrases(text, start, stop)):
                    continue
                found.append((start, stop, weight))
            return found

        return find


def phrases(text: str, start: int, stop: int) -> list[str]:
    """The word at a place of a folded text with the word before it and with the one after."""
    before, after = text.rfind(" ", 0, max(0, start - 1)), text.find(" ", stop + 1)
    return [text[before + 1 : stop]] * (before >= 0 and start > 1) + [text[start:after]] * (after > 0)


def evidence(text: str, find: Callable[[str], list[tuple[int, int, float]]]) -> tuple[float, float]:
    """Summed weight (damped) and weight by 100 words."""
    total = sum(weight for _, _, weight in find(text))
    return math.log1p(total), math.log1p(100 * total / max(1, text.count(" ") - 1))


def _labelled(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Texts of labelled rows outside the held-out part: y, text, k (a hash of id and text).

    Other texts are mostly left out before the join, which is by shuffle at every size.
    """
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).alias("y"))
    given = saved(given)
    among = MaybeAmong(given.select(F.xxhash64("doc_id")))
    texts = documents.select("doc_id", F.xxhash64("doc_id").alias("mark"), F.col("text").cast("string").alias("text"))
    return texts.where(among.passes("mark")).join(given.hint("merge"), "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("k"))


def _counts(rows: DataFrame, begin: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    """In how many toxic and other texts each term stands: term, toxic, other; begin makes a task's function."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        texts, of = [0, 0], begin()

        def flush() -> pa.RecordBatch:
            terms = list(found[0].keys() | found[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array([None, *terms], pa.string()), pa.array([texts[1], *(found[1][t] for t in terms)], pa.int64()), pa.array([texts[0], *(found[0][t] for t in terms)], pa.int64())], names=["term", "toxic", "other"])
            found[0].clear(), found[1].clear()
            texts[:] = 0, 0
            return batch

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(of(folded(text)))
                texts[y] += 1
                if len(found[0]) + len(found[1]) > 500_000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(count, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _weight(toxic: int, other: int, all_toxic: int, all_other: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((other + 0.5) / (all_other + 1))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 0.01 * np.eye(len(w))
        w += np.linalg.solve(hessian, design.T @ (y - p) - 0.01 * w)
    return tuple(map(float, w))


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", least_weight: float = 2.0, least_share: float = 0.005) -> Lexicon:
    """Learns terms, weights, exceptions and the curve from labelled rows outside the held-out part.

    Counts cover all labelled rows; candidates stand in at least `least_share` of toxic texts (5 texts at least), and
    at most CANDIDATES of them, most common first, are weighed.  The curve is fitted on at most CURVE_ROWS rows.
    """
    rows = saved(_labelled(documents, labels, label))  # its join moves texts, so once
    spark = documents.sparkSession
    first = _counts(rows.where("y"), lambda: lambda text: _terms(set(text.split())))
    total = first.where("term IS NULL").agg(F.sum("toxic")).first()[0] or 0
    least = max(5, math.ceil(least_share * total))
    candidates = {r["term"] for r in first.where(F.col("term").isNotNull() & (F.col("toxic") >= least)).orderBy(F.desc("toxic"), "term").limit(CANDIDATES).collect()}
    if not candidates:
        share = rows.agg(F.avg(F.col("y").cast("double"))).first()[0]
        share = min(max(share if share is not None else 0.0, 1e-3), 1 - 1e-3)
        return Lexicon({}, curve=(math.log(share / (1 - share)), 0.0, 0.0))
    held = spark.sparkContext.broadcast(candidates)
    both = _counts(rows, lambda: lambda text: _terms(set(text.split())) & held.value).collect()
    toxic, other = sum(r["toxic"] for r in both if r["term"] is None), sum(r["other"] for r in both if r["term"] is None)
    weighed = {r["term"]: _weight(r["toxic"], r["other"], toxic, other) for r in both if r["term"] is not None}
    support = {r["term"]: r["toxic"] for r in both if r["term"] is not None}
    terms = sorted((t for t, w in weighed.items() if w >= least_weight), key=lambda t: (-weighed[t] * support[t], t))[:TERMS]
    lexicon = Lexicon({t: weighed[t] for t in terms})
    sent = spark.sparkContext.broadcast(lexicon)

    def around() -> Callable[[str], set[str]]:
        find = sent.value.matcher()
        return lambda text: {phrase for start, stop, _ in find(text) for phrase in phrases(text, start, stop)}

    near = _counts(rows, around).where(F.col("term").isNotNull() & (F.col("other") >= 5)).orderBy(F.desc("other"), "term").limit(EXCEPTIONS).collect()
    lexicon = Lexicon(lexicon.weights, {r["term"] for r in near if _weight(r["toxic"], r["other"], toxic, other) <= 0})
    # hashes are ordered first, and only the texts of the smallest are looked at, where they are; repeated rows count once
    last = rows.select("k").distinct().orderBy("k").limit(CURVE_ROWS).agg(F.max("k")).first()[0]
    sample = rows.where(F.col("k") <= last).select(F.struct("k", "y").alias("row"), "text")
    found = _evidence(sample, lexicon, "row").dropDuplicates(["row"]).select("row.y", "row.k", "total", "density").toPandas().sort_values("k")
    return Lexicon(lexicon.weights, lexicon.exceptions, _curve(found[["total", "density"]].to_numpy(), found["y"].to_numpy(dtype=np.float64)))


def _evidence(rows: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value.matcher()
        for batch in batches:
            found = [evidence(folded(text), find) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64())], names=[key, "total", "density"])

    return rows.mapInArrow(weigh, f"{key} {rows.schema[key].dataType.simpleString()}, total double, density double")


def scored(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Toxicity of every document: doc_id, score (0 to 1).  Null texts count as empty."""
    w = lexicon.curve
    rows = _evidence(documents.select("doc_id", F.col("text").cast("string").alias("text")), lexicon, "doc_id")
    return rows.select("doc_id", (1 / (1 + F.exp(-(F.lit(w[0]) + F.lit(w[1]) * F.col("total") + F.lit(w[2]) * F.col("density"))))).alias("score"))


def op7_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    One row for each row of documents; null and empty texts hold no terms; null ids are held out.  Several labels
    of a document are averaged, null ones ignored; without toxic labels the score is the share of them.
    """
    found = scored(documents, learn(documents, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
