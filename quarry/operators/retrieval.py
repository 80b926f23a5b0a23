"""Retrieval over chunks (chunk_id, document_id, text and attributes): lexical, dense, fused, filtered, reranked.

Branches are chunk_id and score.  A query's terms and vector are small and given by the caller; statistics of the
corpus are one row, so scoring has no shuffle until the top k; with an index, only the postings of its terms are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numeric import Constraint, numeric_predicate
from quarry.functions.terms import term_words
from quarry.functions.text import SEPARATORS, words
from quarry.sources.shared import saved

# fixed values: public constants of BM25, and weights of fusion
K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K, DENSE_WEIGHT, ORIGINAL_WEIGHT, EXPANDED_WEIGHT = 60, 1.0, 1.35, 0.75
FUSED_WEIGHT, RERANK_WEIGHT = 0.35, 0.65


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows by score; ties by chunk_id."""
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def term_counts(chunks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Of each chunk: chunk_id, n (words), tf (an array: how often it has each term).  One split of each text.

    A term of several words, such as `heap-leaching`, counts where they stand side by side.
    """
    pieces = chunks.select("chunk_id", F.split(F.lower("text"), SEPARATORS).alias("pieces"))
    # a split leaves an empty piece where separators begin or end a text
    empty = F.size("pieces") - F.size(F.array_remove("pieces", ""))
    tf = F.array(*(_often("pieces", term_words(t)) for t in terms)).cast("array<int>")
    return pieces.select("chunk_id", (F.size("pieces") - empty).alias("n"), tf.alias("tf"))


def saved_counts(chunks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """`term_counts`, written once: statistics and scores both read them."""
    return saved(term_counts(chunks, terms))


def _often(pieces: str, term: Sequence[str]) -> Column:
    """How often a term's words stand side by side among pieces."""
    if len(term) < 2:
        return F.size(pieces) - F.size(F.array_remove(pieces, term[0])) if term else F.lit(0)
    # texts without all of the words are told apart first; empty pieces stand at ends alone
    all_there = F.lit(True)
    for word in term:
        all_there = all_there & F.array_contains(pieces, word)
    places = F.sequence(F.lit(0), F.size(pieces) - 1)

    def here(place: Column) -> Column:
        found = F.lit(True)
        for k, word in enumerate(term):
            found = found & F.get(F.col(pieces), place + k).eqNullSafe(word)
        return found

    return F.when(all_there, F.size(F.filter(places, here))).otherwise(0)


def _idf(docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.log((docs - df + 0.5) / (df + 0.5)))


def _gain(tf: Column, n: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def bm25(counts: DataFrame, places: Sequence[int], k: int, corpus: tuple[int, int] | None = None) -> DataFrame:
    """The k chunks of highest BM25 score for some of the terms that were counted (by place): chunk_id, score (6 digits)."""
    return top(bm25_scores(counts, places, corpus), k)


def bm25_scores(counts: DataFrame, places: Sequence[int], corpus: tuple[int, int] | None = None) -> DataFrame:
    """The BM25 score of every chunk that has a term: chunk_id, score (6 digits).

    The corpus' statistics are one row, joined to every chunk; its numbers of chunks and words are given where counts are
    only of chunks that have a term.  counts are used twice: save them first.
    """
    width = max(places, default=-1) + 1
    has = [F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"d{i}") for i in range(width)]
    docs, mean = (F.count("*"), F.avg("n")) if corpus is None else (F.lit(corpus[0]), F.lit(corpus[1] / max(1, corpus[0])))
    stats = counts.agg(docs.alias("docs"), mean.alias("mean"), *has)
    score = F.lit(0.0)
    for i in places:
        score = score + _idf(F.col("docs"), F.col(f"d{i}")) * _gain(F.get("tf", F.lit(i)), F.col("n"), F.col("mean"))
    some = counts.where(F.exists("tf", lambda x: x > 0))
    return some.join(F.broadcast(stats)).select("chunk_id", F.round(score, 6).alias("score")).where("score > 0")  # one row


def bm25_from_index(index: DataFrame, terms: DataFrame, corpus: DataFrame, asked: Sequence[str], k: int) -> DataFrame:
    """The same from the tables of an index: postings (of which only the asked terms' are read), df of terms, one row of
    docs and mean."""
    wanted = F.col("term").isin(list(asked))
    weighted = terms.where(wanted).join(F.broadcast(corpus)).select("term", _idf(F.col("docs"), F.col("df")).alias("idf"), "mean")
    hits = index.where(wanted).join(weighted, "term")
    score = F.round(F.sum(F.col("idf") * _gain(F.col("tf"), F.col("n"), F.col("mean"))), 6)
    return top(hits.groupBy("chunk_id").agg(score.alias("score")).where("score > 0"), k)


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: docs (chunks) and mean (their words)."""
    counts = term_counts(chunks, [])
    return counts.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))


def term_statistics(chunks: DataFrame) -> DataFrame:
    """Document frequency of every word: term, df."""
    return chunks.select(F.explode(F.array_distinct(words("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(chunks: DataFrame) -> DataFrame:
    """The lexical index: term, chunk_id, tf, n (words of the chunk)."""
    own = chunks.select("chunk_id", words("text").alias("words"))
    return own.select("chunk_id", F.size("words").alias("n"), F.explode("words").alias("term")).groupBy("term", "chunk_id", "n").agg(F.count("*").alias("tf"))


def overlay_lexical(chunks: DataFrame, query: str, terms: Sequence[str], k: int) -> DataFrame:
    """Counts of terms in texts: 1 and .15 for each of up to 8 occurrences of a term, 4 for the whole query."""
    text = F.lower("text")
    score = F.when(F.contains(text, F.lit(query.lower())), 4.0).otherwise(0.0)
    for t in terms:
        n = (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)
        score = score + F.when(n > 0, 1 + 0.15 * F.least(n, F.lit(8.0))).otherwise(0.0)
    return top(chunks.select("chunk_id", F.round(score, 6).alias("score")).where("score > 0"), k)


def dot(vector: Column | str, query: Sequence[float]) -> Column:
    asked = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, asked, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k vectors (chunk_id, vector) of largest inner product with the query's: chunk_id, score."""
    return top(vectors.where(F.size("vector") == len(query)).select("chunk_id", F.round(dot("vector", query), 6).alias("score")), k)


def fuse(branches: Sequence[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of branches (each a top k): chunk_id, score."""
    ranked = [b.select("chunk_id", (F.lit(w) / (k + F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))).alias("part")) for b, w in branches]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.groupBy("chunk_id").agg(F.round(F.sum("part"), 8).alias("score"))


def capped(hits: DataFrame, key: str, each: int = 2, pool: int = 50) -> DataFrame:
    """At most `each` hits of a key (a document), then the first `pool`."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "chunk_id"))
    return top(hits.withColumn("place", place).where(F.col("place") <= each).drop("place"), pool)


def overlap(text: Column | str, terms: Sequence[str]) -> Column:
    """An offline reranker: how many of the terms a text holds."""
    return F.size(F.array_intersect(words(text), F.array(*map(F.lit, terms))))


def rerank(hits: DataFrame, logit: Column, k: int = RRF_K) -> DataFrame:
    """Fuses a pool's ranks by score and by a reranker's logit: chunk_id, score, final_score."""
    by = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "chunk_id"))  # noqa: E731  a pool, bounded by its limit
    placed = hits.withColumn("logit", logit).withColumn("r1", by("score")).withColumn("r2", by("logit"))
    final = F.round(FUSED_WEIGHT / (k + F.col("r1")) + RERANK_WEIGHT / (k + F.col("r2")), 8)
    return placed.select(*hits.columns, final.alias("final_score"))


def dense_overlay(base: DataFrame, overlay: DataFrame, query: Sequence[float], k: int, overlay_k: int) -> DataFrame:
    """Nearest vectors of a base and of an overlay, each with a number of its own; a chunk in both counts with its overlay."""
    newer = dense(overlay, query, overlay_k)
    older = dense(base.join(overlay.select("chunk_id"), "chunk_id", "left_anti"), query, k)
    return older.unionByName(newer)


def widened(k: int, strict: bool, factor: int = 10) -> int:
    """How many hits a branch gives where later filters (years, source types, values) will drop many."""
    return k * factor if strict else k


def in_years(year: Column | str, first: int | None, last: int | None) -> Column:
    """Whether a year, given as a number or text, lies in a range; unknown ones and those outside 1900 to 2100 don't."""
    number = (F.col(year) if isinstance(year, str) else year).cast("string").try_cast("int")
    return F.coalesce(number.between(max(1900, first or 1900), min(2100, last or 2100)), F.lit(False))


def meeting_all(candidates: DataFrame, values: DataFrame, overlay: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """Candidate chunks with a value for each constraint: of the base by ranges, of the overlay by points.

    values and overlay: chunk_id, parameter, value, value_min, value_max, unit.  One aggregate over both.
    """
    if not constraints:
        return candidates

    def met(rows: DataFrame, mode: str) -> DataFrame:
        each = [(F.col("parameter") == c.parameter) & numeric_predicate(c, mode) & (F.lit(True) if c.unit is None else F.col("unit") == c.unit) for c in constraints]
        flags = rows.select("chunk_id", *(F.coalesce(e, F.lit(False)).alias(f"met{k}") for k, e in enumerate(each)))
        return flags.where(" OR ".join(f"met{k}" for k in range(len(each))))

    both = met(values, "range").unionByName(met(overlay, "point"))
    whole = both.groupBy("chunk_id").agg(*(F.max(f"met{k}").alias(f"met{k}") for k in range(len(constraints))))
    return candidates.join(whole.where(" AND ".join(f"met{k}" for k in range(len(constraints)))).select("chunk_id"), "chunk_id", "left_semi")


def classes_first(hits: DataFrame, classes: Sequence[tuple[Column, int]]) -> DataFrame:
    """A pool's hits in a new order (place, from 1): of each class in turn the first few, then all others by score.

    classes: a condition and how many of its hits go first; a hit is of the first class whose condition it meets.
    """
    kind = F.lit(len(classes))
    for number, (condition, _) in reversed(list(enumerate(classes))):
        kind = F.when(condition, number).otherwise(kind)
    sorted_in = F.row_number().over(Window.partitionBy("_kind").orderBy(F.desc("score"), "chunk_id"))
    placed = hits.withColumn("_kind", kind).withColumn("_in", sorted_in)
    ahead = F.lit(False)
    for number, (_, most) in enumerate(classes):
        ahead = ahead | ((F.col("_kind") == number) & (F.col("_in") <= most))
    order = [F.when(ahead, F.col("_kind")).otherwise(len(classes)), F.desc("score"), F.col("chunk_id")]
    return placed.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("_kind", "_in")


def eligible(hits: DataFrame, chunks: DataFrame, condition: Column) -> DataFrame:
    """Hits with their chunks' attributes, of chunks that meet a condition (after ranking, as filters are)."""
    return hits.join(chunks.where(condition), "chunk_id")


def surfaced(hits: DataFrame, known: DataFrame, key: str = "document_id") -> DataFrame:
    """The best hit of each document that isn't among known ones."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "chunk_id"))
    return hits.join(known.select(key).distinct(), key, "left_anti").withColumn("place", best).where("place = 1").drop("place")
