"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Every text gives a vector of transformed statistics.  For each cell (a language and source with enough documents, else
what is left of the language, else what is left of all) the estimate starts from the best of many small subsets of a
bounded sample, as FAST-MCD does, and is then improved on all documents: a concentration step takes the half that is
nearest by Mahalanobis distance and estimates anew, until no cell's determinant falls.  A last step reweights by the
documents within the 0.975 quantile.  Documents far beyond are rejected.

A step is one partial aggregate of moments by cell and bin of distance, so a cell of any size is spread over tasks and
only its bins meet.  Equal vectors of a cell count once: a family of copies is one opinion.  Variances have floors
(as in regularised estimates), since a statistic may be equal in more than half of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text
from quarry.llm._work import saved

#: Fewest distinct vectors that a cell's estimate is made of; about how many of a cell the first estimate looks at.
LEAST, SAMPLE = 100, 500
#: Small subsets tried for the first estimate; concentration steps at most; bins of distance by factor of two.
STARTS, STEPS, BINS = 40, 20, 16
#: Shares of a normal cell: what an estimate is made of, what reweights it, what is kept at least.
HALF, REWEIGHT, KEEP = 0.5, 0.975, 0.9999

# fixed values: symbols that are counted, and the base rules
SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS, MOST_REPEATED = 50, 50

#: Transformed statistics, and the least deviation that an estimate may give each.
TRANSFORMS = {
    "ln(word_chars / n_words)": 0.15,
    "ln(1 + 100 * n_symbols / n_words)": 0.5,
    "sqrt(n_dup_lines / n_lines)": 0.25,
    "sqrt(n_repeat_words / n_words)": 0.2,
}
SIZE = len(TRANSFORMS)
FLOOR = np.array(list(TRANSFORMS.values()))
_X, _MEAN = [f"x{i}" for i in range(SIZE)], [f"m{i}" for i in range(SIZE)]
_BELOW = [(i, j) for i in range(SIZE) for j in range(i + 1)]
_ROOT, _SUM, _SQUARE = [f"w{i}_{j}" for i, j in _BELOW], [f"s{i}" for i in range(SIZE)], [f"q{i}_{j}" for i, j in _BELOW]
_ESTIMATE = "cell string, " + ", ".join(f"{c} double" for c in [*_MEAN, *_ROOT, "logdet"])


def within(x: float, degrees: int) -> float:
    """The share of chi-squared values of so many degrees of freedom that are at most x."""
    if x <= 0:
        return 0.0
    half, term, total, k = degrees / 2, 1.0, 1.0, 0
    while term > 1e-16 * total:
        k += 1
        term *= x / 2 / (half + k)
        total += term
    return min(1.0, math.exp(half * math.log(x / 2) - x / 2 - math.lgamma(half + 1)) * total)


def quantile(share: float, degrees: int) -> float:
    """The value that this share of chi-squared values doesn't exceed."""
    low, high = 0.0, 1.0
    while within(high, degrees) < share:
        high *= 2
    for _ in range(100):
        low, high = (middle, high) if within(middle := (low + high) / 2, degrees) < share else (low, middle)
    return high


def widened(share: float) -> float:
    """By how much the covariance of the nearest share of normal vectors is too small."""
    share = min(max(share, 0.01), 1 - 1e-9)
    return share / within(quantile(share, SIZE), SIZE + 2)


def estimate(mean: np.ndarray, scatter: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse root and log determinant of what the nearest share of vectors gives."""
    root = np.linalg.cholesky(scatter * widened(share) + np.diag(FLOOR**2))
    return mean, np.linalg.inv(root), 2 * float(np.log(np.diag(root)).sum())


def first_estimate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The best of many estimates that each start from a few vectors and concentrate."""
    rng, x = np.random.default_rng(1), x[np.lexsort(x.T)]
    half = min(len(x), (len(x) + SIZE + 1) // 2)

    def concentrated(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        mean = of.mean(axis=0)
        return estimate(mean, (of - mean).T @ (of - mean) / len(of), len(of) / len(x) if len(of) >= half else HALF)

    def nearest(found: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
        return x[np.argsort((((x - found[0]) @ found[1].T) ** 2).sum(axis=1), kind="stable")[:half]]

    tried = []
    for _ in range(STARTS):
        found = concentrated(x[rng.choice(len(x), size=min(len(x), SIZE + 1), replace=False)])
        for _ in range(2):
            found = concentrated(nearest(found))
        tried.append(found)
    best = None
    for found in sorted(tried, key=lambda f: f[2])[:5]:
        for _ in range(STEPS):
            then, found = found[2], concentrated(nearest(found))
            if found[2] > then - 1e-9:
                break
        best = found if best is None or found[2] < best[2] else best
    return best


def _row(cell: str, found: tuple[np.ndarray, np.ndarray, float]) -> pd.DataFrame:
    mean, root, logdet = found
    values = [cell, *mean.tolist(), *(float(root[i, j]) for i, j in _BELOW), logdet]
    return pd.DataFrame([values], columns=["cell", *_MEAN, *_ROOT, "logdet"])


def _start(rows: pd.DataFrame) -> pd.DataFrame:
    return _row(rows["cell"].iloc[0], first_estimate(rows[_X].to_numpy()))


def _moved(rows: pd.DataFrame, share: float | None) -> pd.DataFrame:
    """The next estimate of a cell from the moments of its bins: of the nearest half, or of all rows given."""
    rows = rows.sort_values("bin")
    count, given = rows["n"].cumsum().to_numpy(), int(rows["size"].iloc[0])
    wanted = min(given, (given + SIZE + 1) // 2) if share is None else int(rows["n"].sum())
    rows = rows.iloc[: int(np.searchsorted(count, wanted)) + 1]
    n, shift = rows["n"].sum(), rows[_SUM].sum().to_numpy() / rows["n"].sum()
    scatter = np.zeros((SIZE, SIZE))
    for (i, j), total in zip(_BELOW, rows[_SQUARE].sum(), strict=True):
        scatter[i, j] = scatter[j, i] = total / n
    return _row(rows["cell"].iloc[0], estimate(rows[_MEAN].iloc[0].to_numpy(dtype=float) + shift, scatter - np.outer(shift, shift), share or n / given))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from the mean beside it."""
    parts = []
    for i in range(SIZE):
        part = sum(F.col(f"w{i}_{j}") * (F.col(_X[j]) - F.col(_MEAN[j])) for j in range(i + 1))
        parts.append(part * part)
    return sum(parts[1:], parts[0])


def _step(points: DataFrame, sizes: DataFrame, found: DataFrame, share: float | None = None) -> DataFrame:
    """One step of all cells: moments by bin of distance, then each cell's next estimate."""
    near = points.join(found, "cell").withColumn("d", _distance())
    if share is not None:
        near = near.where(F.col("d") <= quantile(share, SIZE))
    moved = [F.col(x) - F.col(m) for x, m in zip(_X, _MEAN, strict=True)]
    sums = [F.sum(v).alias(s) for v, s in zip(moved, _SUM, strict=True)] + [F.sum(moved[i] * moved[j]).alias(q) for (i, j), q in zip(_BELOW, _SQUARE, strict=True)]
    means = [F.first(m).alias(m) for m in _MEAN]
    bins = near.groupBy("cell", F.floor(F.log2(F.col("d") + 1e-9) * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"), *sums, *means)
    # written first, so that what tasks summed meets by cell and bin, and only whole bins meet by cell
    return saved(saved(bins).join(sizes, "cell").groupBy("cell").applyInPandas(lambda rows: _moved(rows, share), _ESTIMATE))


def estimates(points: DataFrame) -> DataFrame:
    """Mean, inverse root of the covariance and log determinant of each cell: from columns cell and x0, x1 and so on."""
    sizes = saved(points.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST))
    points = points.join(sizes.select("cell"), "cell", "left_semi")
    drawn = points.join(sizes, "cell").where(F.pmod(F.xxhash64(*_X), F.lit(1 << 20)) * F.col("size") < SAMPLE * (1 << 20))
    found = saved(drawn.groupBy("cell").applyInPandas(_start, _ESTIMATE))
    found = _step(points, sizes, found)  # the first is of the sample alone
    for _ in range(STEPS):
        then, found = found, _step(points, sizes, found)
        fell = then.select("cell", F.col("logdet").alias("before")).join(found, "cell").agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        if fell is None or fell < 0.01:
            break
    return _step(points, sizes, found, REWEIGHT)


def measured(texts: _text.Texts) -> list[np.ndarray]:
    """Words, their code points, symbols, repeated lines, words in repeated windows of three, lines with a word; by text."""
    starts, stops, first = texts.spans(_text.NOT_SPACE)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(np.isin(texts.data, np.frombuffer(SYMBOLS, np.uint8)))])
    chars = np.concatenate([[0], np.cumsum(points[stops] - points[starts])])[first]

    line_starts, line_stops, line_first = texts.lines()
    line_owner = np.repeat(np.arange(len(texts)), np.diff(line_first))
    said = np.searchsorted(starts, line_stops) > np.searchsorted(starts, line_starts)
    lines = np.bincount(line_owner[said], minlength=len(texts))
    _, distinct = _numbered(line_owner[said], texts.hashes(line_starts[said], line_stops[said]))
    duplicates = lines - np.bincount(line_owner[said][distinct], minlength=len(texts))

    windows = _text.sequence_hashes(texts.hashes(starts, stops), 3)
    inside = np.flatnonzero(owner[: len(windows)] == owner[2:]) if len(windows) else np.zeros(0, dtype=np.int64)
    number, distinct = _numbered(owner[inside], windows[inside])
    often = inside[np.bincount(number, minlength=len(distinct))[number] > 1]
    covered = np.zeros(len(starts), dtype=bool)
    for k in range(3):
        covered[often + k] = True
    repeated = np.bincount(owner[covered], minlength=len(texts))
    return [np.diff(first), np.diff(chars), np.diff(symbols[texts.bounds]), duplicates, repeated, lines]


def _numbered(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes of one owner get one number; and a place of each number."""
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[order[1:]] != owner[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """Counts of every whole text: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines
    (those with a word), base_failed.

    One row for each row of documents, repeated ones included; null texts have no words; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _text.slices(batch.column(3), lower=False):
                own = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *(pa.array(x, pa.int64()) for x in measured(texts))], names=["doc_id", "lang", "source", *COUNTS])

    named = [F.col(c).cast("string").alias(a) for c, a in ((language, "lang"), (source, "source"))]
    kind = documents.schema[doc_id].dataType.simpleString()
    found = documents.select(F.col(doc_id).alias("doc_id"), *named, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(work, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def judged(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """`statistics` of every document with cell, distance (squared; null where nothing was estimated) and kept.

    Documents that fail the base rules have no part in estimates and are never kept.  Null languages and sources are
    values of their own.  Cells of fewer than LEAST distinct vectors are joined; where even all that is left is fewer,
    every document that passes the base rules is kept.  An empty table gives no rows.
    """
    of_source, of_language = F.concat(F.lit("source"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("language"), F.to_json(F.struct("lang")))
    x = [F.when(~F.col("base_failed"), F.expr(f"double({e})")).alias(c) for e, c in zip(TRANSFORMS, _X, strict=True)]
    found = saved(statistics(documents, doc_id, text, language, source).select("*", *x, of_source.alias("of_source"), of_language.alias("of_language")))
    vectors = found.where("NOT base_failed").select("of_source", "of_language", *_X).distinct()
    counts = vectors.groupBy("of_source", "of_language").agg(F.count("*").alias("n"))
    left = counts.groupBy("of_language").agg(F.coalesce(F.sum(F.when(F.col("n") < LEAST, F.col("n"))), F.lit(0)).alias("left"))
    cell = F.when(F.col("n") >= LEAST, F.col("of_source")).when(F.col("left") >= LEAST, F.col("of_language")).otherwise("all")
    cells = saved(counts.join(left, "of_language").select("of_source", cell.alias("cell")))
    points = saved(vectors.join(cells, "of_source").select("cell", *_X).distinct())
    known = cells.join(estimates(points), "cell", "left")
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & F.coalesce(distance <= quantile(KEEP, SIZE), F.lit(True))
    return found.join(known, "of_source", "left").select("doc_id", "lang", "source", *COUNTS, "base_failed", "cell", distance.alias("distance"), kept.alias("kept"))


def op11_outliers(documents: DataFrame) -> DataFrame:
    """Verdicts on all documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    found = judged(documents.withColumn("doc_id", F.col("doc_id").cast("long")))
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance")
