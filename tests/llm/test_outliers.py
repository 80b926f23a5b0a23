"""Outlier rules: statistics against plain counting, estimates against planted shapes, verdicts against labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import outliers

WORD = re.compile("[^\x20\x09-\x0d]+")


def counted(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            hit |= {k, k + 1, k + 2}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(hit), failed


def test_statistics_against_plain_counting(spark, sf_dir):
    rng = random.Random(4)
    parts = ["a", "b", "é", "中", "\n", "\n", " ", " ", "\t", "\r", "\x0b", "\x85", "#", "|", "<", "a b c", "\n\n", "😀", "<|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [None, "", "\n", "a a a a", "x\nx\nx", " x\nx", "w " * 300_000]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [(k, t, None, "s", 1) for k, t in enumerate(texts)] + [(7, texts[7], None, "s", 1), (None, "a", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cell int").repartition(3)
    got = outliers.op11_outliers(df).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 7 for r in got) == 2
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counted(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_chi_squared():
    assert outliers.quantile(0.95, 1) == pytest.approx(3.841, abs=1e-3)
    assert outliers.quantile(0.975, 4) == pytest.approx(11.143, abs=1e-3)
    assert outliers.within(outliers.quantile(0.3, 7), 7) == pytest.approx(0.3)


def test_estimates_withstand_a_large_minority(spark):
    rng = np.random.default_rng(0)
    root = np.array([[2.0, 0, 0, 0], [1.5, 1, 0, 0], [0, 0.5, 3, 0], [0, 0, 0, 1]])
    good, bad = rng.normal(size=(3000, 4)) @ root.T + [5, -3, 0, 1], rng.normal(size=(1800, 4)) * 4 + [30, 30, -30, 0]
    rows = [("one", *map(float, x)) for x in np.vstack([good, bad])] + [("few", 0.0, 0.0, 0.0, float(k)) for k in range(20)]
    points = spark.createDataFrame(rows, "cell string, x0 double, x1 double, x2 double, x3 double").repartition(4)
    found = outliers.estimates(points).collect()
    assert [r["cell"] for r in found] == ["one"]
    mean = np.array([found[0][f"m{i}"] for i in range(4)])
    inverse = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            inverse[i, j] = found[0][f"w{i}_{j}"]
    covariance = np.linalg.inv(inverse.T @ inverse) - np.diag(outliers.FLOOR**2)
    assert np.abs(mean - [5, -3, 0, 1]).max() < 0.2
    assert np.abs(covariance - root @ root.T).max() < 1.0
    # the same half as a direct concentration over all vectors
    direct = outliers.first_estimate(np.vstack([good, bad]))
    assert np.abs(direct[0] - mean).max() < 0.3


def test_first_estimate_is_the_least_determinant():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4)) * 5
    import itertools

    half = (12 + 4 + 1) // 2
    best = min(outliers.estimate(x[list(c)].mean(0), np.cov(x[list(c)].T, bias=True), half / 12)[2] for c in itertools.combinations(range(12), half))
    assert outliers.first_estimate(x)[2] == pytest.approx(best, abs=0.35)


def test_verdicts_keep_clean_documents_and_reject_junk(spark):
    folder = "/root/testdata/sf0.01"
    found = outliers.op11_outliers(spark.read.parquet(f"{folder}/documents.parquet")).where("NOT base_failed")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r["quality"]: r["share"] for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.1


def test_copies_are_one_opinion(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [" ".join(word(rng.randint(3, 7)) for _ in range(rng.randint(60, 200))) for _ in range(150)]
    texts += [" ".join(word(5) + "$#" for _ in range(80))] * 400
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in outliers.op11_outliers(df).collect()}
    assert all(kept[k] for k in range(150)) and not any(kept[k] for k in range(150, 550))


def test_empty_table(spark):
    assert outliers.op11_outliers(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
