"""Nulls, empty tables, repeated rows, very long texts and columns with clashing names, operator by operator."""

import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import licenses, line_dedup, ngrams, paragraphs, quality, toxicity

SF = "/root/testdata/sf0.001"
LINE = "A line that is long enough to count, word for word, in every copy of it."


@pytest.mark.parametrize("columns", [60, 72, 80, 100])
def test_notices_are_found_wrapped(spark, columns):
    rows = [(k, "\n".join(["Some file.", "", *textwrap.wrap(wording, columns), "", "code()"])) for k, wording in enumerate(w for wordings in licenses.NOTICES.values() for w in wordings)]
    names = [name for name, wordings in licenses.NOTICES.items() for _ in wordings]
    found = {(r["doc_id"], r["license"]) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found >= set(enumerate(names))


def test_several_notices_and_empty_tables(spark):
    wordings = [w[0] for w in list(licenses.NOTICES.values())[:6]]
    df = spark.createDataFrame([(1, " ".join(wordings), "clash", 0), (1, " ".join(wordings), "clash", 0)], "doc_id long, text string, license string, line int")
    found = licenses.licenses(df).groupBy("license").count().collect()
    assert {r["license"] for r in found} >= set(list(licenses.NOTICES)[:6]) and min(r["count"] for r in found) == 2
    assert licenses.licenses(df.limit(0)).count() == 0 and licenses.op6_licenses(df.limit(0)).count() == 0


def test_lines_of_odd_tables(spark):
    schema = "doc_id long, text string, id string, line int, n int, key int"
    rows = [(2, f"{LINE}\nother", "c", 1, 1, 1), (2, f"{LINE}\nother", "c", 1, 1, 1), (1, LINE.upper(), "c", 1, 1, 1), (3, LINE, None, None, None, None), (None, LINE, "c", 1, 1, 1), (4, None, "c", 1, 1, 1)]
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["removed"]) for r in line_dedup.op9_line_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 1, []), (1, 1, []), (2, 2, [0]), (2, 2, [0]), (3, 1, [0]), (4, 0, [])]
    assert line_dedup.op9_line_dedup(spark.createDataFrame([], schema)).count() == 0


def test_passages_of_one_word_and_long_texts(spark):
    rows = [(1, "a " * 3000), (2, "a " * 4000), (3, " ".join(f"w{k}" for k in range(30_000))), (4, " ".join(f"w{k}" for k in range(29_000, 31_000)))]
    found = {r["doc_id"] for r in paragraphs.op4_paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1, 2, 3, 4}


@pytest.mark.parametrize("operator", [quality.op8_quality, toxicity.op7_toxicity])
def test_scores_of_long_and_equal_texts(spark, operator):
    text = "so long a text " * 40_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 4)], "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r["score"] for r in operator(docs, labels).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())


def test_language_model_takes_clashing_columns(spark):
    rows = [(k, f"some words of text {k % 3}", 1, "c", 2) for k in range(20)] + [(3, "some words of text 0", 1, "c", 2), (None, "x", 1, "c", 2), (50, None, 1, "c", 2)]
    got = ngrams.op5_katz(spark.createDataFrame(rows, "doc_id long, text string, n int, word string, id int"))
    assert got.count() == len(rows) and got.where("score IS NULL OR score > 0").count() == 0


def test_stages_take_odd_rows_and_copies(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, None, None), (3, long, "en", "s", 300), (3, long, "en", "s", 300), (4, long.replace("word7 ", ""), "en", "s", 290)]
    docs = spark.createDataFrame(rows, schema)
    quality_stage = corpus_pipeline.STAGES[0][1]
    assert quality_stage(spark, docs, SF).columns == docs.columns and quality_stage(spark, docs.limit(0), SF).count() == 0
    near = corpus_pipeline.no_near_copies(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "None"]
    assert corpus_pipeline.no_near_copies(spark, docs.where(F.col("doc_id") == 4), SF).count() == 1
