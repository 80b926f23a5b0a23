"""Held-out accuracy of the learned operators, license notices, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import licenses, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("operator", "label", "cut"), [(quality.op8_quality, "quality", 0.3), (toxicity.op7_toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, operator, label, cut):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = operator(docs, labels)
    assert got.count() == docs.count() and got.where(f"score < 0 OR score > 1 OR predicted <> int(score >= {cut})").count() == 0
    held = got.where("held_out").join(labels, "doc_id").select("predicted", label).toPandas()
    assert (held["predicted"] == held[label]).mean() > 0.93


@pytest.mark.parametrize("operator", [quality.op8_quality, toxicity.op7_toxicity])
def test_odd_rows(spark, operator):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y"), (3, "y")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert operator(docs, labels).count() == 5
    assert operator(docs, labels.limit(0)).count() == 5
    assert operator(docs.limit(0), labels).count() == 0


def test_toxic_words_are_folded_and_exceptions_count_nothing():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "stup*": 4.0}, {"stupid error"})
    find = lexicon.matcher()
    hits = lambda text: [toxicity.folded(text)[a:b] for a, b, _ in find(toxicity.folded(text))]
    assert hits("You 1D10T, so ѕtuріd!") == ["idiot", "stupid"]
    assert hits("a stupid error") == [] and hits("stupidity; IDI​OT") == ["stupidity", "idiot"] and hits("") == []


def test_trees_split_what_differs():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(np.float64)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    assert 0 < quality.fit(x[:5], np.ones(5)).score(x[:1])[0] < 1


def test_licenses(spark):
    wording = licenses.NOTICES["GPL-3.0"][1]
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, wording.replace("redistribute", "pass on")), (3, "no such words"), (4, None), (5, ""), (6, "The license of the shop was renewed."), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0."), (8, "x\n" * 500 + "Released under the MIT License.")]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["line"], r["license"], r["exact"]) for r in got)
    assert found == [(1, 1, "Apache-2.0", True), (2, 0, "GPL-3.0", False), (7, 0, "CC-BY-NC-4.0", True), (7, 0, "CC-BY-NC-4.0", True), (8, 500, "MIT", True)]
    assert next(r["missing"] for r in got if r["doc_id"] == 2) == ["redistribute"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        kept = corpus_pipeline.saved(stage(spark, before, SF))
        if k < 4:
            assert kept.columns == docs.columns
            assert kept.join(before, "doc_id", "left_anti").isEmpty()
        assert 0.5 * before.count() < kept.count() <= before.count(), name
    final = kept.join(before.withColumnRenamed("text", "given"), "doc_id")
    assert final.where("text <> given OR n_tokens <> size(ids)").isEmpty() and final.count() == before.count()


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, None, None), (3, "some words here\nsome words here", "en", "s", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() >= 3, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
