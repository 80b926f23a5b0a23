"""Postings are made where texts are, and dealt out in slices."""

from quarry.functions.text import words
from quarry.operators import retrieval
from quarry.sources import segments


def test_postings_are_those_of_each_text(spark, monkeypatch):
    rows = [(1, 10, "b a, B a-c"), (2, 10, ""), (3, None, None), (4, 11, "ё Ё x"), (None, 12, "a")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id int, text string")
    made = segments.positional(chunks)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    split = {(r["chunk_id"], r["document_id"]): r["w"] or [] for r in chunks.select("chunk_id", "document_id", words("text").alias("w")).collect()}
    expected = sorted(((w, *key, ws.count(w), len(ws), [i for i, x in enumerate(ws) if x == w]) for key, ws in split.items() for w in set(ws)), key=str)
    assert sorted(map(tuple, made.collect()), key=str) == expected
    monkeypatch.setattr(segments, "MOST_WORDS", 1)
    batches = [b for b in chunks.select("chunk_id", "document_id", words("text").alias("words")).toArrow().to_batches()]
    cut = [r for b in segments._gathered(iter(batches)) for r in b.to_pylist()]
    assert sorted((tuple(r.values()) for r in cut), key=str) == expected


def test_an_index_written_in_slices(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS chunk_id", "doc_id AS document_id", "text").repartition(3)
    monkeypatch.setattr(segments, "SLICE", 1)
    index = segments.write_segment(spark, str(tmp_path / "index"), docs, layout=(4, 2))
    assert len(segments._Files(spark, index.folder).slices(f"{index.folder}/chunks/segment={index.segments[0]}", 1)) == 3
    asked = ["of-the", "the", "tion"]
    assert index.bm25(asked, 20).collect() == retrieval.bm25(retrieval.saved_counts(docs, asked), range(3), 20).collect()
    assert index.live("postings").count() == segments.positional(docs).count()
    assert index.bm25(["", "--"], 5).count() == 0


def test_an_overlay_written_in_slices(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS chunk_id", "doc_id AS document_id", "text").repartition(2)
    monkeypatch.setattr(segments, "SLICE", 1)
    folder = str(tmp_path / "index")
    segments.write_segment(spark, folder, docs, layout=(4, 2))
    again = docs.where("chunk_id % 3 = 0").selectExpr("chunk_id", "document_id", "'of the tion ' || text AS text").repartition(2)
    index = segments.write_segment(spark, folder, again, removed=docs.where("chunk_id % 3 = 1").select("document_id"))
    live, asked = again.unionByName(docs.where("chunk_id % 3 = 2")), ["of-the", "tion"]
    assert index.bm25(asked, 20).collect() == retrieval.bm25(retrieval.saved_counts(live, asked), range(2), 20).collect()
    # an index written at once has one file of each part and spread; slices add theirs
    assert len(spark.read.parquet(f"{folder}/postings/segment={index.segments[0]}").inputFiles()) == 8
