"""Streams end like a batch over what counts, with repeated, older and late rows, and after a restart."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.extraction import numeric_values
from quarry.sources.segments import load_index
from quarry.streaming import ingest

PAGES = "document_id string, page int, text string, at int"


def deliver(spark, folder, rows, schema=PAGES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def tables(index):
    """All tables of an index as comparable rows."""
    chunks = sorted((r["chunk_id"], r["document_id"], r["text"], r["version"]) for r in index.live("chunks").collect())
    postings = sorted((r["term"], r["chunk_id"], r["tf"], r["n"], *r["positions"]) for r in index.live("postings").collect())
    values = sorted((r["id"], r["document_id"], r["parameter"], r["value"]) for r in index.live("values").collect())
    vectors = sorted((r["chunk_id"], tuple(r["vector"])) for r in index.live("vectors").collect())
    return chunks, postings, values, vectors, index.manifest["chunks"], index.manifest["words"]


def test_index_of_three_batches_equals_one(spark, tmp_path):
    first = [("a", 1, "copper recovery was 95 %", 1), ("a", 2, "second page", 1), ("b", 1, "temperature 20-30 degC", 1), ("c", 1, "stays as it is", 1)]
    second = [("a", 1, "copper recovery was 97 % now", 2), ("d", 1, "a new one of 5 g/t", 1), ("d", 1, "a new one of 5 g/t", 1)]
    third = [("a", 1, "an older text of 10 %", 1), ("b", 1, "temperature 40 degC", 3), ("b", 1, "temperature 30 degC", 2), ("c", 1, "stays as it is", 1), (None, 1, "nobody's", 9), ("e", 1, None, 1)]
    kinds = T._parse_datatype_string(PAGES)
    for rows in (first, second, third):
        deliver(spark, tmp_path / "in", rows)
        ingest.index_stream(ingest.page_stream(spark, str(tmp_path / "in"), kinds), str(tmp_path / "index"), str(tmp_path / "mark"), version="at").awaitTermination()
    streamed = load_index(spark, str(tmp_path / "index"))
    assert len(streamed.segments) == 3
    last = [second[0], ("d", 1, "a new one of 5 g/t", 1), third[1], first[3]]
    whole = ingest.update_index(spark.createDataFrame(last, PAGES), str(tmp_path / "whole"), "all", version="at")
    assert tables(streamed) == tables(whole)
    assert {r["value"] for r in streamed.live("values").collect()} == {97.0, 5.0, 40.0}
    assert streamed.live("values").count() == numeric_values(streamed.live("chunks")).count()


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "copper", 1)], PAGES)
    folder = str(tmp_path / "index")
    one = ingest.update_index(pages, folder, "batch-1", version="at")
    assert ingest.update_index(pages, folder, "batch-1", version="at").number == one.number
    # without versions the same document replaces itself
    two = ingest.update_index(pages, folder, "batch-2", encoder=None)
    assert two.number == 2 and two.live("chunks").count() == 1 and two.live("vectors").count() == 0
    assert ingest.update_index(pages.limit(0), folder, "batch-3").number == 2
    assert ingest.update_index(pages.limit(0), str(tmp_path / "none"), "batch-1") is None


def test_a_document_without_text_is_removed(spark, tmp_path):
    folder = str(tmp_path / "index")
    ingest.update_index(spark.createDataFrame([("a", 1, "copper", 1), ("b", 1, "ore", 1)], PAGES), folder, "1", version="at")
    index = ingest.update_index(spark.createDataFrame([("a", 1, " ", 2)], PAGES), folder, "2", version="at")
    assert [r["document_id"] for r in index.live("chunks").collect()] == ["b"] and index.bm25(["copper"], 5).count() == 0


EVENTS = "event_id long, ts timestamp, event_type string"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1, hour, minute)


def test_windows_take_late_rows_within_the_delay_and_go_on_after_a_restart(spark, tmp_path):
    kinds = T._parse_datatype_string(EVENTS)

    def run():
        events = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        ingest.window_stream(events, str(tmp_path / "out"), str(tmp_path / "mark"), late="30 minutes").awaitTermination()
        out = tmp_path / "out"
        return sorted((r["start"].hour, r["event_type"], r["cnt"]) for r in spark.read.parquet(str(out)).collect()) if any(out.glob("*.parquet")) else []

    deliver(spark, tmp_path / "in", [(1, at(1), "view"), (2, at(1, 10), "view"), (2, at(1, 10), "view"), (3, at(1, 50), "click")], EVENTS)
    assert run() == []  # the first window is open
    # out of order within the delay, a repeat of an earlier delivery, and an event that closes the first window
    deliver(spark, tmp_path / "in", [(4, at(1, 40), "view"), (3, at(1, 50), "click"), (5, at(2, 45), "view")], EVENTS)
    assert run() == [(1, "click", 1), (1, "view", 3)]
    # too late for the first window: the watermark is at 2:15
    deliver(spark, tmp_path / "in", [(6, at(1, 59), "view"), (7, at(2, 20), "view")], EVENTS)
    assert run() == [(1, "click", 1), (1, "view", 3)]
    deliver(spark, tmp_path / "in", [(8, at(9), "click")], EVENTS)
    assert run() == [(1, "click", 1), (1, "view", 3), (2, "view", 2)]


def test_windows_of_a_table(spark):
    rows = [(1, at(1), "view"), (2, at(1, 59), "view"), (3, at(2), "view"), (4, None, "view")]
    got = ingest.windowed_counts(spark.createDataFrame(rows, EVENTS)).where(F.col("start").isNotNull()).collect()
    assert sorted((r["start"].hour, r["cnt"]) for r in got) == [(1, 2), (2, 1)]
