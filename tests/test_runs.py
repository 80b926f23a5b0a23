"""Extraction runs, document records, counted writes, table functions and years of records."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import tables
from quarry.functions.text import NESTED_YEAR_FIELDS, YEAR_FIELDS, YEAR_RECORDS, record_year
from quarry.operators import chunking, documents, experts, extraction, runs
from quarry.sources import sinks


def bad_on(marks, log):
    """An extractor that fails on texts with a mark, as long as it stands in the file of marks; it logs what it is asked."""

    def extract(texts):
        with open(log, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        with open(marks) as file:
            bad = [m for m in file.read().split() if m]
        for text in texts:
            if any(m in text for m in bad):
                raise runs.Rejected(f"can't read {text}", "x" * 20_000)
        return [json.dumps({"said": t}) for t in texts]

    return extract


def test_a_run_ends_and_the_next_asks_only_what_is_left(spark, tmp_path):
    marks, log, folder = tmp_path / "marks", tmp_path / "log", str(tmp_path / "out")
    marks.write_text("t3. t17.")
    chunks = spark.createDataFrame([(k, "doc", f"t{k}." if k != 9 else None) for k in range(40)], "chunk_id long, document_id string, text string").repartition(3)
    extractor = bad_on(str(marks), str(log))
    first = runs.extraction_run(chunks, extractor, folder, 1, batch=4, tries=2, pause=0.0)
    assert first == {"asked": 40, "answered": 38, "failed": 2}
    failed = {r["chunk_id"]: r for r in runs.failures(spark, folder).collect()}
    assert set(failed) == {3, 17} and all(len(r["response"]) == runs.CLIP and r["tries"] == 2 and "Rejected" in r["error"] for r in failed.values())
    asked = log.read_text().split("\n")
    assert asked.count("t3.") == 4  # twice with its batch, twice alone
    log.write_text("")
    marks.write_text("t17.")
    second = runs.extraction_run(chunks, extractor, folder, 2, batch=4, tries=1, pause=0.0)
    assert second == {"asked": 2, "answered": 1, "failed": 1} and set(log.read_text().split()) == {"t3.", "t17."}
    assert [r["chunk_id"] for r in runs.failures(spark, folder).collect()] == [17]
    good = runs.answers(spark, folder)
    assert sorted(r["chunk_id"] for r in good.collect()) == [k for k in range(40) if k != 17] and good.where("document_id = 'doc'").count() == 39
    # a run that was cut off is written anew
    assert runs.extraction_run(chunks, extractor, folder, 2, tries=1, pause=0.0)["asked"] == 1


def test_unusable_answers_are_failures(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "good"), (2, "bad")], "chunk_id long, text string")
    unusable = F.when(F.try_parse_json("response").isNull(), "no JSON")
    counts = runs.extraction_run(chunks, lambda texts: ["{}" if t == "good" else "{" for t in texts], str(tmp_path), 1, unusable=unusable, pause=0.0)
    assert counts == {"asked": 2, "answered": 1, "failed": 1}
    assert [(r["chunk_id"], r["error"], r["response"]) for r in runs.failures(spark, str(tmp_path)).collect()] == [(2, "no JSON", "{")]


def test_an_extractor_that_answers_too_little(spark):
    got = runs.attempts(spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, text string").coalesce(1), lambda texts: ["x"], tries=1).collect()
    assert all(r["ok"] and r["response"] == "x" for r in got)  # asked one by one
    assert runs.attempts(spark.createDataFrame([], "chunk_id long, text string"), lambda texts: []).count() == 0


ENTITY = "struct<type:string,name:string,canonical_name:string,aliases:array<string>,evidence_text:string,confidence:double>"
RELATION = "struct<type:string,source_name:string,target_name:string,evidence_text:string,confidence:double>"
FACT = "struct<claim_text:string,fact_type:string,subject:string,objects:array<string>,numeric_value_ids:array<string>,geo_scope:string,country:string,year:int,quote:string,confidence:double>"
EXTRACTION = f"document_id string, chunk_id string, entities array<{ENTITY}>, relations array<{RELATION}>, facts array<{FACT}>"


def extracted(spark):
    nickel, copper = ("Material", "Nickel", "nickel", ["Ni"], "seen", 0.5), ("Material", "copper", None, ["Cu", "Copper"], None, None)
    rows = [
        ("d", "c1", [nickel, copper, ("Material", " ", None, None, None, None)], [("USES_MATERIAL", "Ni", "copper", "near", None), ("USES_MATERIAL", "nickel", "Ni", None, 0.9)], [("a claim", None, "nickel", ["Cu", "gold", "NI"], ["v1", "v9"], "global", None, 2001, "quoted", None)]),
        ("d", "c2", [("Material", "NICKEL", "Nickel", ["ni", "N"], None, 0.9), ("Process", "nickel", "nickel", [], None, 0.2)], [("USES_MATERIAL", "Ni", "lead", None, None)], [("a claim", "recommendation", "?", None, None, "mars", "RU", None, None, 0.3)] * 2),
        ("d", "c9", None, None, None),
        ("e", "c3", [], [], []),
        (None, "c4", [nickel], [], []),
    ]
    chunks = spark.createDataFrame([("c1", "text one", 4, "file.pdf", 2010), ("c2", "text two", 5, "file.pdf", 2010), ("c3", None, None, None, None), ("c7", "not asked", 1, "x", 1)], "chunk_id string, text string, page_start int, filename string, year int")
    values = spark.createDataFrame([("v1", "c1", "temperature", 20.0), ("v1", "c2", "temperature", 20.0), ("v2", "c2", None, 1.0), ("", "c1", "x", 1.0), ("v9", "c7", "x", 1.0)], "id string, chunk_id string, parameter string, value double")
    return spark.createDataFrame(rows, EXTRACTION), chunks, values


def test_document_records(spark):
    found = {r["document_id"]: r for r in documents.assembled(*extracted(spark)).collect()}
    assert set(found) == {"d", "e"}
    d, e = found["d"], found["e"]
    assert [(x["type"], x["name"], x["aliases"], x["confidence"], x["source_chunk_id"], x["page"]) for x in d["entities"]] == [("Material", "Nickel", ["N", "Ni", "ni"], 0.9, "c1", 4), ("Material", "copper", ["Cu", "Copper"], 0.7, "c1", 4), ("Process", "nickel", [], 0.2, "c2", 5)]
    ids = {(x["type"], x["name"]): x["id"] for x in d["entities"]}
    nickel, copper = ids["Material", "Nickel"], ids["Material", "copper"]
    assert [(x["source_entity_id"], x["target_entity_id"], x["confidence"]) for x in d["relations"]] == [(nickel, copper, 0.7)]
    assert d["warnings"] == [documents.UNRESOLVED % 2, documents.MISSING % 1] and e["warnings"] == []
    assert [(x["id"], x["parameter"], x["source_chunk_id"], x["page"]) for x in d["numeric_values"]] == [("v1", "temperature", "c1", 4), ("v2", "numeric_value", "c2", 5)]
    one, two = d["facts"]
    assert (one["subject_entity_id"], one["object_entity_ids"], one["numeric_value_ids"], one["geo_scope"], one["source"]["quote"]) == (nickel, sorted([nickel, copper]), ["v1"], "all", "quoted")
    assert (two["subject_entity_id"], two["object_entity_ids"], two["geo_scope"], two["confidence"], two["fact_type"]) == (None, [], "unknown", 0.3, "recommendation")
    assert (d["source"]["title"], d["source"]["year"], d["source"]["access_level"], e["source"]["title"]) == ("file.pdf", 2010, "internal", "e")
    assert [c["id"] for c in d["chunks"]] == ["c1", "c2"] and e["entities"] == [] and e["chunks"][0]["text"] == ""


def test_records_taken_apart_are_the_tables_that_they_were_made_of(spark):
    extractions, chunks, values = extracted(spark)
    records = documents.assembled(extractions, chunks, values)
    apart = sinks.explode_documents(records)
    pairs = lambda df, *cs: sorted(tuple(r[c] for c in cs) for r in df.collect())
    assert pairs(apart["chunks"], "document_id", "id") == [("d", "c1"), ("d", "c2"), ("e", "c3")]
    assert pairs(apart["numeric_values"], "id") == [("v1",), ("v2",)]
    assert pairs(apart["extracted_from"], "value_id", "chunk_id") == [("v1", "c1"), ("v2", "c2")]
    assert len(pairs(apart["entities"], "id")) == 3 and len(pairs(apart["facts"], "id")) == 2 and len(pairs(apart["relations"], "id")) == 1
    assert pairs(apart["has_parameter"], "value_id") == [("v1",)] and len(pairs(apart["about"], "entity_id")) == 2
    assert documents.assembled(extractions.limit(0), chunks, values).count() == 0


def test_writes_are_counted_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("z", 1, None), (None, 9, True)], "kind string, size int, ok boolean")
    calls = spark.sparkContext.accumulator(0)
    touched = rows.withColumn("kind", F.udf(lambda k: (calls.add(1), k)[1])("kind"))
    totals, counted = sinks.written_with_counts(touched, str(tmp_path / "t"), {"kind": ["a", "b", "never"], "size": [1, 2]}, F.col("ok"), "json")
    assert totals == {"rows": 5, "succeeded": 3, "failed": 2} and calls.value == 5
    assert {(r["kind"], r["size"]): r["cnt"] for r in counted} == {("a", "1"): 1, ("a", "2"): 1, ("b", "1"): 1, ("other", "1"): 1, ("other", "other"): 1}
    assert spark.read.json(str(tmp_path / "t")).count() == 5
    again, _ = sinks.written_with_counts(rows.limit(0), str(tmp_path / "t"), {})
    assert again == {"rows": 0, "succeeded": 0, "failed": 0}


def test_table_functions_give_the_rows_of_operators(spark, sf_dir):
    tables.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Исследования ведёт Институт Гипроникель. Температура 20-30 °C.")], "doc_id long, text string"))
    docs.createOrReplaceTempView("table_docs")
    cut = {(r["doc_id"], r["number"]): r["piece"] for r in spark.sql("SELECT d.doc_id, p.* FROM table_docs d, LATERAL text_pieces(d.text, 500, 50) p").collect()}
    assert cut == {(r["doc_id"], k): p for r in docs.collect() for k, p in enumerate(chunking.pieces(r["text"], 500, 50))}
    values = spark.sql("SELECT d.doc_id, v.parameter, v.value_min, v.unit, v.char_start FROM table_docs d, LATERAL measured_values(d.text) v")
    same = extraction.numeric_values(docs, "doc_id").select(F.col("chunk_id").alias("doc_id"), "parameter", "value_min", "unit", "char_start")
    assert sorted(map(tuple, values.collect()), key=str) == sorted(map(tuple, same.collect()), key=str) and values.count() > 0
    bodies = spark.sql("SELECT d.doc_id, o.key, o.name FROM table_docs d, LATERAL organisations(d.text) o")
    named = experts.expert_mentions(docs, chunk_id="doc_id").select("chunk_id", "key", "name")
    assert sorted(map(tuple, bodies.collect())) == sorted(map(tuple, named.collect())) and bodies.count() > 0


@pytest.mark.parametrize(
    ("record", "year"),
    [
        ({"year": 2001, "source_year": 1999}, 2001),
        ({"year": "n/a", "publication_year": "c. 1987, 1990", "filename": "x2020.pdf"}, 1987),
        ({"year": True, "document_year": 2005.9}, 2005),
        ({"year": 1899, "metadata": {"year": 3000, "CreationDate": "D:20140102"}}, None),
        ({"metadata": {"ModDate": "2014-01-02"}, "document_metadata": {"modified": "12.03.2013"}}, 2013),
        ({"extra_metadata": {"date": "2100"}, "metadata": {"year": 2000}}, 2100),
        ({"metadata": [2000], "filename": "report_2016_v2.pdf"}, 2016),
        ({"metadata": {"date": [2009]}}, 2009),
        ({"filename": "20161.pdf"}, None),
        ({}, None),
    ],
)
def test_years_of_records(spark, record, year):
    df = spark.createDataFrame([(json.dumps(record),)], "r string").select(F.try_parse_json("r").alias("v"))
    assert df.select(record_year("v").alias("y")).first()["y"] == year


def test_year_precedence(spark):
    """Every place that may hold a year, from the last to the first, outweighs those after it."""
    places = [*((f,) for f in YEAR_FIELDS), *((r, f) for r in YEAR_RECORDS for f in NESTED_YEAR_FIELDS), ("filename",)]
    assert len(places) == 4 + 33 + 1
    record, rows = {}, []
    for k, place in enumerate(reversed(places)):
        inner = record if len(place) == 1 else record.setdefault(place[0], {})
        inner[place[-1]] = str(1950 + k)
        rows.append((json.dumps(record), 1950 + k))
    df = spark.createDataFrame(rows, "r string, y int").select("y", record_year(F.parse_json("r")).alias("got"))
    assert df.where("y <> got OR got IS NULL").count() == 0
