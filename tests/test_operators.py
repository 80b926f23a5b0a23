"""Operators on small tables with hand-computed results."""

import io
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.numeric import Constraint, numeric_predicate
from quarry.functions.text import clip, name_key, range_text, relation_type, year_of
from quarry.operators import access, changes, chunking, entities, extraction, facts, graph, retrieval, summaries
from quarry.sources import readers, sinks
from quarry.streaming import ingest

VALUES = "value double, value_min double, value_max double"


@pytest.mark.parametrize(
    ("row", "constraint", "whole", "point"),
    [
        ((None, 50.0, 150.0), Constraint("p", "<", value=100), False, True),
        ((None, 50.0, 150.0), Constraint("p", "between", value_min=80, value_max=90), True, False),
        ((100.0, None, None), Constraint("p", "<=", value=100), True, True),
        ((100.0, None, None), Constraint("p", "<", value=100), False, False),
        ((None, None, None), Constraint("p", ">=", value=5), False, False),
        ((None, None, None), Constraint("p", "between", value_min=1, value_max=2), True, False),
        ((None, 50.0, 150.0), Constraint("p", "=", value=100), True, False),
        ((7.0, None, None), Constraint("p", "<", value_min=5), False, True),
    ],
)
def test_numeric_predicate(spark, row, constraint, whole, point):
    df = spark.createDataFrame([row], VALUES)
    found = df.select(numeric_predicate(constraint).alias("r"), numeric_predicate(constraint, "point").alias("p")).first()
    assert (found["r"], found["p"]) == (whole, point)


def test_text_functions(spark):
    df = spark.createDataFrame([(" Ёлка-SO2 (gas) ", "uses equipment!", "report 2019.pdf", 2.0, 3.5)], "name string, type string, file string, low double, high double")
    r = df.select(name_key("name").alias("k"), relation_type("type").alias("t"), year_of("file").alias("y"), clip("name", 4).alias("c"), range_text("low", F.lit(None).cast("double"), "high").alias("s")).first()
    assert (r["k"], r["t"], r["y"], r["c"], r["s"]) == ("елка so2 gas", "USES_EQUIPMENT_", 2019, "Ёлка…", "2–3.5")


def test_roles_see_more_and_more(spark):
    sources = spark.createDataFrame([(1, "public"), (2, "internal"), (3, "confidential"), (4, None)], "source_id int, access_level string")
    seen = {role: {r[0] for r in sources.where(access.visible(role)).collect()} for role in [*access.ROLES, "nobody"]}
    assert seen["partner"] == seen["nobody"] == {1}
    assert seen["analyst"] == {1, 2, 4} and seen["admin"] == {1, 2, 3, 4}


def test_fact_order_puts_unknown_first(spark):
    df = spark.createDataFrame([(1, 0.5, 2000), (2, None, 1999), (3, 0.5, None)], "fact_id int, confidence double, year int")
    assert [r["fact_id"] for r in facts.ranked(df, 3).collect()] == [2, 3, 1]


def test_fusion_gains_from_every_branch(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 5.0)], "chunk_id int, score double")
    b = spark.createDataFrame([(2, 1.0)], "chunk_id int, score double")
    one = {r["chunk_id"]: r["score"] for r in retrieval.fuse([(a, 1.0)]).collect()}
    two = {r["chunk_id"]: r["score"] for r in retrieval.fuse([(a, 1.0), (b, 1.35)]).collect()}
    assert one[1] == two[1] == pytest.approx(1 / 61) and two[2] == pytest.approx(1 / 62 + 1.35 / 61, abs=1e-8)


def test_cap_by_document(spark):
    hits = spark.createDataFrame([(i, "a" if i < 5 else "b", 10.0 - i) for i in range(8)], "chunk_id int, document_id string, score double")
    assert [r["chunk_id"] for r in retrieval.capped(hits, "document_id").collect()] == [0, 1, 5, 6]


def test_graph_reads(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["hops"] for r in graph.neighbours(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    targets = spark.createDataFrame([("d",), ("y",)], "node string")
    assert [(r["node"], r["hops"]) for r in graph.path_lengths(edges, seeds, targets).collect()] == [("d", 3)]
    with pytest.raises(ValueError):
        graph.neighbours(edges, seeds, 5)


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, changes.upserted(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert changes.repeated_keys(old.union(old), "id").count() == 2
    with pytest.raises(ValueError):
        sinks.check_unique(old.union(old), "id")
    fact = spark.createDataFrame([(1, "new", 0.5)], "fact_id int, status string, confidence double")
    patch = spark.createDataFrame([(1, "checked", None)], "fact_id int, status string, confidence double")
    assert tuple(changes.patched(fact, patch).first())[:3] == (1, "checked", 0.5)


def test_names_resolve_exactly_then_by_unique_containment(spark):
    known = spark.createDataFrame([("d", 1, "Heap leaching"), ("d", 2, "Autoclave"), ("d", 3, "Copper cathode"), ("d", 4, "Copper anode")], "document string, entity_id int, name string")
    asked = spark.createDataFrame([("d", "heap-LEACHING"), ("d", "autoclave unit"), ("d", "copper"), ("d", "gold")], "document string, name string")
    found = {r["name"]: (r["entity_id"], r["how"]) for r in entities.resolved(asked, known, "document").collect()}
    assert found == {"heap-LEACHING": (1, "exact"), "autoclave unit": (2, "contained")}


def test_chunks_keep_all_words_and_their_size(spark):
    pages = [("d1", k, f"Sentence {k}. " * 40) for k in range(5)] + [("d2", 1, "short"), ("d2", 2, None), ("d3", 1, "x" * 900)]
    out = chunking.chunk_pages(spark.createDataFrame(pages, "doc string, page int, text string"), "doc", "page", "text", 500).collect()
    assert all(len(r["text"]) <= 500 for r in out)
    for doc in ("d1", "d2", "d3"):
        own = sorted((r for r in out if r["document"] == doc), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in own] == list(range(len(own)))
        whole = " ".join(t for d, _, t in pages if d == doc and t)
        assert "".join("".join(r["text"].split()) for r in own) == "".join(whole.split())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("200-300 мг/л", [("range", None, 200.0, 300.0, "mg/L")]),
        ("300-200 мг/л", [("range", None, 200.0, 300.0, "mg/L")]),
        ("не более 1000 мг/дм3", [("<=", 1000.0, None, None, "mg/L")]),
        ("98,5 %", [("=", 98.5, None, None, "%")]),
        ("менее 5 г/т", [("<", 5.0, None, None, "g/t")]),
        ("15 pH", []),
        ("pH 7", []),
        ("4-11 Металлургия", []),
        ("10 м", []),
    ],
)
def test_measurements(text, expected):
    assert [(m["comparator"], m["value"], m["value_min"], m["value_max"], m["unit"]) for m in extraction.measurements(text)] == expected


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.exe").write_text("no")
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:document>')
    (tmp_path / "d.docx").write_bytes(made.getvalue())
    found = {r["path"].rsplit("/", 1)[1]: (r["text"], r["status"]) for r in readers.file_pages(spark, str(tmp_path)).collect()}
    assert found["a.txt"] == ("hello", "ok") and found["d.docx"] == ("One\nTwo", "ok")
    assert found["b.docx"][1] == "error" and "c.exe" not in found


def test_json_lines_leave_bad_ones_out(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "text": "a"}\nnot json\n\n{"id": "2", "text": " "}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    rows = readers.json_lines(spark, str(tmp_path), schema)
    assert rows.count() == 2 and [r["chunk_id"] for r in readers.valid_chunks(rows).collect()] == ["1"]


def test_document_records_become_tables(spark):
    fact = Row(id="f1", claim_text="c", subject_entity_id="e1", object_entity_ids=["e9"], numeric_value_ids=["n1", "n2"], source=Row(page=1, quote="q"))
    doc = Row(document_id="d", source=Row(id="s", title="t"), chunks=[Row(id="c1", text="x")], entities=[Row(id="e1", type="Odd", name="E")], numeric_values=[Row(id="n1", value=1.0)], facts=[fact], relations=[Row(source_entity_id="e1", target_entity_id="e9", type="uses")])
    tables = sinks.explode_documents(spark.createDataFrame([doc]))
    assert tables["entities"].first()["type"] == "Entity"
    assert [r["entity_id"] for r in tables["about"].collect()] == ["e1"] and tables["relations"].count() == 0
    assert [r["value_id"] for r in tables["has_parameter"].collect()] == ["n1"]


def test_weak_topics_keep_unmentioned_entities(spark):
    fact = spark.createDataFrame([(1,), (2,)], "fact_id int")
    links = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "fact_id int, entity_id int")
    names = spark.createDataFrame([(10, "often"), (11, "once"), (12, "never")], "entity_id int, name string")
    assert [tuple(r) for r in summaries.weak_topics(fact, links, names).collect()] == [("never", 0), ("once", 1)]
