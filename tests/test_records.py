"""Model answers as tables, terms, guards, short forms, chunkers, experts: each against hand-made results."""

import datetime
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.functions import terms
from quarry.functions.numeric import Constraint
from quarry.operators import changes, chunking, experts, extraction, models, projections, records, retrieval


def test_query_terms():
    assert terms.query_tokens("Найди Ni-Cu и никель, the a NiSO4 никель") == ["ni-cu", "никель", "niso4"]
    assert terms.expanded("what", ["Copper", "copper ", ""]) == "what\nCopper"
    assert terms.expanded("patent on copper").endswith("patent") and terms.expanded("x", fact_type="contradiction").startswith("x\nпротиворечие ;")
    assert terms.soft_terms(["выщелачивание никеля", "the Ni", "процесс"]) == ["выщелачив", "никеля"]
    assert terms.soft_stem("so4") == "so4" and terms.soft_stem("обжигание") == "обжиг"
    assert terms.topic_stems(["автоклавным выщелачиванием", "печь эксперты"]) == ["автоклав", "выщелачи"]
    assert terms.fallback_terms("What is SO4 of ore body") == ["what", "body"]
    assert terms.material_places("Ni and nickel, Nice", ["ni"]) == [(0, "ni"), (7, "ni")]


def test_column_terms(spark):
    df = spark.createDataFrame([(["Brand#11", "other"], 0.0, "a<b>&\n'"), ([], 2.0, None)], "names array<string>, c double, t string")
    got = df.select(terms.holding("names", ["brand#1", "x"]).alias("h"), terms.clamped("c", 0.7).alias("c"), terms.html_text("t").alias("t")).collect()
    assert [tuple(r) for r in got] == [(1, 0.7, "a&lt;b&gt;&amp;<br/>&#x27;"), (0, 1.0, None)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Recovery of Cu was 96 % in the test", True),
        ("Recovery of Cu was 93 % in the test", False),
        ("Recovery: Zn 96 %" + " " * 100 + "and Cu", False),  # nearest to another metal
        ("Cu was 96 %", False),  # nothing says that it is a recovery
        ("recovery Cu" + " " * 400 + "96 %", False),
        ("recovery of 96 %", False),
        (None, False),
    ],
)
def test_guard(text, found):
    assert extraction.passes_guard(text, ["cu"], [Constraint("extraction_recovery", ">=", value=95, unit="%")]) is found
    assert extraction.passes_guard(text, [], [Constraint("x", unit="%")]) and extraction.passes_guard(text, ["cu"], [])


def test_guard_wants_one_passage():
    both = [Constraint("temperature", ">", value=100, unit="degC"), Constraint("content", "<", value=5, unit="g/t")]
    assert extraction.passes_guard("Cu at 150 °C with 2 g/t", ["cu"], both)
    assert not extraction.passes_guard("150 °C" + " " * 300 + "Cu" + " " * 300 + "2 g/t", ["cu"], both)
    assert extraction.passes_guard("Cu", ["cu"], [Constraint("content", "<", value=5, unit="kWh")])  # a unit that texts don't show


def test_measurement_confidence():
    (found,) = extraction.measurements("температура 20-30 °C")
    assert found["parameter"] == "temperature" and found["confidence"] == 0.98
    (bare,) = extraction.measurements("5 kwh")
    assert bare["parameter"] == extraction.UNNAMED and bare["confidence"] == 0.8
    assert extraction.measurements("модуль 4-11 5 %") == []


def test_mended_texts():
    assert chunking.mended("медно-\nникелевых руд\n12\n| 4\nдлина – 5\r\n\n• one\n2) two") == "медно-никелевых руд длина - 5\n• one\n2) two"
    assert chunking.mended("some text\nHEADING HERE\nmore") == "some text\nHEADING HERE more"
    assert chunking.mended(None) == chunking.mended("\n7\n") == ""
    long = "word " * 20 + "end."
    assert chunking.mended(f"{long}\nA new sentence begins here now") == f"{' '.join(long.split())}\nA new sentence begins here now"


def test_pieces():
    text = "\n\n".join(f"Paragraph {k} " + "x" * 60 for k in range(6))
    packed = chunking.pieces(text, 160, 0)
    assert len(packed) == 3 and all(len(p) <= 160 for p in packed)
    tails = chunking.pieces(text, 160, 10)
    assert tails[0] == packed[0] and tails[1] == packed[0][-10:].strip() + "\n" + packed[1]
    cut = chunking.pieces("One sentence here. " * 40, 100, 20)
    assert all(len(p) <= 121 for p in cut) and cut[0].endswith("here.")
    assert chunking.pieces("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50] and chunking.pieces(" ", 9) == []


def test_chunk_documents(spark):
    schema = "document_id string, content_type string, pages array<struct<page:int,text:string>>, slides array<struct<slide:int,text:string>>, paragraphs array<string>, tables array<struct<table_index:int,rows:array<array<string>>>>, sheets array<struct<sheet_name:string,rows:array<array<string>>>>"
    rows = [
        ("p", "pages", [(1, "First page text"), (2, "7"), (3, "x" * 90), (4, None)], None, None, None, None),
        ("d", "document", None, None, ["One paragraph", " ", "Another one"], [(1, [["a", " b "], ["", None], ["c", "d"]])], None),
        ("s", "spreadsheet", None, None, None, None, [("B", [["1", "2"]]), ("A", [["3"], [""], ["4"]])]),
        ("u", "unknown", [(1, "text")], None, None, None, None),
    ]
    got = chunking.chunk_documents(spark.createDataFrame(rows, schema), 100, 0, 1).orderBy("document", "chunk").collect()
    assert [(r["document"], r["chunk"], r["section"], r["first"], r["last"], r["text"]) for r in got] == [
        ("d", 0, "paragraph_text", None, None, "One paragraph Another one"),
        ("d", 1, "table_1", None, None, "row_1: a | b row_3: c | d"),
        ("p", 0, "page_text", 1, 1, "First page text"),
        ("p", 1, "page_text", 3, 3, "x" * 90),
        ("s", 0, "B", 1, 1, "row_1: 1 | 2"),
        ("s", 1, "A", 1, 3, "row_1: 3 row_3: 4"),
    ]
    assert all(r["chunk_id"].startswith("chunk_") and len(r["chunk_id"]) == 22 for r in got)
    online = chunking.chunk_online(spark.createDataFrame([("a", 1, "short"), ("a", 2, "x" * 150)], "d string, n int, t string"), "d", "n", "t", 100, 0).orderBy("chunk").collect()
    assert [(r["page"], len(r["text"])) for r in online] == [(1, 5), (2, 100), (2, 50)]


def test_answers_become_tables(spark):
    answer = {"entities": [{"type": "Odd", "name": " Ni ", "aliases": ["a"] * 15, "confidence": 2}, {"name": " "}], "relations": [{"type": "PRODUCES_OUTPUT", "source_name": "Ni", "target_name": "Cu", "evidence_text": "e"}, {"source_name": "Ni"}], "facts": [{"claim_text": "c", "year": "x", "geo_scope": "mars", "quote": "q", "numeric_value_ids": ["1"]}, {"quote": "none"}], "warnings": [" w ", ""]}
    rows = [("d", "c1", "```json\n" + json.dumps(answer) + "\n```"), ("d", "c2", "Here: " + json.dumps({"entities": []}) + " end"), ("d", "c3", "nothing"), ("d", "c4", None), ("d", "c5", '{"facts": [{"claim_text": "trailing",}],}')]
    done = records.normalised(spark.createDataFrame(rows, "document_id string, chunk_id string, response string").withColumn("page_start", F.lit(1)))
    got = {r["chunk_id"]: r for r in done.collect()}
    assert [got[f"c{k}"]["parsed"] for k in range(1, 6)] == [True, True, False, False, True]
    (entity,), (relation,), (fact,) = got["c1"]["entities"], got["c1"]["relations"], got["c1"]["facts"]
    assert (entity["type"], entity["name"], entity["canonical_name"], len(entity["aliases"]), entity["confidence"]) == ("Material", "Ni", "Ni", 10, 1.0)
    assert relation["confidence"] == 0.75 and (fact["fact_type"], fact["geo_scope"], fact["year"], fact["confidence"], fact["subject"]) == ("experimental_result", "unknown", None, 0.9, "c")
    assert got["c1"]["warnings"] == ["w"] and got["c3"]["entities"] == [] and got["c5"]["facts"][0]["claim_text"] == "trailing"
    tables = records.attached(done)
    assert tables["facts"].count() == 2 and tables["entities"].first()["id"].startswith("ent_") and tables["facts"].first()["status"] == "auto_extracted"


def test_relations_find_their_ends(spark):
    entities = spark.createDataFrame([("d", "e1", 0, "Nickel ore", "nickel ore", ["никель"]), ("d", "e2", 1, "Autoclave leaching", "autoclave leaching", []), ("x", "e3", 0, "Copper", "copper", [])], "document_id string, entity_id string, at int, name string, canonical_name string, aliases array<string>")
    known = records.aliases(entities)
    rows = spark.createDataFrame([("d", "T", "Nickel  ORE", "leaching"), ("d", "T", "nickel ore", "Никель"), ("d", "T", "nickel ore", "Copper")], "document_id string, type string, source_name string, target_name string")
    linked, lost = records.linked_relations(rows, known)
    assert [(r["source_entity_id"], r["target_entity_id"]) for r in linked.collect()] == [("e1", "e2")]
    assert [tuple(r) for r in lost.collect()] == [("d", 2)]
    assert tuple(records.list_totals(entities, "aliases").first()) == (1,)
    first = records.first_of(spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "id string, at int"), "id", ["at"])
    assert sorted(r["at"] for r in first.collect()) == [1, 3, 4]


def test_short_forms(spark):
    nodes = spark.createDataFrame([("n", "t" * 170, "x" * 300, "c", 5)], "id string, title string, text string, claim_text string, secret int")
    got = projections.compact_nodes(nodes).first()
    assert len(got["title"]) == 158 and len(got["text_preview"]) == 241 and got["claim_preview"] == "c" and "secret" not in got.asDict()
    edges = projections.compact_edges(spark.createDataFrame([("a", "b", "q" * 200, 1)], "src string, dst string, quote string, other int")).first()
    assert len(edges["quote"]) == 178 and edges["src"] == "a"
    assert projections.entity_rows(spark.createDataFrame([("e", "", "Process")], "id string, entity_type string, type string")).first()["type"] == "Process"
    assert projections.value_rows(spark.createDataFrame([("v", None, "g/t")], "id string, unit_normalized string, unit_original string")).first()["unit"] == "g/t"
    hits = spark.createDataFrame([(1, "d", 0.5, "a"), (1, "d", 0.4, "b"), (2, "d", 0.3, "c"), (3, "d", 0.2, "e"), (4, None, 0.1, "f")], "chunk_id int, document_id string, score double, text string")
    assert [(r["evidence_id"], r["chunk_id"]) for r in projections.evidence(hits, 14).orderBy("evidence_id").collect()] == [("E1", 1), ("E2", 2), ("E3", 4)]
    facts = spark.createDataFrame([(1, "T", 0.4), (2, "U", None)], "fact_id int, source_title string, confidence double")
    assert projections.source_count(facts, hits.withColumn("document", F.lit("T"))).first()["sources"] == 2
    assert projections.mean_confidence(facts).first()["confidence"] == 0.2 and projections.mean_confidence(facts.limit(0)).first()["confidence"] == 0.0
    text = spark.createDataFrame([("see [E1], [E2] and [E1]", 0.0)], "t string, c double")
    guards = [projections.citations("t"), projections.guarded_confidence(F.col("c"), F.lit(2), projections.citations("t"), F.lit(False)), projections.guarded_confidence(F.lit(0.9), F.lit(1), F.lit(1), F.lit(True)), projections.guarded_confidence(F.lit(0.9), F.lit(1), F.lit(1), F.lit(False), F.lit(True)), projections.fallback_confidence(F.lit(0), F.lit(3))]
    assert tuple(text.select(*guards).first()) == (2, 0.45, 0.65, 0.35, 0.55)
    stamped = spark.createDataFrame([Row(id=1, at=datetime.datetime(2020, 1, 2), inner=Row(day=datetime.date(2020, 3, 4)))])
    assert json.loads(projections.json_ready(stamped, "id").first()["json"])["inner"]["day"] == "2020-03-04"


def test_updates_make_versions(spark):
    facts = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.6)], "fact_id int, status string, confidence double")
    patches = spark.createDataFrame([(1, "c", None), (2, None, None)], "fact_id int, status string, confidence double")
    stamp = F.lit("2020-01-01").cast("timestamp")
    after = changes.patched(facts, patches, stamp=stamp)
    assert sorted((r["fact_id"], r["status"], r["confidence"], r["updated_at"] is not None) for r in after.collect()) == [(1, "c", 0.5, True), (2, "b", 0.6, False)]
    existing = spark.createDataFrame([(1, 3)], "fact_id int, version int")
    (row,) = changes.version_rows(facts, after, existing, patches.where("fact_id = 1"), "me").collect()
    assert row["version"] == 4 and json.loads(row["previous"])["status"] == "a" and json.loads(row["new"])["status"] == "c"
    log = changes.audit_rows(spark.createDataFrame([("search", "q")], "action string, query string")).first()
    assert log["id"].startswith("audit_") and log["role"] == "external_partner" and log["query"] == "q" and log["created_at"] is not None


def test_experts(spark):
    rows = [(1, "Исследования ведёт ООО «Ги про никель», а также лаборатория отлично справилась."), (2, "ООО «Гипроникель» проводит испытания"), (3, "Институт Гинцветмет"), (4, None), (5, "ООО «Просто Рога» продаёт")]
    found = experts.ranked_experts(experts.expert_mentions(spark.createDataFrame(rows, "chunk_id int, text string"))).collect()
    assert [(r["name"], r["kind"], r["evidence"]) for r in found] == [("ООО «Гипроникель»", "institute", 2), ("Институт Гинцветмет", "institute", 1)]
    assert experts.plausible("Лаборатория Гидрометаллургии") and not experts.plausible("лаборатория отлично") and not experts.plausible("ООО и АО")
    patents = experts.patents(spark.createDataFrame([(1, "патент РФ № 1234567, US-20100/1234."), (2, "Патент  РФ № 1234567")], "chunk_id int, text string"))
    assert sorted((r["key"], r["mentions"], r["chunk_id"]) for r in patents.collect()) == [("us-20100/1234", 1, 1), ("патент рф № 1234567", 2, 1)]


def test_model_slots(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, None)], "chunk_id int, text string")
    vectors = {r["chunk_id"]: r["vector"] for r in models.encoded(chunks).collect()}
    assert len(vectors[1]) == 64 and sum(x * x for x in vectors[1]) == pytest.approx(1) and not any(vectors[2])
    assert {r["chunk_id"]: r["logit"] for r in models.reranked(chunks, "a c").collect()} == {1: 0.5, 2: 0.0}
    assert {r["chunk_id"]: r["response"] for r in models.extracted(chunks, lambda texts: [f"{{{len(t)}}}" for t in texts]).collect()} == {1: "{3}", 2: "{0}"}


def test_small_retrieval_operators(spark):
    df = spark.createDataFrame([("1999",), ("x",), ("2200",), (None,)], "y string")
    assert [r[0] for r in df.select(retrieval.in_years("y", 1990, 2300)).collect()] == [True, False, False, False]
    assert retrieval.widened(100, True) == 1000 and retrieval.widened(100, False) == 100
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0])], "chunk_id int, vector array<double>")
    overlay = spark.createDataFrame([(1, [0.1, 0.0]), (3, [0.9, 0.0])], "chunk_id int, vector array<double>")
    assert sorted((r["chunk_id"], r["score"]) for r in retrieval.dense_overlay(base, overlay, [1.0, 0.0], 5, 5).collect()) == [(1, 0.1), (2, 0.5), (3, 0.9)]
