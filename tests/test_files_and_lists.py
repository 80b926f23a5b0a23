"""Workbooks, overlays, exports, error files, lists of groups, and units of length."""

import io
import json
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import extraction, graph, projections, summaries
from quarry.sources import readers, sinks

SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(sheets, shared):
    """A workbook of sheets (name, rows of cells); a number is a shared string's place, a text stands inline."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as whole:
        whole.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET}"><sheets>' + "".join(f'<sheet name="{name}"/>' for name, _ in sheets) + "</sheets></workbook>")
        whole.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for k, (_, rows) in enumerate(sheets, 1):
            cells = lambda row: "".join(f'<c t="s"><v>{c}</v></c>' if isinstance(c, int) else f'<c t="inlineStr"><is><t>{c}</t></is></c>' if isinstance(c, str) else f"<c><v>{c}</v></c>" for c in row)
            whole.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{SHEET}"><sheetData>' + "".join(f"<row>{cells(row)}</row>" for row in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks_are_read_sheet_by_sheet(spark, tmp_path):
    content = workbook([("First", [[0, 1], [2.5, "inline"], ["", ""]]), ("Second", [[1]])], ["name", "value"])
    assert readers.read_xlsx(content) == ["Sheet: First\nname\tvalue\n2.5\tinline", "Sheet: Second\nvalue"]
    (tmp_path / "a.xlsx").write_bytes(content)
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.txt").write_text("one page")
    (tmp_path / "d.exe").write_text("not admitted")
    got = {(r["path"].rsplit("/", 1)[1], r["page"]): (r["status"], r["text"].split("\n")[0]) for r in readers.file_pages(spark, str(tmp_path)).collect()}
    assert got == {("a.xlsx", 1): ("ok", "Sheet: First"), ("a.xlsx", 2): ("ok", "Sheet: Second"), ("broken.xlsx", 1): ("error", "[this file can't be read: BadZipFile]"), ("c.txt", 1): ("ok", "one page")}


def test_overlays_take_the_place_of_documents(spark, tmp_path):
    write = lambda name, body: (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body))
    write("b.json", {"document_id": "d1", "chunks": [{"chunk_id": "c1", "text": "new text"}, {"chunk_id": None, "text": "no id"}, {"chunk_id": "c3", "text": " "}]})
    write("a.json", {"document_id": "d9", "chunks": [{"chunk_id": "c9", "text": "another", "page": 4}]})
    write("c.json", "{not json")
    write("d.json", {"document_id": None, "chunks": []})
    chunk = T._parse_datatype_string("chunk_id string, text string, page int")
    overlay = readers.overlay_chunks(spark, str(tmp_path), chunk)
    assert sorted((r["document_id"], r["chunk_id"], r["text"], r["page"]) for r in overlay.collect()) == [("d1", "c1", "new text", None), ("d9", "c9", "another", 4)]
    base = spark.createDataFrame([("d1", "c1", "old", "x"), ("d1", "c2", "old too", "x"), ("d2", "c5", "stays", "y")], "document_id string, chunk_id string, text string, lang string")
    whole = {(r["document_id"], r["chunk_id"]): (r["text"], r["lang"]) for r in readers.with_overlay(base, overlay).collect()}
    assert whole == {("d1", "c1"): ("new text", None), ("d2", "c5"): ("stays", "y"), ("d9", "c9"): ("another", None)}


def test_exports(spark):
    facts = spark.createDataFrame([(1, "claim one", 0.5), (2, None, None)], "fact_id long, claim_text string, confidence double")
    found = {r["fact_id"]: json.loads(r["json"]) for r in sinks.json_ld(facts).collect()}
    assert found[1] == {"@type": "Claim", "@id": "fact:1", "claim_text": "claim one", "confidence": 0.5} and found[2] == {"@type": "Claim", "@id": "fact:2"}
    text = sinks.markdown("Report", facts.orderBy("fact_id"))
    assert text.split("\n")[0] == "# Report" and "- **1** claim_text: claim one, confidence: 0.5" in text and "- **2** " in text
    assert len(sinks.markdown("Few", facts, 1).split("\n")) == 3


def test_errors_go_to_a_file_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good", None), (2, "b" * 50, "bad")], "id long, response string, error string")
    sinks.split_errors(rows, str(tmp_path / "good"), str(tmp_path / "bad"), clip=10)
    assert [r["id"] for r in spark.read.json(str(tmp_path / "good")).collect()] == [1]
    assert [(r["id"], r["response"], r["error"]) for r in spark.read.json(str(tmp_path / "bad")).collect()] == [(2, "b" * 10, "bad")]


def test_vectors_and_results_of_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, vector array<double>")
    assert [r["id"] for r in readers.vectors(rows, 2).collect()] == [1]
    (tmp_path / "one.full.json").write_text(json.dumps({"query": "a", "facts": []}, indent=1))
    (tmp_path / "two.json").write_text("{}")
    assert [r["query"] for r in readers.result_files(spark, str(tmp_path)).collect()] == ["a"]


def test_groups_list_their_members_in_rank_order(spark):
    rows = [(1, "x", 0.5, 2001), (2, "x", None, 1990), (3, "x", float("nan"), 1990), (4, "x", 0.5, 12_000), (5, "x", 0.5, None), (6, None, 0.1, 2000), (7, "", 0.2, 2000)]
    facts = spark.createDataFrame(rows, "fact_id long, kind string, confidence double, year int")
    got = {r["kind"]: r["fact_ids"] for r in summaries.members(facts, "kind").collect()}
    assert got == {"x": [2, 3, 5, 4, 1], "unknown": [7, 6]}


def test_short_facts_and_shown_nodes(spark):
    facts = spark.createDataFrame([(1, "c" * 1000, "t", 0.5, "title", 3), (2, "short", "t", 0.9, "title", 4)], "fact_id long, claim_text string, fact_type string, confidence double, source_title string, source_page int")
    (best,) = projections.compact_facts(facts, [F.desc("confidence")], 1).collect()
    assert (best["fact_id"], best["claim"], best["source"]) == (2, "short", "title")
    long = projections.compact_facts(facts, [F.asc("confidence")], 1).first()
    assert len(long["claim"]) == projections.CLAIM + 1 and long["claim"].endswith("…")
    nodes = spark.createDataFrame([("a", None, "canon", "name"), ("b", "claim", "canon", "name"), ("c", None, None, None)], "id string, claim_text string, canonical_name string, name string")
    assert {r["id"]: r["title"] for r in graph.shown(nodes).collect()} == {"a": "canon", "b": "claim", "c": "c"}


def test_lengths_are_measured_where_asked(spark):
    text = "длина 10 м и ширина 5-7 мм, 4-11 Металлургия, 3 km, 2 мг/л"
    assert [m["unit"] for m in extraction.measurements(text)] == ["mg/L"]
    found = extraction.measurements(text, lengths=True)
    assert [(m["unit"], m["value"], m["value_min"], m["value_max"]) for m in found] == [("m", 10.0, None, None), ("mm", None, 5.0, 7.0), ("km", 3.0, None, None), ("mg/L", 2.0, None, None)]
    df = spark.createDataFrame([(1, text)], "chunk_id long, text string")
    assert extraction.numeric_values(df, lengths=True).count() == 4 and extraction.numeric_values(df).count() == 1
