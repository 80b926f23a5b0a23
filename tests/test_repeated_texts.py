"""Texts that many rows share are read once each, and names that have equals are looked up alone."""

import pytest

from quarry.functions.numeric import Constraint
from quarry.operators import entities, extraction
from quarry.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_of_repeated_texts(spark):
    rows = [("a", "Temperature 20-30 °C, copper recovery 90 %."), ("b", "Temperature 20-30 °C, copper recovery 90 %."), ("b", "5 mg/l"), ("c", "no figures"), ("d", None), (None, "5 mg/l")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    once, each = extraction.numeric_values(chunks, repeated=True), extraction.numeric_values(chunks)
    assert once.dtypes == each.dtypes
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, each.collect()), key=str) and once.count() == 6


def test_verdicts_of_repeated_texts(spark):
    rows = [(1, "copper recovery 90 %"), (2, "copper recovery 90 %"), (2, "copper recovery 1 %"), (3, "zinc 90 %"), (4, None), (None, "copper recovery 90 %")]
    chunks = spark.createDataFrame(rows, "chunk_id int, text string")
    recovery, asked = [Constraint("extraction_recovery", ">=", value=5, unit="%")], {"copper": ["cu"], "zinc": ["zn"], "any": []}
    got = [tuple(r) for r in extraction.guard_verdicts(chunks, asked, recovery).collect()]
    assert sorted(got, key=str) == sorted([(*r, *(extraction.passes_guard(r[1], m, recovery) for m in asked.values())) for r in rows], key=str)
    assert sum(x[2] for x in got) == 3 == extraction.guarded(chunks, ["cu"], recovery).count()


@pytest.mark.parametrize("name", ["numeric_extract_templated", "contextual_guard", "table_function_values"])
def test_python_reads_different_texts_alone(spark, sf_dir, name):
    found = plan(registry.queries()[name](spark, sf_dir))
    assert not any(x in found for x in ("MapInPandas", "ArrowEvalPython", "PythonUDTF"))  # the rows of lines don't go to Python


def test_names_that_all_have_equals_need_no_containment(spark):
    asked = spark.createDataFrame([("d", "Nickel Ore"), ("d", "nickel  ore"), ("e", "ёлка"), ("e", None)], "document string, name string")
    known = spark.createDataFrame([("d", "e2", "nickel ore"), ("d", "e1", "NICKEL ORE"), ("e", "e3", "Елка")], "document string, entity_id string, name string")
    found = entities.resolved(asked, known, "document")
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("d", "Nickel Ore", "e1", "exact"), ("d", "nickel  ore", "e1", "exact"), ("e", "ёлка", "e3", "exact")]
    keys = known.selectExpr("document", "min(entity_id) OVER (PARTITION BY document) AS entity_id", "translate(lower(name), 'ё', 'е') AS name").distinct()
    assert sorted(entities.resolved(asked, keys, "document", keyed=True).collect()) == sorted(found.collect())
    some = entities.resolved(asked.unionByName(spark.createDataFrame([("d", "ore of nickel ore")], asked.schema)), known.where("entity_id <> 'e1'"), "document")
    assert ("d", "ore of nickel ore", "e2", "contained") in set(map(tuple, some.collect()))
