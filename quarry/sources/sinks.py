"""Sinks: tables, document records into node and edge tables, split writes, exports."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from quarry.functions.text import relation_type
from quarry.operators.changes import audit_rows, repeated_keys, typed


#: How rows are counted whose value isn't among those counted by themselves.
OTHER = "other"


def explode_documents(documents: DataFrame) -> dict[str, DataFrame]:
    """Nested document records as tables of nodes and edges.

    Of each edge both ends must exist in the same document.  Columns: document_id, source, chunks, entities,
    numeric_values, facts, relations (arrays of structs); entities and values may have source_chunk_id, facts a chunk_id
    in their source.
    """
    each = lambda c: documents.select("document_id", F.explode(c).alias("x")).select("document_id", "x.*")
    chunks, values, facts = each("chunks"), each("numeric_values"), each("facts")
    entities = typed(each("entities"))
    ends = lambda df, name: df.select("document_id", F.col("id").alias(name)).distinct()
    between = lambda edges, left, right, a, b: edges.join(ends(left, a), ["document_id", a], "left_semi").join(ends(right, b), ["document_id", b], "left_semi").distinct()

    def from_chunk(rows: DataFrame, name: str) -> DataFrame:
        of = F.col("source_chunk_id") if "source_chunk_id" in rows.columns else F.lit(None).cast("string")
        return between(rows.select("document_id", F.col("id").alias(name), of.alias("chunk_id")), rows, chunks, name, "chunk_id")

    about = facts.select("document_id", F.col("id").alias("fact_id"), F.explode(F.array_union(F.array("subject_entity_id"), "object_entity_ids")).alias("entity_id"))
    has = facts.select("document_id", F.col("id").alias("fact_id"), F.explode("numeric_value_ids").alias("value_id"))
    support = F.col("source.chunk_id") if "chunk_id" in facts.schema["source"].dataType.names else F.lit(None).cast("string")
    supported = facts.select("document_id", F.col("id").alias("fact_id"), support.alias("chunk_id"))
    described = facts.select("document_id", F.col("id").alias("fact_id"), "source.page", "source.quote").join(documents.select("document_id", F.col("source.id").alias("source_id")), "document_id")
    relations = each("relations").withColumn("type", relation_type("type"))
    for end in ("source_entity_id", "target_entity_id"):
        relations = relations.join(ends(entities, end), ["document_id", end], "left_semi")
    return {
        "sources": documents.select("document_id", "source.*"),
        "chunks": chunks,
        "entities": entities,
        "numeric_values": values,
        "facts": facts,
        "about": between(about, facts, entities, "fact_id", "entity_id"),
        "has_parameter": between(has, facts, values, "fact_id", "value_id"),
        "supported_by": between(supported, facts, chunks, "fact_id", "chunk_id"),
        "mentioned_in": from_chunk(entities, "entity_id"),
        "extracted_from": from_chunk(values, "value_id"),
        "described_in": described.distinct(),
        "part_of": chunks.select("document_id", F.col("id").alias("chunk_id")).join(documents.select("document_id", F.col("source.id").alias("source_id")), "document_id").distinct(),
        "relations": relations.dropDuplicates(["document_id", "source_entity_id", "target_entity_id", "type"]),
    }


def check_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows; an error where a key isn't unique."""
    if not repeated_keys(rows, key).isEmpty():
        raise ValueError(f"{key} isn't unique")
    return rows


def append_audit(events: DataFrame, folder: str) -> None:
    """Appends events to the audit log."""
    audit_rows(events).write.mode("append").parquet(folder)


def written_with_counts(rows: DataFrame, folder: str, counters: dict[str, Sequence[object]], good: Column | None = None, kind: str = "parquet") -> tuple[dict[str, int], list[Row]]:
    """Overwrites a folder with rows and counts them in the same pass: totals, and rows by attributes.

    counters: for each attribute the values that are counted by themselves; all others, and nulls, count as `other`.
    Given several attributes, their combinations are counted.  good is a condition: totals hold rows, succeeded and failed.
    The second is one row a combination that occurs: the attributes and cnt.
    """
    ok = F.coalesce(good, F.lit(False)) if good is not None else F.lit(True)
    labels = {name: [*map(str, values), OTHER] for name, values in counters.items()}
    # the combination's place among all of them; one metric counts each place
    place = F.lit(0)
    for name, values in labels.items():
        known = F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.coalesce(F.col(name).cast("string"), F.lit(OTHER))), F.lit(0))
        place = place * len(values) + F.when(known > 0, known - 1).otherwise(len(values) - 1)
    every = list(itertools.product(*labels.values())) if labels else []
    seen = Observation()
    metrics = [F.count_if(place == k).alias(f"c{k}") for k in range(len(every))]
    watched = rows.observe(seen, F.count("*").alias("rows"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), *metrics)
    watched.write.mode("overwrite").format(kind).save(folder)
    told = seen.get
    totals = {name: int(told.get(name) or 0) for name in ("rows", "succeeded", "failed")}
    counted = [Row(**dict(zip(labels, values, strict=True)), cnt=int(told[f"c{k}"])) for k, values in enumerate(every) if told.get(f"c{k}")]
    return totals, counted


def split_errors(rows: DataFrame, good: str, bad: str, clip: int = 10_000) -> None:
    """Writes rows without an error and rows with one to two places; raw responses of the latter are cut."""
    rows.where("error IS NULL").drop("error").write.mode("append").json(good)
    failed = rows.where("error IS NOT NULL")
    (failed.withColumn("response", F.substring("response", 1, clip)) if "response" in rows.columns else failed).write.mode("append").json(bad)


def json_ld(facts: DataFrame) -> DataFrame:
    """Facts as JSON-LD objects, one a row: fact_id, json."""
    body = F.struct(F.lit("Claim").alias("@type"), F.concat(F.lit("fact:"), F.col("fact_id")).alias("@id"), *(c for c in facts.columns if c != "fact_id"))
    return facts.select("fact_id", F.to_json(body).alias("json"))


def markdown(title: str, facts: DataFrame, most: int = 500) -> str:
    """A report on a bounded number of facts."""
    rows = facts.limit(most).collect()
    return "\n".join([f"# {title}", "", *(f"- **{r['fact_id']}** {', '.join(f'{k}: {v}' for k, v in r.asDict().items() if k != 'fact_id' and v is not None)}" for r in rows)])
