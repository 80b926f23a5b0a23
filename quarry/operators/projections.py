"""Facts, entities, values, sources and graph elements as they are shown: nested rows, short forms, comparison rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clip, range_text

# fixed values: attributes of nodes and edges that short forms keep, and the most characters of their texts
NODE_KEYS = ("id", "name", "canonical_name", "title", "label", "entity_type", "claim_text", "fact_type", "geo_scope", "country", "year", "status", "confidence", "verification_level", "source_type", "access_level", "organization", "parameter", "display_name", "value", "value_min", "value_max", "comparator", "unit_normalized", "unit_original", "page", "document_id", "filename")
EDGE_KEYS = ("id", "page", "quote", "confidence", "evidence_text", "source_id", "access_level")
TEXT_PREVIEW, CLAIM_PREVIEW, TITLE, QUOTE, CLAIM, EXCERPT = 240, 220, 160, 180, 900, 900
# fixed values: entity types that count as a technology in a comparison
TECHNOLOGY = ("TechnologySolution", "Equipment", "Process")


def _first(df: DataFrame, *names: str) -> Column:
    """The first of some columns, as far as they exist, that is neither null nor empty."""
    there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def _fields(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]


def entity_rows(nodes: DataFrame) -> DataFrame:
    """Entities for display: id, type (entity_type, type, label or Entity), names, aliases, page, confidence, description."""
    kind = F.coalesce(_first(nodes, "entity_type", "type", "label"), F.lit("Entity")).alias("type")
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in nodes.columns else F.array().cast("array<string>")
    return nodes.select("id", kind, *_fields(nodes, "name", "canonical_name", "language"), aliases.alias("aliases"), *_fields(nodes, "page", "confidence", "description"))


def value_rows(values: DataFrame) -> DataFrame:
    """Values in short: id, parameter, value, value_min, value_max, comparator, unit (normalised, given or original)."""
    unit = _first(values, "unit_normalized", "unit", "unit_original").alias("unit")
    return values.select(*_fields(values, "id", "parameter", "value", "value_min", "value_max", "comparator"), unit)


def fact_rows(facts: DataFrame, sources: DataFrame, entities: DataFrame, values: DataFrame) -> DataFrame:
    """Facts with what belongs to them: one row for each fact and source.

    facts: fact_id, source_id and attributes; sources: source_id, title, page, quote and others; entities and values:
    fact_id and attributes, gathered before they are joined, as entities and numeric_values (sorted arrays of structs).
    """
    gather = lambda rows, name: rows.groupBy("fact_id").agg(F.array_sort(F.collect_set(F.struct(*(c for c in rows.columns if c != "fact_id")))).alias(name))
    source = sources.select("source_id", F.struct(*sources.columns).alias("source"))
    out = facts.join(source, "source_id", "left").join(gather(entities, "entities"), "fact_id", "left").join(gather(values, "numeric_values"), "fact_id", "left")
    for name in ("title", "page", "quote"):
        if name in sources.columns:
            out = out.withColumn(f"source_{name}", F.col(f"source.{name}"))
    return out


def flattened(rows: DataFrame) -> DataFrame:
    """One row for each fact and value of it: fact_id and the value's fields."""
    return rows.select("fact_id", F.inline("numeric_values"))


def _shown_value(v: Column) -> Column:
    return F.trim(F.concat(range_text(v["value_min"], v["value"], v["value_max"]), F.lit(" "), F.coalesce(v["unit"], F.lit(""))))


def comparison(rows: DataFrame, key: str) -> DataFrame:
    """Rows of `fact_rows` side by side: fact_id, group, technology, claim, numeric_parameters, capex, opex and attributes.

    entities have name and type, numeric_values parameter, value, value_min, value_max and unit.
    """
    methods = F.transform(F.filter("entities", lambda e: e["type"].isin(*TECHNOLOGY)), lambda e: e["name"])
    technology = F.nullif(F.substring(F.array_join(F.array_compact(methods), ", "), 1, 240), F.lit(""))
    texts = F.transform("numeric_values", lambda v: F.trim(F.concat(v["parameter"], F.lit(": "), _shown_value(v))))
    figure = lambda name: F.coalesce(F.get(F.transform(F.filter("numeric_values", lambda v: F.lower(v["parameter"]) == name), _shown_value), F.lit(0)), F.lit("—"))
    group = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown"))
    there = [c for c in ("geo_scope", "country", "year", "confidence", "status", "source_title", "source_page") if c in rows.columns]
    return rows.select("fact_id", group.alias("group"), F.coalesce(technology, F.lit("—")).alias("technology"), *_fields(rows, "claim_text"), F.coalesce(F.nullif(F.array_join(texts, "; "), F.lit("")), F.lit("—")).alias("numeric_parameters"), figure("capex").alias("capex"), figure("opex").alias("opex"), *there)


def compact_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with the attributes that are shown, long texts as previews (text_preview, claim_preview, a shorter title)."""
    out = nodes.select(*(c for c in NODE_KEYS if c in nodes.columns and c != "title"), *(_cut("title", TITLE, TITLE - 3).alias("title") for _ in [0] if "title" in nodes.columns), *(_cut("text", TEXT_PREVIEW).alias("text_preview") for _ in [0] if "text" in nodes.columns))
    return out.withColumn("claim_preview", _cut("claim_text", CLAIM_PREVIEW)) if "claim_text" in nodes.columns else out


def compact_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, type) with the attributes that are shown, long quotes cut."""
    short = [_cut(c, QUOTE, QUOTE - 3).alias(c) if c in ("quote", "evidence_text") else F.col(c) for c in EDGE_KEYS if c in edges.columns]
    return edges.select(*(c for c in ("src", "dst", "type") if c in edges.columns), *short)


def _cut(text: str, most: int, kept: int | None = None) -> Column:
    """A text of more than `most` characters as its first ones and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept or most), F.lit("…"))).otherwise(F.col(text))


def compact_facts(facts: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first facts in short: fact_id, claim (900 characters), fact_type, confidence, source, page."""
    first = facts.orderBy(*order).limit(limit)
    return first.select("fact_id", clip(_first(facts, "claim_text", "claim", "text"), CLAIM).alias("claim"), *_fields(facts, "fact_type", "confidence"), _first(facts, "source_title", "title").alias("source"), *_fields(facts, "source_page"))


def evidence(hits: DataFrame, limit: int, excerpt: int = EXCERPT, each: int = 2, order: Sequence[Column] | None = None) -> DataFrame:
    """Retrieved texts as numbered evidence (E1, E2, ...): each chunk once, at most `each` of a document, `limit` in all.

    hits: chunk_id, document_id, score, text (a bounded pool); in order of score, then chunk_id, unless told.
    """
    by = list(order or (F.desc("score"), F.col("chunk_id")))
    key = F.coalesce(_first(hits, "document_id", "filename"), F.col("chunk_id").cast("string"))
    once = hits.withColumn("_again", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*by))).where("_again = 1")
    few = once.withColumn("_key", key).withColumn("_of", F.row_number().over(Window.partitionBy("_key").orderBy(*by))).where(F.col("_of") <= each)
    numbered = few.orderBy(*by).limit(limit).withColumn("_place", F.row_number().over(Window.orderBy(*by)))
    document = F.coalesce(_first(hits, "filename", "document_id"), F.lit("unknown"))
    return numbered.select(F.concat(F.lit("E"), "_place").alias("evidence_id"), "chunk_id", "document_id", document.alias("document"), *_fields(hits, "source_type", "page_start"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), clip("text", excerpt).alias("excerpt"))


def source_count(facts: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many different sources facts and evidence name together (sources)."""
    titles = facts.select(_first(facts, "source_title", "title").alias("source")).unionByName(found.select(_first(found, "document", "filename", "document_id").alias("source")))
    return titles.where("source IS NOT NULL").agg(F.count_distinct("source").alias("sources"))


def citations(text: Column | str) -> Column:
    """How many different pieces of evidence a text cites as [E1]."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(E\d+)\]"), F.lit(1))))


def guarded_confidence(confidence: Column, sources: Column, cited: Column, geography_open: Column, contradictions: Column | None = None) -> Column:
    """An answer's confidence after its guards: floors for cited answers, caps for open geography and contradictions."""
    # fixed values: floors of .45 and .35, caps of .65 and, for contradictions, .35 and .20
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.try_cast("double"), F.lit(0.5))))
    raised = F.when((sure == 0) & (sources >= 2) & (cited >= 2), 0.45).when((sure == 0) & (sources >= 1) & (cited >= 1), 0.35).otherwise(sure)
    capped = F.when(geography_open, F.least(raised, F.lit(0.65))).otherwise(raised)
    if contradictions is None:
        return capped
    return F.when(contradictions, F.least(capped, F.when(cited == 1, 0.35).otherwise(0.20))).otherwise(capped)


def fallback_confidence(facts: Column, found: Column) -> Column:
    """The confidence of an answer that no model wrote: .75 with facts, .55 with evidence alone, else 0."""
    return F.when(facts > 0, 0.75).when(found > 0, 0.55).otherwise(0.0)


def mean_confidence(facts: DataFrame) -> DataFrame:
    """One row: the mean confidence of facts to two digits, unknown ones as 0, 0 without facts."""
    return facts.agg(F.coalesce(F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 2), F.lit(0.0)).alias("confidence"))


def json_ready(rows: DataFrame, key: str) -> DataFrame:
    """Rows as JSON texts, times and dates in ISO form, nested ones too: key, json."""
    others = F.struct(*(c for c in rows.columns if c != key))
    return rows.select(key, F.to_json(others, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}).alias("json"))
