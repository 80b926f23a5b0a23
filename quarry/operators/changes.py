"""Tables that change: upserts, edges, deletions, versions, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import relation_type

# fixed values: types of entities; any other is an Entity
ENTITY_TYPES = ("Material", "Process", "Equipment", "Property", "Experiment", "Publication", "Expert", "Laboratory", "Facility", "TechnologySolution", "EconomicIndicator", "Geography", "Conclusion", "Topic", "Entity")


def latest(rows: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by order: an upsert's result, the current state of a registry."""
    keys = [key] if isinstance(key, str) else list(key)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows, replaced or joined by new ones of the same key."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def edges_between(links: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Links whose both ends exist, once each; others make no edge."""
    kept = links.join(left.select(left_key).distinct(), left_key, "left_semi").join(right.select(right_key).distinct(), right_key, "left_semi")
    return kept.dropDuplicates()


def relations(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with a clean type and both ends known: src, dst, type and the rest."""
    known = entities.select("entity_id").distinct()
    ends = rows.join(known.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(known.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    return ends.withColumn("type", relation_type("type")).dropDuplicates(["src", "dst", "type"])


def typed(entities: DataFrame) -> DataFrame:
    """Entities whose type is one of the known ones, or Entity."""
    return entities.withColumn("type", F.when(F.col("type").isin(*ENTITY_TYPES), F.col("type")).otherwise("Entity"))


def without_demo(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that aren't of the demonstration, and edges between them."""
    kept = nodes.where(~F.coalesce("demo", F.lit(False)))
    return kept, edges_between(edges, kept.select(F.col("id").alias("src")), kept.select(F.col("id").alias("dst")), "src", "dst")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that break a uniqueness constraint: key, cnt."""
    return rows.groupBy(key).agg(F.count("*").alias("cnt")).where("cnt > 1")


def versions(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Numbers each key's rows from 1, in order."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def patched(facts: DataFrame, patches: DataFrame, fields: Sequence[str] = ("status", "confidence", "geo_scope", "year"), stamp: Column | None = None) -> DataFrame:
    """Facts after partial updates (fact_id and some fields; null leaves a field), with updated_at where one changed.

    stamp is the time of the update, now by default.  facts without updated_at get the column.
    """
    given = [f for f in fields if f in patches.columns]
    some = F.coalesce(*(F.col(f).cast("string") for f in given)).isNotNull() if given else F.lit(False)
    renamed = patches.where(some).select("fact_id", *(F.col(f).alias("_" + f) for f in given), F.lit(True).alias("_changed"))
    joined = facts if "updated_at" in facts.columns else facts.withColumn("updated_at", F.lit(None).cast("timestamp"))
    columns = joined.columns
    joined = joined.join(renamed, "fact_id", "left")
    for f in given:
        joined = joined.withColumn(f, F.coalesce("_" + f, f))
    joined = joined.withColumn("updated_at", F.when(F.col("_changed"), F.current_timestamp() if stamp is None else stamp).otherwise(F.col("updated_at")))
    return joined.select(columns)


def version_rows(before: DataFrame, after: DataFrame, existing: DataFrame, changed: DataFrame, by: str, comment: str | None = None) -> DataFrame:
    """A version for each changed fact (fact_id): fact_id, version (the next one), previous, new (JSON), updated_by, comment."""
    last = existing.groupBy("fact_id").agg(F.max("version").alias("last"))
    as_json = lambda rows, name: rows.select("fact_id", F.to_json(F.struct(*(c for c in rows.columns if c != "fact_id"))).alias(name))
    both = changed.select("fact_id").distinct().join(as_json(before, "previous"), "fact_id").join(as_json(after, "new"), "fact_id").join(last, "fact_id", "left")
    return both.select("fact_id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "previous", "new", F.lit(by).alias("updated_by"), F.lit(comment).cast("string").alias("comment"))


# fixed values: columns of the audit log
AUDIT = "id string, user_id string, role string, action string, target_type string, target_id string, query string, payload string, created_at timestamp"


def audit_rows(events: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Events as rows of the audit log, with ids and times: action, and user_id, role, target_type, target_id, query,
    payload as far as given."""
    own = {"id": F.concat(F.lit("audit_"), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12)), "created_at": F.current_timestamp() if stamp is None else stamp}
    default = {"user_id": "demo_user", "role": "external_partner", "payload": "{}"}
    columns = [c.split() for c in AUDIT.split(", ")]
    value = lambda name: own[name] if name in own else F.coalesce(F.col(name), F.lit(default.get(name))) if name in events.columns else F.lit(default.get(name))
    return events.select(*(value(name).cast(kind).alias(name) for name, kind in columns))


def newest(rows: DataFrame, order: Sequence[str], limit: int = 100) -> DataFrame:
    return rows.orderBy(*(F.desc(c) for c in order)).limit(limit)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run hasn't finished."""
    return rows.join(done.select(key), key, "left_anti")


def selected(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key), key, "left_semi")
