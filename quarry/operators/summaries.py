"""Coverage counts, group comparison and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.facts import ranked


def coverage(facts: DataFrame, links: DataFrame, values: DataFrame, supported: DataFrame) -> DataFrame:
    """Distinct facts (rows of facts with visible sources), sources, chunks, entities and values: label, cnt."""
    visible = facts.select("fact_id").distinct()
    counted = {
        "facts": visible.agg(F.count("*").alias("cnt")),
        "sources": facts.agg(F.count_distinct("source_id").alias("cnt")),
        "chunks": supported.join(visible, "fact_id", "left_semi").agg(F.count_distinct("chunk_id").alias("cnt")),
        "entities": links.join(visible, "fact_id", "left_semi").agg(F.count_distinct("entity_id").alias("cnt")),
        "values": values.join(visible, "fact_id", "left_semi").agg(F.count("*").alias("cnt")),
    }
    rows = [df.select(F.lit(label).alias("label"), "cnt") for label, df in counted.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def counts_by(facts: DataFrame, key: str) -> DataFrame:
    """Rows by key (an unknown key reads unknown): key, cnt."""
    return facts.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(F.count("*").alias("cnt"))


def facts_by_entity(facts: DataFrame, links: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """Entity names with most distinct facts: name, facts."""
    joined = links.join(facts.select("fact_id").distinct(), "fact_id", "left_semi").join(entities, "entity_id")
    return joined.select("name", "fact_id").distinct().groupBy("name").agg(F.count("*").alias("facts")).orderBy(F.desc("facts"), "name").limit(limit)


def weak_topics(facts: DataFrame, links: DataFrame, entities: DataFrame, most: int = 1, limit: int = 10) -> DataFrame:
    """Entity names with at most `most` distinct facts, none included: name, facts.  Facts are filtered before."""
    seen = links.join(facts.select("fact_id").distinct(), "fact_id", "left_semi").join(entities, "entity_id").select("name", "fact_id").distinct()
    counts = seen.groupBy("name").agg(F.count("*").alias("facts"))
    every = entities.select("name").distinct().join(counts, "name", "left").select("name", F.coalesce("facts", F.lit(0)).alias("facts"))
    return every.where(F.col("facts") <= most).orderBy("facts", "name").limit(limit)


def compare(facts: DataFrame, key: str, limit: int = 500) -> DataFrame:
    """The first facts by rank, grouped: key, cnt, confidence (mean; unknown counts 0), by key."""
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown")).alias(key)
    mean = F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 3).alias("confidence")
    return ranked(facts, limit).groupBy(name).agg(F.count("*").alias("cnt"), mean).orderBy(key)


def members(facts: DataFrame, key: str, limit: int = 500) -> DataFrame:
    """Like compare, with the facts of each group in rank order: key, fact_ids."""
    first = ranked(facts, limit)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_first("confidence"), F.desc_nulls_first("year"), "fact_id"))  # at most `limit` rows
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown")).alias(key)
    placed = first.select(name, place.alias("place"), "fact_id")
    return placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "fact_id"))), lambda r: r["fact_id"]).alias("fact_ids")).orderBy(key)


def total(facts: DataFrame, condition: Column, name: str) -> DataFrame:
    return facts.agg(F.count_if(condition).alias(name))
