"""Search over facts: filters, existence joins, numeric constraints, collected attributes, the bridge from retrieved text.

A fact row is fact_id, source_id, status, fact_type, year, confidence (one row for each source of a fact);
sources have source_id, access_level, country, geo_scope.  Existence joins are semi joins, so they never
multiply rows, and collected attributes are aggregated before they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import Constraint, numeric_predicate
from quarry.functions.terms import holding
from quarry.operators.access import visible
from quarry.operators.retrieval import bm25_scores, term_counts


@dataclass(frozen=True)
class FactFilter:
    """Hard conditions; None or empty asks for nothing."""

    year_from: int | None = None
    year_to: int | None = None
    min_confidence: float | None = None
    geo_scope: str | None = None
    countries: Sequence[str] = ()
    status: str | None = None
    fact_type: str | None = None
    numeric: Sequence[Constraint] = field(default_factory=tuple)
    verification_level: str | None = None
    source_type: str | None = None

    def column(self) -> Column:
        checks = [
            (self.year_from is not None, lambda: F.col("year") >= self.year_from),
            (self.year_to is not None, lambda: F.col("year") <= self.year_to),
            (self.min_confidence is not None, lambda: F.col("confidence") >= self.min_confidence),
            (self.geo_scope not in (None, "all"), lambda: F.col("geo_scope") == self.geo_scope),
            (bool(self.countries), lambda: F.col("country").isin(list(self.countries))),
            (self.status is not None, lambda: F.col("status") == self.status),
            (self.fact_type is not None, lambda: F.col("fact_type") == self.fact_type),
            (self.verification_level is not None, lambda: F.col("verification_level") == self.verification_level),
            (self.source_type is not None, lambda: F.col("source_type") == self.source_type),
        ]
        found = F.lit(True)
        for asked, make in checks:
            if asked:
                found = found & make()
        return found


def with_sources(facts: DataFrame, sources: DataFrame, role: str) -> DataFrame:
    """Facts with each source that a role may see."""
    return facts.join(sources.where(visible(role)), "source_id")


def satisfying(facts: DataFrame, values: DataFrame, constraints: Sequence[Constraint], mode: str = "range") -> DataFrame:
    """Facts with a stored value for each constraint (one value may satisfy several)."""
    if not constraints:
        return facts
    met = [(F.col("parameter") == c.parameter) & numeric_predicate(c, mode) & (F.lit(True) if c.unit is None else F.col("unit") == c.unit) for c in constraints]
    some = met[0]
    for m in met[1:]:
        some = some | m
    # by itself too: where values are a view that aggregates by parameter, this goes below it, down to the scan
    asked = values.where(F.col("parameter").isin(sorted({c.parameter for c in constraints})))
    each = asked.where(some).groupBy("fact_id").agg(*(F.max(m).alias(f"met{k}") for k, m in enumerate(met)))
    return facts.join(each.where(" AND ".join(f"met{k}" for k in range(len(met)))).select("fact_id"), "fact_id", "left_semi")


def about(facts: DataFrame, links: DataFrame, entities: DataFrame, condition: Column) -> DataFrame:
    """Facts about an entity that meets a condition."""
    return facts.join(links.join(entities.where(condition), "entity_id").select("fact_id"), "fact_id", "left_semi")


def ranked(facts: DataFrame, limit: int) -> DataFrame:
    """The first facts by confidence and year, both descending with unknown ones first; ties by id."""
    return facts.orderBy(F.desc_nulls_first("confidence"), F.desc_nulls_first("year"), "fact_id").limit(limit)


def search(facts: DataFrame, sources: DataFrame, values: DataFrame, condition: FactFilter, role: str, limit: int = 50) -> DataFrame:
    """The first facts that a role may see and that meet a condition.  Values are looked at of the facts that are left."""
    found = with_sources(facts, sources, role).where(condition.column())
    if condition.numeric:
        values = values.join(found.select("fact_id"), "fact_id", "left_semi")
    return ranked(satisfying(found, values, condition.numeric), limit)


def with_names(facts: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds the sorted distinct names of the entities that facts are about (entities), joined by commas."""
    near = links.join(facts.select("fact_id").distinct(), "fact_id", "left_semi")
    names = near.join(entities, "entity_id").groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("entities"))
    return facts.join(names, "fact_id", "left")


def with_values(facts: DataFrame, values: DataFrame) -> DataFrame:
    """Adds the sorted distinct values of each fact (numeric_values: parameter, value, value_min, value_max, unit)."""
    near = values.join(facts.select("fact_id").distinct(), "fact_id", "left_semi")
    each = F.struct("parameter", "value", "value_min", "value_max", "unit")
    gathered = near.groupBy("fact_id").agg(F.array_sort(F.collect_set(each)).alias("numeric_values"))
    return facts.join(gathered, "fact_id", "left")


@dataclass(frozen=True)
class Hints:
    """What a query's plan says about facts: each condition that a fact meets raises its place; terms are looked for in
    the names of its entities, explicit ones first."""

    explicit_terms: Sequence[str] = ()
    terms: Sequence[str] = ()
    year_from: int | None = None
    year_to: int | None = None
    geo_scope: str | None = None
    countries: Sequence[str] = ()
    status: str | None = None
    fact_type: str | None = None
    verification_level: str | None = None
    source_type: str | None = None

    def score(self) -> Column:
        """How many of the conditions hold (unknown ones don't), over year, country and the rest of a joined row."""
        met = [
            (self.year_from is not None or self.year_to is not None, lambda: F.col("year").between(self.year_from if self.year_from is not None else -(10**6), self.year_to if self.year_to is not None else 10**6)),
            (bool(self.countries), lambda: F.col("country").isin(list(self.countries))),
            *((getattr(self, c) is not None, lambda c=c: F.col(c) == getattr(self, c)) for c in ("geo_scope", "status", "fact_type", "verification_level", "source_type")),
        ]
        return sum((F.when(make(), 1).otherwise(0) for asked, make in met if asked), F.lit(0))


def or_of_source(joined: DataFrame, name: str) -> DataFrame:
    """Fills a fact's attribute from its source's (source_<name>) where the fact has none."""
    own, other = name in joined.columns, f"source_{name}" in joined.columns
    return joined.withColumn(name, F.coalesce(name, f"source_{name}")) if own and other else joined.withColumnRenamed(f"source_{name}", name) if other else joined


def bridge(hits: DataFrame, facts: DataFrame, sources: DataFrame, role: str, matches: Sequence[Column], limit: int = 50) -> DataFrame:
    """Facts that retrieved texts support (hits: fact_id, score), best first.

    A hit counts with its best score; plan_score is the number of conditions met (unknown ones aren't).
    Spark broadcasts hits where they are small; beyond its size limit it shuffles them.
    """
    best = hits.groupBy("fact_id").agg(F.max("score").alias("retrieval_score"))
    plan = sum((F.when(m, 1).otherwise(0) for m in matches), F.lit(0)).alias("plan_score")
    found = with_sources(facts, sources, role).join(best, "fact_id").select("*", plan)
    order = [F.desc_nulls_first(c) for c in ("retrieval_score", "plan_score", "confidence", "year")]
    return found.orderBy(*order, "fact_id", "source_id").limit(limit)


def bridge_chunks(hits: DataFrame, supported: DataFrame, facts: DataFrame, sources: DataFrame, names: DataFrame, role: str, hints: Hints, hard: FactFilter | None = None, limit: int = 50) -> DataFrame:
    """Facts that retrieved chunks support, by the edges from facts to chunks, best first.

    hits: chunk_id, score; supported: fact_id, chunk_id; names: fact_id, name (of the fact's entities).  Sources may have
    source_year and source_country, which stand in for a fact's unknown year and country, in hard conditions too.
    Order: entities that hold explicit terms, retrieval_score, plan_score, entities that hold other terms, confidence,
    year, all descending with unknown ones first; then ids.
    """
    scores = hits.groupBy("chunk_id").agg(F.max("score").alias("score"))
    best = supported.join(scores, "chunk_id").groupBy("fact_id").agg(F.max("score").alias("retrieval_score"))
    found = with_sources(facts.join(best, "fact_id"), sources, role)
    for name in ("year", "country"):
        found = or_of_source(found, name)
    found = found.where((hard or FactFilter()).column())
    gathered = names.join(best.select("fact_id"), "fact_id", "left_semi").groupBy("fact_id").agg(F.collect_set("name").alias("_names"))
    found = found.join(gathered, "fact_id", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))
    scored = found.select("*", hints.score().alias("plan_score"), holding("_names", hints.explicit_terms).alias("explicit_score"), holding("_names", hints.terms).alias("entity_score")).drop("_names")
    order = [F.desc_nulls_first(c) for c in ("explicit_score", "retrieval_score", "plan_score", "entity_score", "confidence", "year")]
    return scored.orderBy(*order, "fact_id", "source_id").limit(limit)


def full_text(facts: DataFrame, sources: DataFrame, role: str, terms: Sequence[str], limit: int = 50, text: str = "claim_text") -> DataFrame:
    """Facts whose text holds one of some terms, by BM25 over all facts' texts, confidence and year: with full_text_score.

    Without terms there are none.
    """
    if not terms:
        return with_sources(facts, sources, role).withColumn("full_text_score", F.lit(0.0)).limit(0)
    texts = facts.select(F.col("fact_id").alias("chunk_id"), F.col(text).alias("text")).distinct()
    scores = bm25_scores(term_counts(texts, terms), range(len(terms))).select(F.col("chunk_id").alias("fact_id"), F.col("score").alias("full_text_score"))
    found = with_sources(facts, sources, role).join(scores, "fact_id")
    return found.orderBy(F.desc("full_text_score"), F.desc_nulls_first("confidence"), F.desc_nulls_first("year"), "fact_id", "source_id").limit(limit)


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table's rows, or the second's where the first has none.  Both are bounded lists with the same columns."""
    none = first.limit(1).agg((F.count("*") == 0).alias("_none")).where("_none").drop("_none")
    return first.unionByName(second.join(F.broadcast(none)))


def in_request_order(facts: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Facts by id, with the place of each in the request (ordinal, from 1)."""
    wanted = facts.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids, 1)], "fact_id bigint, ordinal int")
    return facts.join(wanted, "fact_id").orderBy("ordinal")  # Spark broadcasts a request's ids by their size


def missing(facts: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Requested ids that facts lack: fact_id."""
    wanted = facts.sparkSession.createDataFrame([(i,) for i in ids], "fact_id bigint").distinct()
    return wanted.join(facts, "fact_id", "left_anti")
