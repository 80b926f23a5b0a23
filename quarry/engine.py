"""The engine's calls over its tables: search, comparison, coverage, facts, graph reads and changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import Constraint
from quarry.functions.terms import expanded, fallback_terms, query_tokens
from quarry.operators import access, changes, extraction, facts, graph, projections, retrieval, summaries
from quarry.sources.shared import saved

#: Hits that a reranker sees.
POOL = 50


@dataclass(frozen=True)
class Query:
    """A question as a plan: its text, what it names, its hints and its hard conditions; years (from, to) and source types
    are conditions on chunks."""

    text: str
    materials: Sequence[str] = ()
    vector: Sequence[float] = ()
    constraints: Sequence[Constraint] = ()
    hints: facts.Hints = field(default_factory=facts.Hints)
    hard: facts.FactFilter = field(default_factory=facts.FactFilter)
    years: tuple[int | None, int | None] | None = None
    source_types: Sequence[str] = ()

    @property
    def strict(self) -> bool:
        """Whether conditions may drop many hits, so that branches give more."""
        return bool(self.constraints or self.years or self.source_types)


@dataclass
class Engine:
    """Tables: facts, sources, about (fact_id, entity_id), entities, values, chunks, vectors, supported (fact_id, chunk_id),
    edges (src, dst, type, access_level) and nodes (node, label, access_level).

    chunks may have access_level (internal where null or missing), year and source_type.  chunk_values (chunk_id, parameter
    and the rest) are what chunks state, of which all of a query's constraints must hold in one chunk.  rerank gives a pool of hits
    (with text) and a query's text a column logit; without it the fused order stands.
    """

    facts: DataFrame
    sources: DataFrame
    about: DataFrame
    entities: DataFrame
    values: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    supported: DataFrame
    edges: DataFrame
    nodes: DataFrame
    chunk_values: DataFrame | None = None
    rerank: Callable[[DataFrame, str], DataFrame] | None = None

    def retrieve(self, query: Query, role: str, k: int = 50, branch: int = 100, pool: int = POOL) -> DataFrame:
        """The best chunks that a role may see: lexical, widened and dense branches fused, then conditions on chunks, the
        guard for values, two of a document, and the pool reranked: chunk_id, document_id, score and the chunk's columns."""
        asked = query_tokens(query.text)
        wider = query_tokens(expanded(query.text, query.materials))
        terms = list(dict.fromkeys([*asked, *wider]))
        branch = retrieval.widened(branch, query.strict)
        branches = []
        if terms:
            counts = retrieval.saved_counts(self.chunks, terms)
            branches = [(retrieval.bm25(counts, [terms.index(t) for t in words], branch), weight) for words, weight in ((asked, retrieval.ORIGINAL_WEIGHT), (wider, retrieval.EXPANDED_WEIGHT)) if words]
        if query.vector:
            branches.append((retrieval.dense(self.vectors, query.vector, branch), retrieval.DENSE_WEIGHT))
        if not branches:
            return retrieval.eligible(self.chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0), self.chunks, F.lit(True))
        hits = retrieval.eligible(retrieval.fuse(branches), self.chunks, self._seen(query, role))
        if query.constraints and self.chunk_values is not None:
            hits = retrieval.meeting_all(hits, self.chunk_values, self.chunk_values.limit(0), query.constraints)
        hits = extraction.guarded(hits, list(query.materials), list(query.constraints))
        best = retrieval.capped(hits, "document_id", pool=max(k, pool))
        if self.rerank is not None:
            # a pool is small: kept, so that its ranks and logits are of one computation
            ranked = retrieval.rerank(self.rerank(saved(best), query.text), F.col("logit"))
            best = ranked.drop("logit").withColumn("score", F.col("final_score")).drop("final_score")
        return retrieval.top(best, k)

    def _seen(self, query: Query, role: str) -> Column:
        """The condition on chunks: access, years, source types."""
        found = access.visible(role) if "access_level" in self.chunks.columns else F.lit("internal").isin(access.levels(role))
        if query.years is not None:
            found = found & retrieval.in_years("year", *query.years)
        if query.source_types:
            found = found & F.lower(F.trim("source_type")).isin([t.strip().lower() for t in query.source_types])
        return found

    def search(self, query: Query, role: str, limit: int = 50) -> dict[str, DataFrame]:
        """hits, facts (that the hits support, else by plan, else by full text where nothing strict is asked), sources
        (documents of hits that no fact names) and edges (of the first ten facts): of each only what the role may see.

        What stands in for an empty list is only planned where the list is empty."""
        hits = saved(self.retrieve(query, role, min(max(limit, 20), 50)))
        names = self.about.join(self.entities, "entity_id").select("fact_id", "name")
        keep = ["fact_id", "source_id", "status", "fact_type", "year", "confidence"]
        zero = F.lit(0.0).alias("retrieval_score")
        found = saved(facts.bridge_chunks(hits, self.supported, self.facts, self.sources, names, role, query.hints, query.hard, limit).select(*keep, "retrieval_score"))
        if found.isEmpty():
            found = saved(facts.search(self.facts, self.sources, self.values, facts.FactFilter(**{**query.hard.__dict__, "numeric": tuple(query.constraints)}), role, limit).select(*keep, zero))
        if found.isEmpty() and query.hard == facts.FactFilter() and not query.constraints and "claim_text" in self.facts.columns:
            found = saved(facts.full_text(self.facts, self.sources, role, fallback_terms(query.text), limit).select(*keep, zero))
        first = facts.ranked(found, 10).select(F.concat(F.lit("f"), F.col("fact_id")).alias("node"))
        named = found.join(self.supported, "fact_id").join(self.chunks.select("chunk_id", "document_id"), "chunk_id")
        return {"hits": hits, "facts": found, "sources": retrieval.surfaced(hits, named), "edges": graph.subgraph(self._open_edges(role), first)}

    def _open_edges(self, role: str) -> DataFrame:
        """The edges that a role may walk: see `graph.visible_part`."""
        return graph.visible_part(self.nodes, self.edges, role)[1]

    def compare(self, key: str, role: str, limit: int = 500) -> DataFrame:
        return summaries.compare(facts.with_sources(self.facts, self.sources, role), key, limit)

    def coverage(self, role: str) -> DataFrame:
        return summaries.coverage(facts.with_sources(self.facts, self.sources, role), self.about, self.values, self.supported)

    def list_facts(self, role: str, condition: facts.FactFilter, limit: int = 50) -> DataFrame:
        return facts.search(self.facts, self.sources, self.values, condition, role, limit)

    def fact(self, fact_id: object, role: str) -> DataFrame:
        """One fact with its source, entities and values: no row if the role may not see it."""
        one = facts.with_sources(self.facts.where(F.col("fact_id") == fact_id), self.sources.select("source_id", "access_level"), role).drop("access_level")
        named = self.about.join(self.entities, "entity_id").select("fact_id", "name", "type")
        return projections.fact_rows(one, self.sources, named.join(one.select("fact_id"), "fact_id", "left_semi"), self.values.join(one.select("fact_id"), "fact_id", "left_semi"))

    def update_facts(self, patches: DataFrame, versions: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
        """Facts after patches, and the rows that the version table gains."""
        after = changes.patched(self.facts, patches)
        return after, changes.version_rows(self.facts, after, versions, patches, by)

    def neighbours(self, node: str, role: str, depth: int = 1) -> DataFrame:
        return graph.neighbours(self._open_edges(role), self._node(node), depth)

    def path(self, start: str, end: str, role: str, most: int = 4) -> DataFrame:
        return graph.path_nodes(self._open_edges(role), self._node(start), self._node(end), most)

    def subgraph(self, fact_ids: Sequence[object], role: str) -> DataFrame:
        wanted = self.edges.sparkSession.createDataFrame([(f"f{i}",) for i in fact_ids], "node string")
        return graph.subgraph(self._open_edges(role), wanted)

    def _node(self, name: str) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(name,)], "node string")
