"""Registered queries: each an operator applied to the whole views, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.engine import Engine, Query
from quarry.functions.numeric import Constraint
from quarry.functions.terms import topic_stems
from quarry.functions.text import clip, range_text, stable_id, words, year_of
from quarry.operators import access, changes, chunking, entities, experts, extraction, facts, graph, projections, records, retrieval, summaries
from quarry.plans.views import PRELUDE, Views
from quarry.sources.shared import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TERMS = ["the", "thereon", "une", "tion"]
WIDER = [*TERMS, "der", "las"]


def query(sql: str | None = None, prelude: bool = True):  # noqa: ANN201
    def register(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql is not None:
            SQL[make.__name__] = f"{PRELUDE}\n{sql}" if prelude else sql
        return make

    return register


def _seen(v: Views, role: str = "analyst") -> DataFrame:
    return facts.with_sources(v.facts(), v.sources(), role)


SEARCH = facts.FactFilter(year_from=1996, year_to=2000, min_confidence=0.2, geo_scope="EUROPE", numeric=(Constraint("quantity", ">=", value=5), Constraint("discount", "<=", value=0.1)))


@query("""SELECT fact_id, source_id, status, year, confidence, fact_type, country FROM seen s
WHERE year BETWEEN 1996 AND 2000 AND confidence >= 0.2 AND geo_scope = 'EUROPE'
AND EXISTS (SELECT 1 FROM param p WHERE p.fact_id = s.fact_id AND parameter = 'quantity' AND coalesce(value_min, value, -1e18) >= 5)
AND EXISTS (SELECT 1 FROM param p WHERE p.fact_id = s.fact_id AND parameter = 'discount' AND coalesce(value_max, value, 1e18) <= 0.1)
ORDER BY confidence DESC NULLS FIRST, year DESC NULLS FIRST, fact_id LIMIT 50""")
def plan_search(v: Views) -> DataFrame:
    return facts.search(v.facts(), v.sources(), v.values(), SEARCH, "analyst").select("fact_id", "source_id", "status", "year", "confidence", "fact_type", "country")


@query("""SELECT 'facts' AS label, count(DISTINCT fact_id) AS cnt FROM seen UNION ALL SELECT 'sources', count(DISTINCT source_id) FROM seen
UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM supported WHERE fact_id IN (SELECT fact_id FROM seen)
UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM about WHERE fact_id IN (SELECT fact_id FROM seen)
UNION ALL SELECT 'values', count(*) FROM param WHERE fact_id IN (SELECT fact_id FROM seen)""")
def coverage_counts(v: Views) -> DataFrame:
    return summaries.coverage(_seen(v), v.about(), v.values(), v.supported())


@query("SELECT name, count(DISTINCT fact_id) AS facts FROM seen JOIN about USING (fact_id) JOIN entity USING (entity_id) GROUP BY name ORDER BY facts DESC, name LIMIT 20")
def facts_by_process(v: Views) -> DataFrame:
    return summaries.facts_by_entity(_seen(v), v.about(), v.entities())


@query("SELECT coalesce(geo_scope, 'unknown') AS geo_scope, count(*) AS cnt FROM seen GROUP BY 1")
def facts_by_geo(v: Views) -> DataFrame:
    return summaries.counts_by(_seen(v), "geo_scope")


@query("SELECT coalesce(status, 'unknown') AS status, count(*) AS cnt FROM seen GROUP BY 1")
def facts_by_status(v: Views) -> DataFrame:
    return summaries.counts_by(_seen(v), "status")


@query("""SELECT e.name, count(DISTINCT x.fact_id) AS facts FROM (SELECT DISTINCT canonical_name || ' ' || name AS name, entity_id FROM entity) e
LEFT JOIN (SELECT entity_id, fact_id FROM about WHERE fact_id IN (SELECT fact_id FROM seen)) x USING (entity_id)
GROUP BY e.name HAVING count(DISTINCT x.fact_id) <= 20 ORDER BY facts, name LIMIT 10""")
def weak_topics(v: Views) -> DataFrame:
    named = v.entities().withColumn("name", F.concat_ws(" ", "canonical_name", "name"))
    return summaries.weak_topics(_seen(v), v.about(), named, most=20)


@query("SELECT count(*) FILTER (status = 'contradicted') AS contradictions FROM seen")
def contradictions(v: Views) -> DataFrame:
    return summaries.total(_seen(v), F.col("status") == "contradicted", "contradictions")


@query("""SELECT fact_id, source_id FROM seen s WHERE EXISTS (SELECT 1 FROM about JOIN entity USING (entity_id) WHERE about.fact_id = s.fact_id AND name = 'Brand#11')
AND EXISTS (SELECT 1 FROM about JOIN entity USING (entity_id) WHERE about.fact_id = s.fact_id AND type = (SELECT min(p_type) FROM part))""")
def entity_exists(v: Views) -> DataFrame:
    first_type = v.table("part").agg(F.min("p_type")).first()[0]
    with_brand = facts.about(_seen(v), v.about(), v.entities(), F.col("name") == "Brand#11")
    return facts.about(with_brand, v.about(), v.entities(), F.col("type") == first_type).select("fact_id", "source_id")


@query("""SELECT t.fact_id, t.confidence, n.entities FROM (SELECT * FROM seen ORDER BY confidence DESC NULLS FIRST, year DESC NULLS FIRST, fact_id LIMIT 50) t
LEFT JOIN (SELECT fact_id, string_agg(DISTINCT name, ',' ORDER BY name) AS entities FROM about JOIN entity USING (entity_id) GROUP BY fact_id) n USING (fact_id)""")
def fact_with_entities(v: Views) -> DataFrame:
    return facts.with_names(facts.ranked(_seen(v), 50), v.about(), v.entities()).select("fact_id", "confidence", "entities")


def _numeric(name: str, constraints: list[Constraint], sql: list[str], mode: str = "range") -> None:
    checks = " AND ".join(f"EXISTS (SELECT 1 FROM param p WHERE p.fact_id = f.fact_id AND {check})" for check in sql)

    def make(v: Views) -> DataFrame:
        return facts.satisfying(v.facts(), v.values(), constraints, mode).select("fact_id", "year")

    make.__name__ = name
    query(f"SELECT fact_id, year FROM fact f WHERE {checks}")(make)


_low, _high = "coalesce(value_min, value, -1e18)", "coalesce(value_max, value, 1e18)"
_numeric("numeric_between", [Constraint("quantity", "between", value_min=10, value_max=20, unit="t")], [f"parameter = 'quantity' AND unit = 't' AND {_high} >= 10 AND {_low} <= 20"])
_numeric("numeric_lt", [Constraint("quantity", "<", value=15)], [f"parameter = 'quantity' AND {_high} < 15"])
_numeric("numeric_gt", [Constraint("quantity", ">", value=30)], [f"parameter = 'quantity' AND {_low} > 30"])
_numeric("numeric_eq", [Constraint("quantity", "=", value=25)], [f"parameter = 'quantity' AND {_low} <= 25 AND {_high} >= 25"])
_numeric("numeric_multi", [Constraint("quantity", ">=", value=10), Constraint("discount", "<=", value=0.05)], [f"parameter = 'quantity' AND {_low} >= 10", f"parameter = 'discount' AND {_high} <= 0.05"])
_numeric("numeric_point_any", [Constraint("quantity", "<", value=5)], ["parameter = 'quantity' AND (coalesce(value < 5, false) OR coalesce(value_min < 5, false) OR coalesce(value_max < 5, false))"], "point")


@query("""SELECT role, count(*) AS cnt FROM fact JOIN src USING (source_id) JOIN (VALUES ('partner', 'public'), ('researcher', 'public'), ('researcher', 'internal'), ('analyst', 'public'), ('analyst', 'internal'), ('manager', 'public'), ('manager', 'internal'), ('manager', 'confidential'), ('admin', 'public'), ('admin', 'internal'), ('admin', 'confidential')) r(role, level)
ON coalesce(access_level, 'internal') = level GROUP BY role""")
def role_visibility(v: Views) -> DataFrame:
    return v.facts().join(access.by_role(v.sources()), "source_id").groupBy("role").agg(F.count("*").alias("cnt"))


@query("SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM tok) GROUP BY term")
def tokenize_terms(v: Views) -> DataFrame:
    return retrieval.term_statistics(v.chunks())


@query("SELECT term, chunk_id, len(any_value(w)) AS n, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM tok) GROUP BY term, chunk_id")
def lexical_index(v: Views) -> DataFrame:
    return retrieval.postings(v.chunks())


def _bm25_sql(terms: list[str], k: int) -> str:
    parts = " + ".join(f"greatest(1e-6, ln((docs - d{i} + 0.5) / (d{i} + 0.5))) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(terms)))
    return f"(SELECT chunk_id, score FROM (SELECT chunk_id, round({parts}, 6) AS score FROM (SELECT chunk_id, len(w) AS n, {tf} FROM tok), (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM (SELECT len(w) AS n, {tf} FROM tok))) WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT {k})"


_DENSE = "(SELECT vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, chunk_id LIMIT {k})"


@query(f"SELECT * FROM {_bm25_sql(TERMS, 50)}")
def bm25_topk(v: Views) -> DataFrame:
    return retrieval.bm25(retrieval.saved_counts(v.chunks(), TERMS), range(len(TERMS)), 50)


@query(f"SELECT * FROM {_bm25_sql(TERMS, 50)}")
def bm25_postings(v: Views) -> DataFrame:
    return retrieval.bm25_from_index(retrieval.postings(v.chunks()), retrieval.term_statistics(v.chunks()), retrieval.corpus_statistics(v.chunks()), TERMS, 50)


_overlay = " + ".join(f"CASE WHEN contains(t, '{t}') THEN 1 + 0.15 * least((length(t) - length(replace(t, '{t}', ''))) / {len(t)}, 8) ELSE 0 END" for t in TERMS)


@query(f"SELECT chunk_id, score FROM (SELECT chunk_id, round(CASE WHEN contains(t, 'in the') THEN 4.0 ELSE 0.0 END + {_overlay}, 6) AS score FROM (SELECT chunk_id, lower(text) AS t FROM chunk)) WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 50")
def overlay_lexical(v: Views) -> DataFrame:
    return retrieval.overlay_lexical(v.chunks(), "in the", TERMS, 50)


@query(f"SELECT * FROM {_DENSE.format(k=20)}")
def dense_topk(v: Views) -> DataFrame:
    return retrieval.dense(v.vectors(), v.query_vector(), 20)


def _branch_sql(branch: str, weight: float) -> str:
    return f"SELECT chunk_id, {weight} / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) AS part FROM {branch}"


_FUSED = f"(SELECT chunk_id, round(sum(part), 8) AS score FROM ({_branch_sql(_DENSE.format(k=100), 1.0)} UNION ALL {_branch_sql(_bm25_sql(TERMS, 100), 1.35)} UNION ALL {_branch_sql(_bm25_sql(WIDER, 100), 0.75)}) GROUP BY chunk_id)"


def _fused(v: Views) -> DataFrame:
    terms = list(dict.fromkeys([*TERMS, *WIDER]))
    counts = retrieval.saved_counts(v.chunks(), terms)
    lexical = [(retrieval.bm25(counts, [terms.index(t) for t in asked], 100), weight) for asked, weight in ((TERMS, retrieval.ORIGINAL_WEIGHT), (WIDER, retrieval.EXPANDED_WEIGHT))]
    branches = [(retrieval.dense(v.vectors(), v.query_vector(), 100), retrieval.DENSE_WEIGHT), *lexical]
    return retrieval.fuse(branches)


@query(f"SELECT * FROM {_FUSED}")
def rrf_fusion(v: Views) -> DataFrame:
    return _fused(v)


_CAPPED = f"(SELECT chunk_id, document_id, score FROM (SELECT f.chunk_id, document_id, score, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, f.chunk_id) AS place FROM {_FUSED} f JOIN chunk USING (chunk_id)) WHERE place <= 2 ORDER BY score DESC, chunk_id LIMIT 50)"


def _capped(v: Views) -> DataFrame:
    return retrieval.capped(retrieval.eligible(_fused(v), v.chunks(), F.lit(True)), "document_id")


@query(f"SELECT * FROM {_CAPPED}")
def doc_cap(v: Views) -> DataFrame:
    return _capped(v).select("chunk_id", "document_id", "score")


_terms_sql = "[" + ", ".join(f"'{t}'" for t in WIDER) + "]"


@query(f"""SELECT chunk_id, score, round(0.35 / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) + 0.65 / (60 + row_number() OVER (ORDER BY logit DESC, chunk_id)), 8) AS final_score
FROM (SELECT c.chunk_id, score, len(list_intersect(w, {_terms_sql})) AS logit FROM {_CAPPED} c JOIN tok USING (chunk_id))""")
def rank_fusion_rerank(v: Views) -> DataFrame:
    return retrieval.rerank(_capped(v), retrieval.overlap("text", WIDER)).select("chunk_id", "score", "final_score")


@query(f"SELECT chunk_id, document_id, score FROM {_FUSED} JOIN chunk USING (chunk_id) WHERE lower(trim(source_type)) = 'en' AND n_chars >= 500")
def retrieve_strict(v: Views) -> DataFrame:
    return retrieval.eligible(_fused(v), v.chunks(), (F.lower(F.trim("source_type")) == "en") & (F.col("n_chars") >= 500)).select("chunk_id", "document_id", "score")


@query(f"""SELECT chunk_id, document_id, score FROM (SELECT chunk_id, document_id, score, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS place FROM {_FUSED} JOIN chunk USING (chunk_id)
WHERE document_id NOT IN (SELECT source FROM (SELECT source, count(*) AS n, avg(count(*)) OVER () AS mean FROM documents GROUP BY source) WHERE n > mean)) WHERE place = 1""")
def source_surfacing(v: Views) -> DataFrame:
    hits = retrieval.eligible(_fused(v), v.chunks(), F.lit(True))
    sizes = v.chunks().groupBy("document_id").agg(F.count("*").alias("n"))
    larger = sizes.join(F.broadcast(sizes.agg(F.avg("n").alias("mean")))).where("n > mean")  # documents of many chunks are known
    return retrieval.surfaced(hits, larger).select("chunk_id", "document_id", "score")


@query("""SELECT fact_id, source_id, retrieval_score, plan_score FROM (SELECT s.*, retrieval_score, CASE WHEN year >= 1998 THEN 1 ELSE 0 END + CASE WHEN geo_scope = 'ASIA' THEN 1 ELSE 0 END + CASE WHEN status = 'expert_verified' THEN 1 ELSE 0 END AS plan_score
FROM seen s JOIN (SELECT l_orderkey AS fact_id, max(l_quantity) AS retrieval_score FROM lineitem GROUP BY 1) USING (fact_id))
ORDER BY retrieval_score DESC NULLS FIRST, plan_score DESC NULLS FIRST, confidence DESC NULLS FIRST, year DESC NULLS FIRST, fact_id, source_id LIMIT 50""")
def bridge_search(v: Views) -> DataFrame:
    hits = v.table("lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_quantity").alias("score"))
    matches = [F.col("year") >= 1998, F.col("geo_scope") == "ASIA", F.col("status") == "expert_verified"]
    return facts.bridge(hits, v.facts(), v.sources(), "analyst", matches).select("fact_id", "source_id", "retrieval_score", "plan_score")


def _compare(key: str) -> None:
    def make(v: Views) -> DataFrame:
        return summaries.compare(_seen(v), key)

    make.__name__ = "compare_by_geo" if key == "geo_scope" else f"compare_by_{key}"
    query(f"SELECT coalesce(nullif({key}, ''), 'unknown') AS {key}, count(*) AS cnt, round(avg(coalesce(confidence, 0)), 3) AS confidence FROM (SELECT * FROM seen ORDER BY confidence DESC NULLS FIRST, year DESC NULLS FIRST, fact_id LIMIT 500) GROUP BY 1 ORDER BY 1")(make)


_compare("geo_scope")
_compare("status")

_EDGES = "(SELECT DISTINCT 'f' || l_orderkey AS src, 'e' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || o_custkey, 'f' || o_orderkey FROM orders)"


def _edges(v: Views) -> DataFrame:
    parts = v.about().select(F.concat(F.lit("f"), F.col("fact_id")).alias("src"), F.concat(F.lit("e"), F.col("entity_id")).alias("dst"))
    return parts.unionByName(v.facts().select(F.concat(F.lit("s"), F.col("source_id")).alias("src"), F.concat(F.lit("f"), F.col("fact_id")).alias("dst")))


def _node(v: Views, name: str) -> DataFrame:
    return v.spark.createDataFrame([(name,)], "node string")


_BOTH = f"both_ways AS (SELECT src, dst FROM {_EDGES} UNION SELECT dst, src FROM {_EDGES})"


@query(f""", {_BOTH}, one AS (SELECT dst AS node FROM both_ways WHERE src = 's1'), two AS (SELECT dst AS node FROM both_ways JOIN one ON src = node)
SELECT node, min(hops) AS hops FROM (SELECT 's1' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node""")
def neighbors_2hop(v: Views) -> DataFrame:
    return graph.neighbours(_edges(v), _node(v, "s1"), 2)


@query(f""", {_BOTH}, h1 AS (SELECT DISTINCT dst AS node FROM both_ways WHERE src = 'e1'), h2 AS (SELECT DISTINCT dst AS node FROM both_ways JOIN h1 ON src = node),
h3 AS (SELECT DISTINCT dst AS node FROM both_ways JOIN h2 ON src = node), h4 AS (SELECT DISTINCT dst AS node FROM both_ways JOIN h3 ON src = node)
SELECT node, min(hops) AS hops FROM (SELECT 'e1' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3 UNION ALL SELECT node, 4 FROM h4) WHERE node IN (SELECT 'e' || p_partkey FROM part) GROUP BY node""")
def shortest_path_len(v: Views) -> DataFrame:
    return graph.path_lengths(_edges(v), _node(v, "e1"), v.entities().select(F.concat(F.lit("e"), F.col("entity_id")).alias("node")), 4)


@query(f"SELECT DISTINCT src, dst FROM {_EDGES} WHERE src IN (SELECT 'f' || fact_id FROM top) OR dst IN (SELECT 'f' || fact_id FROM top)".replace("SELECT DISTINCT src, dst", ", top AS (SELECT fact_id FROM seen ORDER BY confidence DESC NULLS FIRST, year DESC NULLS FIRST, fact_id LIMIT 10) SELECT DISTINCT src, dst", 1))
def subgraph_edges(v: Views) -> DataFrame:
    first = facts.ranked(_seen(v), 10).select(F.concat(F.lit("f"), F.col("fact_id")).alias("node"))
    return graph.subgraph(_edges(v), first)


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1", prelude=False)
def upsert_latest(v: Views) -> DataFrame:
    return changes.latest(v.table("events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events", prelude=False)
def fact_version_numbers(v: Views) -> DataFrame:
    return changes.versions(v.table("events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "version")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100", prelude=False)
def audit_latest(v: Views) -> DataFrame:
    return changes.newest(v.table("events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", prelude=False)
def resume_anti_join(v: Views) -> DataFrame:
    return changes.pending(v.table("documents"), v.table("labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)", prelude=False)
def select_semi_join(v: Views) -> DataFrame:
    return changes.selected(v.table("documents"), v.table("labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


REQUEST = [7, 3, 11, 999_999_999, 5, 1, 2]


@query(f"SELECT fact_id FROM (VALUES {', '.join(f'({i})' for i in REQUEST)}) r(fact_id) WHERE fact_id NOT IN (SELECT fact_id FROM seen)")
def missing_ids(v: Views) -> DataFrame:
    return facts.missing(_seen(v), REQUEST)


@query(f"SELECT fact_id, ordinal, status FROM (VALUES {', '.join(f'({i}, {k})' for k, i in enumerate(REQUEST, 1))}) r(fact_id, ordinal) JOIN fact USING (fact_id) ORDER BY ordinal")
def ordered_by_request(v: Views) -> DataFrame:
    return facts.in_request_order(v.facts(), REQUEST).select("fact_id", "ordinal", "status")


_KEY = "trim(regexp_replace(lower(canonical_name), '[^a-z0-9+]+', ' ', 'g'))"


@query(f"SELECT type, {_KEY} AS key, min(entity_id) AS entity_id, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(canonical_name)))[1:20], '|') AS aliases FROM entity GROUP BY 1, 2")
def entity_merge(v: Views) -> DataFrame:
    merged = entities.merged(v.entities().withColumn("name", F.col("canonical_name")), "type")
    return merged.withColumn("aliases", F.array_join("aliases", "|"))


@query(f""", known AS (SELECT DISTINCT type, {_KEY} AS key, min(entity_id) AS entity_id FROM entity GROUP BY 1, 2),
asked AS (SELECT DISTINCT type, canonical_name AS name, {_KEY} AS key FROM entity UNION SELECT DISTINCT type, split_part(canonical_name, ' ', 1), split_part({_KEY}, ' ', 1) FROM entity),
exact AS (SELECT type, name, entity_id, 'exact' AS how, key FROM asked JOIN known USING (type, key)),
fuzzy AS (SELECT a.type, a.name, min(k.entity_id) AS entity_id, 'contained' AS how FROM asked a JOIN (SELECT type, entity_id, {_KEY} AS known FROM entity) k ON a.type = k.type AND (contains(known, a.key) OR contains(a.key, known))
WHERE length(a.key) >= 5 AND length(known) >= 5 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.type = a.type AND e.key = a.key) GROUP BY a.type, a.name, a.key HAVING count(DISTINCT k.entity_id) = 1)
SELECT type, name, entity_id, how FROM exact UNION ALL SELECT type, name, entity_id, how FROM fuzzy""")
def relation_resolve(v: Views) -> DataFrame:
    known = v.entities().withColumn("name", F.col("canonical_name"))
    names = known.select("type", "name").union(known.select("type", F.split_part("name", F.lit(" "), F.lit(1))))
    return entities.resolved(names.distinct(), known, "type")


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(html, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), ''))::INTEGER AS year FROM pages", prelude=False)
def year_backfill(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", year_of("url", "html").alias("year"))


@query("SELECT parameter, unit, count(*) AS cnt FROM param GROUP BY 1, 2")
def param_counters(v: Views) -> DataFrame:
    return v.values().groupBy("parameter", "unit").agg(F.count("*").alias("cnt"))


@query("SELECT doc_id, 'chunk_' || left(sha1(doc_id || ':' || source || ':' || coalesce(lang, 'None')), 20) AS id FROM documents", prelude=False)
def stable_ids(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", stable_id("chunk_", "doc_id", "source", "lang", size=20).alias("id"))


@query("SELECT conv_id, turn, CASE WHEN lag(text) OVER w IS NULL THEN text ELSE right(lag(text) OVER w, 30) || chr(10) || text END AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", prelude=False)
def chunk_tail_overlap(v: Views) -> DataFrame:
    return chunking.with_tails(v.table("conversations"), "conv_id", "turn", 30).select("conv_id", "turn", "text")


@query("SELECT doc_id, CASE WHEN length(trim(text)) > 240 THEN rtrim(left(trim(text), 240)) || '…' ELSE trim(text) END AS preview FROM documents", prelude=False)
def text_clip(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", clip("text", 240).alias("preview"))


_shown = "regexp_replace(({})::DOUBLE::VARCHAR, '\\.0$', '')"


@query(f"""SELECT DISTINCT l_orderkey, l_partkey, CASE l_returnflag WHEN 'N' THEN {_shown.format("l_quantity")} || '–' || {_shown.format("l_quantity + 5")} WHEN 'A' THEN '≥' || {_shown.format("l_quantity")}
ELSE CASE WHEN l_linestatus = 'F' THEN {_shown.format("l_quantity")} ELSE '≤' || {_shown.format("l_quantity + 5")} END END AS shown FROM lineitem""", prelude=False)
def range_labels(v: Views) -> DataFrame:
    low, high = F.col("l_quantity").cast("double"), (F.col("l_quantity") + 5).cast("double")
    flag, final = F.col("l_returnflag"), F.col("l_linestatus") == "F"
    ends = [F.when(flag.isin("N", "A"), low).alias("low"), F.when((flag == "R") & final, low).alias("value"), F.when((flag == "N") | ((flag == "R") & ~final), high).alias("high")]
    return v.table("lineitem").select("l_orderkey", "l_partkey", *ends).select("l_orderkey", "l_partkey", range_text("low", "value", "high").alias("shown")).distinct()


@query("SELECT c.chunk_id, len(w) AS n_words FROM tok c")
def chunk_words(v: Views) -> DataFrame:
    return v.chunks().select("chunk_id", F.size(words("text")).alias("n_words"))


@query()
def chunk_pages(v: Views) -> DataFrame:
    return chunking.chunk_pages(v.table("conversations"), "conv_id", "turn", "text")



def _templated(v: Views) -> DataFrame:
    """A sentence of each order line's figures."""
    share = F.round(F.col("l_discount") * 100).cast("int")
    rows = v.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), share.alias("share"), "l_linenumber").distinct()
    key = F.concat_ws("-", *rows.columns)
    figure = lambda n: F.coalesce(n.cast("string"), F.lit("null"))
    q, said = F.col("q"), [F.lit(x) for x in ("Throughput of ", " t/day at a temperature of ", "-", " degC; copper recovery not less than ", " %.")]
    return rows.select(key.alias("chunk_id"), F.concat(said[0], figure(q), said[1], figure(q + 5), said[2], figure(q), said[3], figure(F.col("share")), said[4]).alias("text"))


@query("""SELECT chunk_id, parameter, value, value_min, value_max, comparator, unit FROM (
SELECT DISTINCT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_quantity::INTEGER, round(l_discount * 100)::INTEGER, l_linenumber) AS chunk_id, l_quantity::INTEGER AS q, round(l_discount * 100)::INTEGER AS share FROM lineitem),
LATERAL (SELECT 'productivity' AS parameter, q::DOUBLE AS value, NULL::DOUBLE AS value_min, NULL::DOUBLE AS value_max, '=' AS comparator, 't/day' AS unit
UNION ALL SELECT 'temperature', NULL, q::DOUBLE, q + 5.0, 'range', 'degC' UNION ALL SELECT 'extraction_recovery', share::DOUBLE, NULL, NULL, '>=', '%')""", prelude=False)
def numeric_extract_templated(v: Views) -> DataFrame:
    return extraction.numeric_values(_templated(v), repeated=True).select("chunk_id", "parameter", "value", "value_min", "value_max", "comparator", "unit")


_SHARES = "(SELECT DISTINCT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_quantity::INTEGER, round(l_discount * 100)::INTEGER, l_linenumber) AS chunk_id, round(l_discount * 100)::INTEGER AS share FROM lineitem)"


@query(f"SELECT chunk_id, share >= 5 AS copper, false AS zinc FROM {_SHARES}", prelude=False)
def contextual_guard(v: Views) -> DataFrame:
    recovery = [Constraint("extraction_recovery", ">=", value=5, unit="%"), Constraint("productivity", ">=", value=0, unit="t/day")]
    return extraction.guard_verdicts(_templated(v), {"copper": ["cu"], "zinc": ["zn"]}, recovery).select("chunk_id", "copper", "zinc")


_UNITS_SQL = "|".join(sorted((s.replace(".", "\\.") for spellings in extraction.UNITS.values() for s in spellings if s != "ph"), key=len, reverse=True))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '(?i)[0-9]\\s*(?:{_UNITS_SQL})(?:[^\\p{{L}}]|$)')) AS n_values FROM documents WHERE regexp_matches(text, '(?i)[0-9]\\s*(?:{_UNITS_SQL})(?:[^\\p{{L}}]|$)')", prelude=False)
def numeric_extract_documents(v: Views) -> DataFrame:
    found = extraction.numeric_values(v.table("documents"), "doc_id").where("unit <> 'pH'")
    return found.groupBy(F.col("chunk_id").alias("doc_id")).agg(F.count("*").alias("n_values"))


def _bodies(v: Views) -> DataFrame:
    """A sentence of each source that names two bodies."""
    text = F.concat(F.lit("Исследования ведёт Институт "), F.initcap(F.lower("geo_scope")), F.lit(" вместе с ООО «"), "title", F.lit("» по технологии обогащения."))
    return v.sources().select(F.col("source_id").alias("chunk_id"), text.alias("text"))


@query("""SELECT 'институт' || regexp_replace(lower(geo_scope), '[^a-z0-9]+', '', 'g') AS key, 'institute' AS kind, count(DISTINCT source_id) AS evidence FROM src GROUP BY geo_scope
UNION ALL SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 'organization', count(DISTINCT source_id) FROM src GROUP BY title""")
def organisation_mentions(v: Views) -> DataFrame:
    return experts.ranked_experts(experts.expert_mentions(_bodies(v)), None).select("key", "kind", "evidence")


@query("""SELECT 'институт' || regexp_replace(lower(geo_scope), '[^a-z0-9]+', '', 'g') AS key, evidence FROM (SELECT geo_scope, count(DISTINCT source_id) AS evidence FROM src GROUP BY geo_scope)
UNION ALL SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), evidence FROM (SELECT title, count(DISTINCT source_id) AS evidence FROM src GROUP BY title) ORDER BY evidence DESC, key LIMIT 20""")
def expert_search(v: Views) -> DataFrame:
    found = experts.expert_mentions(_bodies(v), topic_stems(["технологии обогащения"]))
    kept = found.groupBy("key").agg(F.count_distinct("chunk_id").alias("evidence"))
    return kept.orderBy(F.desc("evidence"), "key").limit(20)


@query("""SELECT 'патент рф № ' || (1000000 + p_partkey) AS key, count(*) AS mentions FROM part GROUP BY 1 UNION ALL SELECT 'wo-' || (200000 + p_partkey) || '/' || (100 + p_size), count(*) FROM part GROUP BY 1""", prelude=False)
def patent_mentions(v: Views) -> DataFrame:
    text = F.concat(F.lit("Способ описан: Патент  РФ № "), F.col("p_partkey") + 1_000_000, F.lit(", и заявка WO-"), F.col("p_partkey") + 200_000, F.lit("/"), F.col("p_size") + 100, F.lit("."))
    return experts.patents(v.table("part").select(F.col("p_partkey").alias("chunk_id"), text.alias("text"))).select("key", "mentions")


PLAN = facts.Hints(explicit_terms=("brand#1",), terms=("brand#11", "brand#2"), year_from=1998, geo_scope="ASIA", status="expert_verified")
_PLAN_SQL = "CASE WHEN year >= 1998 THEN 1 ELSE 0 END + CASE WHEN geo_scope = 'ASIA' THEN 1 ELSE 0 END + CASE WHEN status = 'expert_verified' THEN 1 ELSE 0 END"
_NAMES_SQL = "(SELECT fact_id, list(DISTINCT name) AS names FROM about JOIN entity USING (entity_id) GROUP BY fact_id)"
_HOLDING = "len(list_filter(names, lambda x: {}))"
_EXPLICIT, _OTHER = _HOLDING.format("contains(lower(x), 'brand#1')"), _HOLDING.format("contains(lower(x), 'brand#11') OR contains(lower(x), 'brand#2')")
_ORDER = " DESC NULLS FIRST, ".join(["explicit_score", "retrieval_score", "plan_score", "entity_score", "confidence", "year"]) + " DESC NULLS FIRST, fact_id, source_id"


def _names(v: Views) -> DataFrame:
    return v.about().join(v.entities(), "entity_id").select("fact_id", "name")


@query(f"""SELECT fact_id, source_id, year, country, retrieval_score, plan_score, explicit_score, entity_score FROM (SELECT f.fact_id, f.source_id, f.year, country, confidence, retrieval_score, {_PLAN_SQL} AS plan_score, {_EXPLICIT} AS explicit_score, {_OTHER} AS entity_score
FROM (SELECT * REPLACE (coalesce(CASE WHEN status <> 'contradicted' THEN year END, 1992 + source_id % 7) AS year) FROM fact) f JOIN src USING (source_id) JOIN (SELECT fact_id, max(n_chars / 1000.0) AS retrieval_score FROM supported JOIN chunk USING (chunk_id) GROUP BY 1) USING (fact_id) JOIN {_NAMES_SQL} USING (fact_id)
WHERE coalesce(access_level, 'internal') IN ('public', 'internal') AND f.year >= 1996 AND country IN ('NATION_1', 'NATION_5', 'NATION_9', 'NATION_13', 'NATION_20')) ORDER BY {_ORDER} LIMIT 50""")
def bridge_fallback(v: Views) -> DataFrame:
    hits = v.chunks().select("chunk_id", (F.col("n_chars") / 1000.0).alias("score"))
    known = v.facts().withColumn("year", F.when(F.col("status") != "contradicted", F.col("year")))
    sources = v.sources().withColumn("source_year", 1992 + F.col("source_id") % 7).withColumnRenamed("country", "source_country")
    hard = facts.FactFilter(year_from=1996, countries=("NATION_1", "NATION_5", "NATION_9", "NATION_13", "NATION_20"))
    found = facts.bridge_chunks(hits, v.supported(), known, sources, _names(v), "analyst", PLAN, hard)
    return found.select("fact_id", "source_id", F.col("year").cast("long").alias("year"), "country", "retrieval_score", "plan_score", "explicit_score", "entity_score")


ASKED, ALSO = ["thereon", "une", "tion"], ["thereon", "une", "tion", "der", "las"]
_FLOW_FUSED = f"(SELECT chunk_id, round(sum(part), 8) AS score FROM ({_branch_sql(_DENSE.format(k=100), 1.0)} UNION ALL {_branch_sql(_bm25_sql(ASKED, 100), 1.35)} UNION ALL {_branch_sql(_bm25_sql(ALSO, 100), 0.75)}) GROUP BY chunk_id)"
_FLOW_HITS = f"(SELECT chunk_id, document_id, score FROM (SELECT f.chunk_id, document_id, score, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, f.chunk_id) AS place FROM {_FLOW_FUSED} f JOIN chunk USING (chunk_id)) WHERE place <= 2 ORDER BY score DESC, chunk_id LIMIT 50)"


def _engine(v: Views, **more) -> Engine:  # noqa: ANN003
    nodes, edges = _labelled_graph(v)
    given = {"chunks": v.chunks()} | more
    return Engine(facts=v.facts(), sources=v.sources(), about=v.about(), entities=v.entities(), values=v.values(), vectors=v.vectors(), supported=v.supported(), edges=edges, nodes=nodes, **given)


@query(f"""SELECT fact_id, source_id, retrieval_score FROM (SELECT s.fact_id, s.source_id, retrieval_score, {_PLAN_SQL} AS plan_score, {_EXPLICIT} AS explicit_score, {_OTHER} AS entity_score, confidence, year
FROM seen s JOIN (SELECT fact_id, max(score) AS retrieval_score FROM supported JOIN {_FLOW_HITS} USING (chunk_id) GROUP BY 1) USING (fact_id) JOIN {_NAMES_SQL} USING (fact_id)) ORDER BY {_ORDER} LIMIT 50""")
def search_flow(v: Views) -> DataFrame:
    asked = Query("thereon une tion", materials=("der", "las"), vector=v.query_vector(), hints=PLAN)
    return _engine(v).search(asked, "analyst")["facts"].select("fact_id", "source_id", "retrieval_score")


@query("SELECT fact_id, source_id, confidence FROM (SELECT * FROM seen WHERE year >= 2100 UNION ALL SELECT * FROM seen WHERE status = 'expert_verified') ORDER BY confidence DESC NULLS FIRST, year DESC NULLS FIRST, fact_id LIMIT 50")
def search_fallback(v: Views) -> DataFrame:
    nothing = facts.ranked(_seen(v).where("year >= 2100"), 50)
    plan = facts.ranked(_seen(v).where("status = 'expert_verified'"), 50)
    return facts.or_else(nothing, plan).select("fact_id", "source_id", "confidence")


def _path_sql(most: int) -> str:
    """Levels from a start, then steps back from the targets, in SQL."""
    levels = ["h0 AS (SELECT 'e1' AS node)", *(f"h{k} AS (SELECT DISTINCT dst AS node FROM both_ways JOIN h{k - 1} ON src = node)" for k in range(1, most + 1))]
    union = " UNION ALL ".join(f"SELECT node, {k} AS hops FROM h{k}" for k in range(most + 1))
    steps = [f"dist AS (SELECT node, min(hops) AS hops FROM ({union}) GROUP BY node)", "t0 AS (SELECT node, hops, node AS cur, node AS path, hops AS todo FROM dist WHERE node IN (SELECT 'e' || p_partkey FROM part) ORDER BY hops, node LIMIT 50)"]
    steps += [f"t{k + 1} AS (SELECT node, hops, min(src) AS cur, min(src) || '>' || path AS path, todo - 1 AS todo FROM t{k} JOIN both_ways ON dst = cur JOIN dist d ON d.node = src WHERE d.hops = todo - 1 AND todo > 0 GROUP BY t{k}.node, t{k}.hops, path, todo UNION ALL SELECT * FROM t{k} WHERE todo = 0)".replace("SELECT node, hops, min(src) AS cur", f"SELECT t{k}.node, t{k}.hops, min(src) AS cur").replace("d.hops = todo", f"d.hops = t{k}.todo") for k in range(most)]
    return f", {_BOTH}, {', '.join(levels)}, {', '.join(steps)} SELECT node, hops, path FROM t{most}"


@query(_path_sql(4))
def path_nodes(v: Views) -> DataFrame:
    ends = v.entities().select(F.concat(F.lit("e"), F.col("entity_id")).alias("node"))
    return graph.path_nodes(_edges(v), _node(v, "e1"), ends, 4).select("node", "hops", F.array_join("path", ">").alias("path"))


def _labelled_graph(v: Views) -> tuple[DataFrame, DataFrame]:
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key)).alias("node")
    none = F.lit(None).cast("string").alias("access_level")
    nodes = v.sources().select(name("s", "source_id"), F.lit("Source").alias("label"), "access_level").unionByName(v.facts().select(name("f", "fact_id"), F.lit("Fact").alias("label"), none)).unionByName(v.entities().select(name("e", "entity_id"), F.lit("Entity").alias("label"), none))
    about = v.about().select(name("f", "fact_id").alias("src"), name("e", "entity_id").alias("dst"), F.lit("ABOUT").alias("type"), none)
    described = v.facts().select(name("f", "fact_id").alias("src"), name("s", "source_id").alias("dst"), F.lit("DESCRIBED_IN").alias("type"), F.when(F.col("status") == "contradicted", "confidential").alias("access_level"))
    return nodes, about.unionByName(described)


@query("""SELECT node FROM (SELECT 's' || source_id AS node FROM src WHERE coalesce(access_level, 'internal') IN ('public', 'internal') UNION ALL SELECT 'e' || entity_id FROM entity UNION ALL SELECT 'f' || fact_id FROM seen)""")
def visible_graph_nodes(v: Views) -> DataFrame:
    return graph.visible_part(*_labelled_graph(v), "analyst")[0].select("node")


@query("""SELECT 'f' || a.fact_id AS src, 'e' || entity_id AS dst FROM about a JOIN seen USING (fact_id) UNION ALL SELECT 'f' || fact_id, 's' || source_id FROM seen WHERE status <> 'contradicted'""")
def visible_graph_edges(v: Views) -> DataFrame:
    return graph.visible_part(*_labelled_graph(v), "analyst")[1].select("src", "dst")


@query("""SELECT f.fact_id FROM fact f WHERE EXISTS (SELECT 1 FROM src WHERE src.source_id = f.source_id AND coalesce(access_level, 'internal') = 'public')
OR EXISTS (SELECT 1 FROM about a JOIN about b USING (entity_id) JOIN fact g ON g.fact_id = b.fact_id JOIN src ON src.source_id = g.source_id WHERE a.fact_id = f.fact_id AND coalesce(access_level, 'internal') = 'public')""")
def visible_fact_nodes(v: Views) -> DataFrame:
    nodes, edges = _labelled_graph(v)
    asked = nodes.where("label = 'Fact'").select("node")
    return graph.visible_nodes(nodes, edges, asked, "partner").select(F.substring("node", 2, 20).cast("long").alias("fact_id"))


@query("""SELECT o_orderkey AS chunk_id FROM orders o WHERE EXISTS (SELECT 1 FROM param p WHERE p.fact_id = o_orderkey AND parameter = 'quantity' AND coalesce(value_max, value, 1e18) < 20 UNION ALL SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey AND l_quantity < 20)
AND EXISTS (SELECT 1 FROM param p WHERE p.fact_id = o_orderkey AND parameter = 'discount' AND coalesce(value_max, value, 1e18) >= 0.05 AND coalesce(value_min, value, -1e18) >= 0.05)""")
def constraints_base_overlay(v: Views) -> DataFrame:
    base = v.values().withColumnRenamed("fact_id", "chunk_id")
    none = F.lit(None).cast("double")
    overlay = v.table("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.lit("quantity").alias("parameter"), F.col("l_quantity").cast("double").alias("value"), none.alias("value_min"), none.alias("value_max"), F.lit("t").alias("unit"))
    asked = v.table("orders").select(F.col("o_orderkey").alias("chunk_id"))
    return retrieval.meeting_all(asked, base, overlay, [Constraint("quantity", "<", value=20, unit="t"), Constraint("discount", ">=", value=0.05)])


@query(f"""SELECT 'E' || row_number() OVER (ORDER BY fused DESC, chunk_id) AS evidence_id, chunk_id, document_id, round(fused, 6) AS score, CASE WHEN length(trim(text)) > 200 THEN rtrim(left(trim(text), 200)) || '…' ELSE trim(text) END AS excerpt
FROM (SELECT c.chunk_id, c.document_id, score AS fused, text FROM {_CAPPED} c JOIN chunk USING (chunk_id) ORDER BY c.score DESC, chunk_id LIMIT 14)""")
def evidence_list(v: Views) -> DataFrame:
    return projections.evidence(_capped(v), 14, 200).select("evidence_id", "chunk_id", "document_id", "score", "excerpt")


@query(f"""SELECT chunk_id, row_number() OVER (ORDER BY CASE WHEN source_type = 'de' AND k <= 4 THEN 0 WHEN source_type = 'fr' AND k <= 3 THEN 1 ELSE 2 END, score DESC, chunk_id) AS place
FROM (SELECT chunk_id, score, source_type, row_number() OVER (PARTITION BY CASE source_type WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END ORDER BY score DESC, chunk_id) AS k FROM {_CAPPED} JOIN chunk USING (chunk_id, document_id))""")
def classes_first(v: Views) -> DataFrame:
    return retrieval.classes_first(_capped(v), [(F.col("source_type") == "de", 4), (F.col("source_type") == "fr", 3)]).select("chunk_id", "place")


@query("""SELECT t.fact_id, t.geo_scope AS "group", coalesce(n.parts, '—') AS numeric_parameters, t.year, t.confidence FROM (SELECT * FROM seen ORDER BY confidence DESC NULLS FIRST, year DESC NULLS FIRST, fact_id LIMIT 50) t
LEFT JOIN (SELECT fact_id, string_agg(parameter || ': ' || regexp_replace(value_min::DOUBLE::VARCHAR, '[.]0$', '') || '–' || regexp_replace(value_max::DOUBLE::VARCHAR, '[.]0$', '') || ' ' || unit, '; ' ORDER BY parameter) AS parts FROM param GROUP BY fact_id) n USING (fact_id)""")
def comparison_rows(v: Views) -> DataFrame:
    first = facts.ranked(_seen(v), 50).drop("title", "access_level", "country")
    names = v.about().join(v.entities(), "entity_id").select("fact_id", "name", "type").join(first.select("fact_id"), "fact_id", "left_semi")
    values = v.values().select("fact_id", "parameter", *(F.col(c).cast("double").alias(c) for c in ("value", "value_min", "value_max")), "unit")
    rows = projections.fact_rows(first, v.sources().select("source_id", "title"), names, values.join(first.select("fact_id"), "fact_id", "left_semi"))
    return projections.comparison(rows, "geo_scope").select("fact_id", "group", "numeric_parameters", "year", "confidence")


@query("SELECT fact_id, parameter, value_min::DOUBLE AS value_min, value_max::DOUBLE AS value_max FROM param JOIN (SELECT DISTINCT fact_id FROM fact) USING (fact_id)")
def values_flattened(v: Views) -> DataFrame:
    values = v.values().select("fact_id", "parameter", F.col("value_min").cast("double").alias("value_min"), F.col("value_max").cast("double").alias("value_max"))
    names = v.about().join(v.entities(), "entity_id").select("fact_id", "name")
    return projections.flattened(projections.fact_rows(v.facts(), v.sources().select("source_id", "title"), names, values))


@query("""SELECT fact_id, value_id FROM (SELECT l_orderkey AS fact_id, max(l_quantity)::INTEGER AS said FROM lineitem GROUP BY 1) f JOIN (SELECT DISTINCT l_orderkey AS fact_id, l_quantity::INTEGER AS q, l_orderkey || '-' || l_quantity::INTEGER AS value_id FROM lineitem) USING (fact_id) WHERE q = said""", prelude=False)
def quoted_values(v: Views) -> DataFrame:
    lines = v.table("lineitem")
    claims = lines.groupBy("l_orderkey").agg(F.max("l_quantity").cast("int").alias("q")).select(F.col("l_orderkey").alias("fact_id"), F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("Up to "), "q", F.lit(",0t were moved, not 7"), "q", F.lit(",0 t")).alias("quote"), F.lit(None).cast("string").alias("claim_text"))
    q = F.col("l_quantity").cast("int")
    values = lines.select(F.col("l_orderkey").alias("chunk_id"), F.concat("l_orderkey", F.lit("-"), q).alias("value_id"), F.concat(q, F.lit(".0 t")).alias("source_text")).distinct()
    return records.quoted_values(claims, values)


@query("""SELECT source AS document_id, min(CASE WHEN lang IS NOT NULL THEN lang END) FILTER (doc_id = least_id) AS title, count(DISTINCT doc_id) AS chunks, sum(n) AS n_values FROM (SELECT d.source, d.doc_id, d.lang, coalesce(n, 0) AS n, min(d.doc_id) OVER (PARTITION BY d.source) AS least_id
FROM (SELECT DISTINCT source, doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d LEFT JOIN (SELECT l_partkey AS doc_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) USING (doc_id)) GROUP BY source""", prelude=False)
def batch_documents(v: Views) -> DataFrame:
    done = changes.selected(v.table("documents"), v.table("labels"), "doc_id").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"))
    chunks = v.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("title"))
    values = v.table("lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("value_id"))
    return records.by_document(done, chunks, values)


@query("SELECT coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, count(*) AS cnt FROM documents GROUP BY 1, 2", prelude=False)
def chunk_counters(v: Views) -> DataFrame:
    return chunking.counters(v.table("documents"), "lang", "source")


_SHEETS = "(SELECT p_type AS document, p_brand AS sheet, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS k, 'row_' || row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) || ': ' || p_name || ' | ' || p_retailprice::DECIMAL(12, 2)::VARCHAR AS line FROM part)"


@query(f"""WITH RECURSIVE lines AS MATERIALIZED {_SHEETS},
packed AS (SELECT document, sheet, k, 1 AS part, length(line) AS size FROM lines WHERE k = 1 UNION ALL
SELECT l.document, l.sheet, l.k, CASE WHEN p.size + 1 + length(line) <= 400 THEN p.part ELSE p.part + 1 END, CASE WHEN p.size + 1 + length(line) <= 400 THEN p.size + 1 + length(line) ELSE length(line) END FROM packed p JOIN lines l ON l.document = p.document AND l.sheet = p.sheet AND l.k = p.k + 1)
SELECT document, sheet, row_number() OVER (PARTITION BY document ORDER BY sheet, part) - 1 AS chunk, min(k) AS first, max(k) AS last, string_agg(line, ' ' ORDER BY k) AS text FROM packed JOIN lines USING (document, sheet, k) GROUP BY document, sheet, part""", prelude=False)
def chunk_sheets(v: Views) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy("p_partkey"))
    rows = v.table("part").select("p_type", "p_brand", "p_name", F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), number.alias("k"))
    made = chunking.chunk_rows(rows, "p_type", "p_brand", "k", ["p_name", "price"], 400)
    return made.select("document", "sheet", "chunk", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "text")
