"""The engine's tables as views over the test tables: orders are facts, customers their sources, parts entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Lazy views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sources(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        level = F.when(segment == "BUILDING", "public").when(segment.isin("MACHINERY", "FURNITURE"), "internal").when(segment == "AUTOMOBILE", "confidential")
        nations = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        joined = self.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("title"), level.alias("access_level"), F.col("n_name").alias("country"), F.col("r_name").alias("geo_scope"))

    def facts(self) -> DataFrame:
        status = F.col("o_orderstatus")
        named = F.when(status == "F", "expert_verified").when(status == "O", "auto_extracted").when(status == "P", "contradicted")
        return self.table("orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("source_id"), named.alias("status"), F.year("o_orderdate").alias("year"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("confidence"), F.col("o_orderpriority").alias("fact_type"))

    def entities(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("type"), F.col("p_brand").alias("name"), F.col("p_name").alias("canonical_name"), F.col("p_retailprice").alias("confidence"))

    def about(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("entity_id")).distinct()

    def supported(self) -> DataFrame:
        """The chunks that support facts: documents with the number of an order's part."""
        return self.about().select("fact_id", F.col("entity_id").alias("chunk_id"))

    def values(self) -> DataFrame:
        """Each fact's parameters as ranges over its lines."""
        pieces = F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(c).alias("v"), F.lit(u).alias("unit")) for p, c, u in (("quantity", "l_quantity", "t"), ("discount", "l_discount", "%"), ("tax", "l_tax", "%"))))
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("fact_id"), F.inline(pieces))
        spread = rows.groupBy("fact_id", "parameter", "unit").agg(F.min("v").alias("value_min"), F.max("v").alias("value_max"))
        return spread.withColumn("value", F.when(F.col("value_min") == F.col("value_max"), F.col("value_min")))

    def chunks(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("lang").alias("source_type"), "text", "n_chars")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))

    def query_vector(self, vec_id: int = 0) -> list[float]:
        row = self.vectors().where(F.col("chunk_id") == vec_id).first()
        return [float(x) for x in row["vector"]] if row else []


#: The same views in SQL.
PRELUDE = """
WITH src AS (
  SELECT c_custkey AS source_id, c_name AS title, CASE c_mktsegment WHEN 'BUILDING' THEN 'public' WHEN 'MACHINERY' THEN 'internal' WHEN 'FURNITURE' THEN 'internal' WHEN 'AUTOMOBILE' THEN 'confidential' END AS access_level, n_name AS country, r_name AS geo_scope
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
fact AS (
  SELECT o_orderkey AS fact_id, o_custkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 'expert_verified' WHEN 'O' THEN 'auto_extracted' WHEN 'P' THEN 'contradicted' END AS status, year(o_orderdate) AS year, least(o_totalprice / 500000, 1.0) AS confidence, o_orderpriority AS fact_type FROM orders),
entity AS (SELECT p_partkey AS entity_id, p_type AS type, p_brand AS name, p_name AS canonical_name, p_retailprice AS confidence FROM part),
about AS (SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS entity_id FROM lineitem),
supported AS (SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS chunk_id FROM lineitem),
lines AS (
  SELECT l_orderkey AS fact_id, 'quantity' AS parameter, l_quantity AS v, 't' AS unit FROM lineitem
  UNION ALL SELECT l_orderkey, 'discount', l_discount, '%' FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_tax, '%' FROM lineitem),
param AS (
  SELECT fact_id, parameter, unit, min(v) AS value_min, max(v) AS value_max, CASE WHEN min(v) = max(v) THEN min(v) END AS value FROM lines GROUP BY fact_id, parameter, unit),
chunk AS (SELECT doc_id AS chunk_id, source AS document_id, lang AS source_type, text, n_chars FROM documents),
seen AS (SELECT fact.*, title, access_level, country, geo_scope FROM fact JOIN src USING (source_id) WHERE coalesce(access_level, 'internal') IN ('public', 'internal')),
tok AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM chunk)
"""
