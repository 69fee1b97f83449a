"""The reference's entities as views of the stored tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import latest, read_table
from foliant.functions.text import json_list


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Current chunks."""
    return latest(read_table(spark, d, "chunks"), ["chunk_id"], "ingested_at", [F.col("token_count").asc_nulls_last()])


def metadata(spark: SparkSession, d: str) -> DataFrame:
    return latest(read_table(spark, d, "chunk_metadata"), ["chunk_id"], "ingested_at", [F.col("document_id").asc_nulls_last(), F.col("sequence_position").asc_nulls_last()])


def described(spark: SparkSession, d: str) -> DataFrame:
    """Current chunks with their current metadata."""
    m = metadata(spark, d).select("chunk_id", "document_id", "semantic_type", "topic_tags", "word_count", "sequence_position", "sibling_ids", "has_table", "has_code", "has_math", "has_list", "has_image", "header_text", "header_level", "block_type")
    return chunks(spark, d).join(m, "chunk_id")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return latest(read_table(spark, d, "vectors"), ["chunk_id"], "embedded_at", [F.col("model_name").asc_nulls_last()])


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").withColumn("tag_list", json_list("tags"))


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as concepts: the type defines, the brand is an alias."""
    p = read_table(spark, d, "part")
    return p.select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("concept_id"), F.col("p_name").alias("name"), F.col("p_type").alias("concept_type"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("definition"), F.array("p_brand").alias("aliases"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges between keys: part requires supplier, supplier and customer are components of nations."""
    li = read_table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    su = read_table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    cu = read_table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    return li.withColumn("type", F.lit("requires")).unionByName(su.withColumn("type", F.lit("component_of"))).unionByName(cu.withColumn("type", F.lit("relates_to")))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as document, chapter and section summaries."""
    r = read_table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("summary_id"), F.lit(None).cast("string").alias("parent_summary_id"), F.lit("document").alias("level"))
    n = read_table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("summary_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_summary_id"), F.lit("chapter").alias("level"))
    c = read_table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("summary_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_summary_id"), F.lit("section").alias("level"))
    return r.unionByName(n).unionByName(c)


#: The same views for SQL; a query's SQL starts with WITH and those it names.
VIEWS = {
    "cur": "cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)",
    "meta": "meta AS (SELECT * FROM chunk_metadata QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)",
    "des": "des AS (SELECT c.*, m.document_id, m.semantic_type, m.topic_tags, m.word_count, m.sequence_position, m.sibling_ids, m.has_table, m.has_code, m.has_math, m.has_list, m.has_image, m.header_text, m.header_level, m.block_type FROM cur c JOIN meta m USING (chunk_id))",
    "vec": "vec AS (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC) = 1)",
    "con": "con AS (SELECT 'c' || p_partkey AS concept_id, p_name AS name, p_type AS concept_type, p_name || ' ' || p_type || ' ' || p_brand AS definition, [p_brand] AS aliases FROM part)",
    "edg": "edg AS (SELECT DISTINCT 'c' || l_partkey AS src, 's' || l_suppkey AS dst, 'requires' AS type FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'component_of' FROM supplier UNION ALL SELECT 'u' || c_custkey, 'n' || c_nationkey, 'relates_to' FROM customer)",
    "summ": "summ AS (SELECT 'r' || r_regionkey AS summary_id, NULL::VARCHAR AS parent_summary_id, 'document' AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'chapter' FROM nation UNION ALL SELECT 'u' || c_custkey, 'n' || c_nationkey, 'section' FROM customer)",
}


def sql(views: str, body: str) -> str:
    names = views.split()
    return ("WITH " + ", ".join(VIEWS[n] for n in names) + " " if names else "") + body
