"""From concepts and summaries to the links and figures that a specialist built on one book needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import slug


def occurrence_edges(concepts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, concept_id), each once, from occurrences ``summary_CHUNK`` or ``summary_CHUNK_LEVEL`` (section, chapter,
    document) of concepts (concept_id, occurrences); others and unknown chunks give none."""
    inner = F.regexp_extract("o", r"(?s)^summary_(.*?)(?:_(?:section|chapter|document))?$", 1)
    pairs = concepts.select("concept_id", F.explode("occurrences").alias("o")).where(F.col("o").startswith("summary_"))
    return pairs.select(inner.alias("chunk_id"), "concept_id").distinct().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "concept_id")


def connected(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """``concepts`` with ``connections``: how many edges leave each, 0 where none does."""
    n = edges.groupBy(F.col("src").alias("concept_id")).agg(F.count("*").alias("connections"))
    return concepts.join(n, "concept_id", "left").withColumn("connections", F.coalesce("connections", F.lit(0)))


def specialist(concepts: DataFrame, edges: DataFrame, chapters: DataFrame, title: str, top: int = 10) -> DataFrame:
    """One row: name, description, expertise and figures of a specialist on one book.

    ``expertise`` are the ``top`` concepts with the most edges (ties by concept_id); concept_types are counted over all
    concepts, most frequent first. Null types are ``unknown``.
    """
    ranked = connected(concepts, edges).orderBy(F.desc("connections"), "concept_id").limit(top)
    item = F.struct(-F.col("connections"), "concept_id", "name")
    best = ranked.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["name"]).alias("expertise"))  # ``top`` rows
    types = concepts.groupBy(F.coalesce("concept_type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    total = concepts.agg(F.count("*").alias("total_concepts")).crossJoin(chapters.agg(F.count("*").alias("total_chapters")))  # one row each
    kinds = types.orderBy(F.desc("n"), "type").limit(1000)
    kinds = kinds.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))).alias("k")).select(F.transform("k", lambda x: F.concat_ws(":", x["type"], -x["n"])).alias("concept_types"))
    one = total.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(kinds))
    text = F.concat(F.lit(f"Specialist on '{title}' with "), F.col("total_concepts").cast("string"), F.lit(" concepts in "), F.col("total_chapters").cast("string"), F.lit(" chapters"))
    return one.select(F.concat(slug(F.lit(title)), F.lit("_specialist")).alias("name"), text.alias("description"), "expertise", "concept_types", "total_concepts", "total_chapters")


def shared_concepts(mentions: DataFrame, least: int = 2) -> DataFrame:
    """(concept_id, documents, size) of concepts that ``least`` documents or more have, from (concept_id, document_id); size
    is that of the node in a drawing, 15 and 5 for each further document."""
    n = mentions.distinct().groupBy("concept_id").agg(F.count("*").alias("documents")).where(F.col("documents") >= least)
    return n.withColumn("size", 15 + 5 * (F.col("documents") - 1))
