"""What tools show of chunks, documents, concepts and summaries: projections with stable names and without nulls in lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_LISTS = ("child_ids", "sibling_ids", "section_path", "topic_tags")
CHUNK_FLAGS = ("has_table", "has_code", "has_math", "has_list", "has_image")
CHUNK = ("chunk_id", "content", "level", "token_count", "word_count", "parent_id", "prev_id", "next_id", "document_id", "semantic_type", "sequence_position", "header_text", "header_level", "block_type", *CHUNK_LISTS, *CHUNK_FLAGS)


def chunk_record(chunks: DataFrame) -> DataFrame:
    """Chunks with their metadata as one flat record: missing lists are empty, missing flags false, other missing columns null."""
    have = set(chunks.columns)

    def value(name: str):
        c = F.col(name) if name in have else F.lit(None)
        if name in CHUNK_LISTS:
            return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")).alias(name)
        return F.coalesce(c.cast("boolean"), F.lit(False)).alias(name) if name in CHUNK_FLAGS else c.alias(name)

    return chunks.select(*map(value, CHUNK))


def search_record(found: DataFrame, score: str = "score") -> DataFrame:
    """Found chunks with ``similarity_score`` to four digits; the score itself stays as it is in the tables."""
    return chunk_record(found.withColumnRenamed(score, "__s")).join(found.select("chunk_id", F.round(score, 4).alias("similarity_score")), "chunk_id")


def document_record(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, title, tags, chunk_count, created_at) by document_id; 0 chunks where there are none."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    tags = F.coalesce("tag_list", F.array().cast("array<string>"))
    return documents.join(n, "document_id", "left").select(F.col("document_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), tags.alias("tags"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "created_at")


def concept_record(concepts: DataFrame) -> DataFrame:
    """(concept_id, name, concept_type, definition, aliases) without nulls."""
    return concepts.select("concept_id", "name", F.coalesce("concept_type", F.lit("term")).alias("concept_type"), F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
