"""From markdown to the stored tables: chunks, their metadata, vectors and the document itself, written together."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions.vectors import offline_embedding
from foliant.operators import chunker, store

TABLES = ("documents", "chunks", "chunk_metadata", "vectors")
KEYS = {"documents": "document_id", "chunks": "chunk_id", "chunk_metadata": "chunk_id", "vectors": "chunk_id"}


def ingest(documents: DataFrame, dim: int = 384, embedding=None, model: str = "offline") -> dict[str, DataFrame]:
    """The four tables' rows for documents (document_id, title, text): two levels of chunks, what their text shows about
    them, and vectors of the leaves. ``embedding`` is a column of the leaves' content; the default needs no service."""
    chunks = chunker.document_chunks(documents)
    flags = tx.content_flags("content")
    header = tx.header_info("content")
    meta = chunks.select(
        "chunk_id", "document_id", tx.semantic_type("content").alias("semantic_type"), tx.topic_tags("content").alias("topic_tags"), "token_count", tx.word_count("content").cast("int").alias("word_count"),
        F.col("level").alias("hierarchy_level"), "section_path", "sequence_position", "parent_id", *[c.alias(k) for k, c in flags.items()],
        header["header_text"].alias("header_text"), header["header_level"].cast("int").alias("header_level"),
    )
    vector = embedding if embedding is not None else offline_embedding(F.col("content"), dim)
    leaves = chunks.where("level = 2 AND content IS NOT NULL")
    vectors = leaves.select("chunk_id", vector.alias("embedding"), F.lit(model).alias("model_name")).withColumn("embedding_dim", F.size("embedding"))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    docs = documents.drop("text").join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return {"documents": docs, "chunks": chunks, "chunk_metadata": meta, "vectors": vectors}


def store_document(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with what ``ingest`` gave: everything of a document that is stored again is replaced."""
    gone = tables["chunks"].join(new["documents"].select("document_id"), "document_id", "left_semi").select("chunk_id")
    out = {"documents": store.upsert(tables["documents"], new["documents"], ["document_id"])}
    for name in TABLES[1:]:
        out[name] = store.upsert(store.delete(tables[name], gone, "chunk_id"), new[name], ["chunk_id"])
    return out


def unpaired(tables: dict[str, DataFrame]) -> DataFrame:
    """(chunk_id, problem) of chunks without metadata, leaves without vector, and metadata or vectors without chunk."""
    c, m, v = (tables[n].select("chunk_id").distinct() for n in TABLES[1:])
    leaf = tables["chunks"].where("level = 2 AND content IS NOT NULL").select("chunk_id").distinct()
    parts = ((c, m, "no metadata"), (leaf, v, "no vector"), (m, c, "metadata of no chunk"), (v, c, "vector of no chunk"))
    rows = [a.join(b, "chunk_id", "left_anti").select("chunk_id", F.lit(p).alias("problem")) for a, b, p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes each table to parquet. Chunks and metadata go to one partition a document, and only those written change."""
    for name, df in tables.items():
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (out.partitionBy("document_id") if name in ("chunks", "chunk_metadata") else out).parquet(os.path.join(folder, name))


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(folder, n)) for n in TABLES}
