"""Files as tables: markdown documents, inbox listings, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import file_stem, title_of


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md", recursive: bool = False, skip: DataFrame | None = None) -> DataFrame:
    """(document_id, title, path, text) of text files; documents in ``skip`` (document_id) are left out."""
    r = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    df = r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    df = df.select(file_stem("path").alias("document_id"), title_of("path", "text").alias("title"), "path", "text")
    return df if skip is None else df.join(skip.select("document_id").distinct(), "document_id", "left_anti")


def list_files(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]", recursive: bool = False) -> DataFrame:
    """(path, name, size, modified_at) without reading contents: the content column is pruned from the scan."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return df.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("modified_at", "path")).alias("path"))


def write_chunks(chunks: DataFrame, path: str, kind: str = "json", preview: int = 500) -> None:
    """json and parquet as they are; csv with arrays joined and content cut for display; markdown a block a chunk."""
    if kind == "csv":
        flat = chunks.select("chunk_id", "level", "token_count", F.array_join("section_path", " > ").alias("section_path"), F.left("content", F.lit(preview)).alias("content"))
        flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "markdown":
        chunks.select(F.format_string("## %s\n\n%s\n\n---\n", "chunk_id", F.coalesce("content", F.lit(""))).alias("value")).write.mode("overwrite").text(path)
    else:
        getattr(chunks.write.mode("overwrite"), kind)(path)
