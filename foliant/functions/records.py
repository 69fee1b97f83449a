"""Record helpers: validation, the stored text form of records, summary titles, display names, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import json_list

TITLE = "__title__:"  # marks the chapter title among a summary's key points (fixed value)
LAST_CHAPTER = 999_999  # sort key of chapters without a number (fixed value)
TYPES = ("definition", "example", "procedure", "theorem", "narrative", "cli_command", "code_example")
STRICT_TYPES = TYPES[:5]


def chunk_errors(strict: bool = False) -> Column:
    """Array of what is wrong with a chunk row: missing fields, an unknown level, type or header level."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("chunk_id", "content", "level", "token_count")]
    return F.array_compact(F.array(
        *missing,
        F.when(~F.col("level").isin(0, 1, 2), F.lit("level is not 0, 1 or 2")),
        F.when(~F.col("semantic_type").isin(*(STRICT_TYPES if strict else TYPES)), F.concat(F.lit("unknown semantic_type "), "semantic_type")),
        F.when(~F.col("header_level").between(0, 6), F.lit("header_level is not between 0 and 6")),
    ))


def document_errors() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("document_id", "title")]))


def to_node(chunks: DataFrame) -> DataFrame:
    """Chunks as flat nodes: lists as JSON text, flags as 0 and 1, missing texts empty and missing numbers 0."""
    kinds = dict(chunks.dtypes)
    out = []
    for c, kind in kinds.items():
        col = F.col(c)
        if kind.startswith("array"):
            col = F.to_json(F.coalesce(col, F.array().cast(kind)))
        elif kind == "boolean":
            col = F.coalesce(col, F.lit(False)).cast("int")
        elif kind == "string":
            col = F.coalesce(col, F.lit(""))
        elif kind in ("int", "bigint"):
            col = F.coalesce(col, F.lit(0).cast(kind))
        out.append(col.alias(c))
    return chunks.select(*out)


def from_node(nodes: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The rows of to_node with the column types ``kinds``; empty texts of nullable links become null."""
    out = []
    for c, kind in kinds.items():
        col = F.col(c)
        if kind.startswith("array"):
            col = json_list(col)
        elif kind == "boolean":
            col = col == 1
        elif kind == "string" and c in ("parent_id", "prev_id", "next_id"):
            col = F.nullif(col, F.lit(""))
        out.append(col.alias(c))
    return nodes.select(*out)


def chapter_title(key_points: Column) -> Column:
    """The title that the key points carry, or null."""
    found = F.filter(key_points, lambda k: k.startswith(TITLE))
    return F.substring(F.get(found, F.lit(0)), len(TITLE) + 1, 1_000_000)


def shown_points(key_points: Column) -> Column:
    return F.filter(key_points, lambda k: ~k.startswith(TITLE))


def chapter_order(source_id: Column | str = "source_id") -> Column:
    """The number a source_id ends in; chapters without one come last."""
    c = F.col(source_id) if isinstance(source_id, str) else source_id
    n = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{1,18})$", 1)
    return F.struct(F.coalesce(F.nullif(n, F.lit("")).cast("long"), F.lit(LAST_CHAPTER).cast("long")).alias("n"), c.alias("id"))


def ordered_summaries(summaries: DataFrame) -> DataFrame:
    """Document first, then chapters and sections by number, titles apart from the points."""
    points = json_list("key_points")
    rank = F.when(F.col("level") == "document", 0).when(F.col("level") == "chapter", 1).otherwise(2)
    return summaries.withColumn("title", chapter_title(points)).withColumn("points", shown_points(points)).orderBy(rank, chapter_order(), "summary_id")


def short_name(c: Column | str, n: int = 50) -> Column:
    """Spaces for underscores, cut with an ellipsis."""
    c = F.replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("_"), F.lit(" "))
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def first_words(c: Column | str, n: int = 3) -> Column:
    """The first n parts of more than one letter, or the start of the name."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.slice(F.filter(F.split(c, "_"), lambda p: F.length(p) > 1), 1, n)
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.left(c, F.lit(30)))


def parse_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, size) from listing lines ``size name``; other lines are left out."""
    c = F.trim(column)
    rows = lines.select(F.regexp_extract(c, r"^(\d{1,18})\s+(.+)$", 1).alias("s"), F.regexp_extract(c, r"^(\d{1,18})\s+(.+)$", 2).alias("name"))
    return rows.where("s <> ''").select("name", F.col("s").cast("long").alias("size"))


def block_images(blocks: DataFrame, folder: str) -> DataFrame:
    """(document_id, chunk_idx, block_idx, image_url, path): where the image of each block with one is kept."""
    path = F.format_string(f"{folder}/%s/chunk%d_block%d.png", F.col("document_id"), F.col("chunk_idx"), F.col("block_idx"))
    return blocks.where("image_url IS NOT NULL").select("document_id", "chunk_idx", "block_idx", "image_url", path.alias("path"))
