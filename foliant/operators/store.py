"""Changes to tables: upserts, deletes with their cascades, repairs, deduplication. Each returns the table's new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import word_count
from foliant.operators.graph import links


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of the same key; the others stay."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_document(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a document, its chunks and their vectors. Summaries and concepts stay."""
    gone = chunks.where(F.col("document_id") == document_id).select("chunk_id")
    keep = F.coalesce(F.col("document_id") != document_id, F.lit(True))
    return documents.where(keep), chunks.where(keep), vectors.join(gone, "chunk_id", "left_anti")


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the given chunks; the neighbours' links skip them and parents' child_ids lose them.

    prev_id and next_id are set anew from the order of what remains in each document and level."""
    gone = ids.select("chunk_id").distinct()
    left = chunks.join(gone, "chunk_id", "left_anti")
    left = links(left)
    dead = left.select(F.col("chunk_id"), F.explode("child_ids").alias("child")).join(gone.select(F.col("chunk_id").alias("child")), "child")
    dead = dead.groupBy("chunk_id").agg(F.collect_set("child").alias("__dead"))
    out = left.join(dead, "chunk_id", "left")
    return out.withColumn("child_ids", F.when(F.col("__dead").isNull(), F.col("child_ids")).otherwise(F.array_except("child_ids", "__dead"))).drop("__dead")


def update_content(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """New content for some chunk_ids: word_count follows, token_count stays as it was."""
    new = changes.select("chunk_id", F.col("content").alias("__new"))
    out = chunks.join(new, "chunk_id", "left").withColumn("word_count", F.when(F.col("__new").isNotNull(), word_count("__new").cast("int")).otherwise(F.col("word_count")))
    return out.withColumn("content", F.coalesce("__new", "content")).drop("__new")


def dedup_edges(edges: DataFrame, keys: tuple[str, str] = ("src", "dst")) -> DataFrame:
    return edges.select(*keys).distinct()


def edge_duplicates(edges: DataFrame, keys: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """One row: total, unique and duplicate edges. Equal edges are counted before anything is distinct."""
    return edges.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_edges")).withColumn("duplicates", F.col("total") - F.col("unique_edges"))


def keep_newest(df: DataFrame, key: str, ts: str, tie: list[Column]) -> DataFrame:
    """The newest row of each key by a max over a struct: combined before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col(ts), *tie))
    return df.groupBy(key).agg(best.alias("__r")).select(key, "__r.*").select(*df.columns)


def repair_set(sections: DataFrame, summaries: DataFrame, share: float = 0.2, most: int = 20) -> DataFrame:
    """(source_id, reason) of chapters without a summary, and of summaries with fewer words than the lesser of ``most``
    and ``share`` of the document's upper median."""
    have = summaries.select("source_id", "document_id", "word_count")
    missing = sections.select("source_id").join(have.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("missing").alias("reason"))
    w = Window.partitionBy("document_id")
    ranked = have.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("word_count", "source_id")))
    median = ranked.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("document_id", F.col("word_count").alias("median"))
    short = have.join(median, "document_id").where(F.col("word_count") < F.least(F.col("median") * share, F.lit(float(most)))).select("source_id", F.lit("truncated").alias("reason"))
    return missing.unionByName(short)


def document_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, chunks by level and tokens, in one aggregate."""
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("total_chunks"), *[F.count_if(F.col("level") == k).alias(f"level_{k}") for k in (0, 1, 2)], F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens")
    )


def chunk_types(chunks: DataFrame) -> DataFrame:
    """(document_id, by_type): a sorted array of (semantic type, chunks) for each document; null types are unknown."""
    types = chunks.groupBy("document_id", F.coalesce("semantic_type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    return types.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("type", "n"))).alias("by_type"))


def status_counts(files: DataFrame, column: str = "status", values: tuple[str, ...] = ("pending", "processing", "completed", "failed", "skipped")) -> DataFrame:
    """One row with a count for each status, 0 where there is none, and the total."""
    return files.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def changed_files(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, reason) of local files that are missing or of another size on the other side."""
    other = remote.select("path", F.col("size").alias("remote_size"))
    both = local.select("path", "size").join(other, "path", "left")
    return both.where("remote_size IS NULL OR remote_size <> size").select("path", F.when(F.col("remote_size").isNull(), "missing").otherwise("size").alias("reason"))
