"""The stored queries of the knowledge base over node tables and one edges table (src, dst, type).

Every look-up is an equality on a key, every hop a join on the edges of one type, every drop an anti-join. NAMED lists
the queries by name; ``run`` answers one for many ids at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = {"document": "document_id", "chunk": "chunk_id", "concept": "concept_id", "summary": "summary_id", "chunk_vector": "vector_id", "summary_vector": "vector_id"}
#: name -> (kind, ...): all (node), by (node, columns), out and in (from node, edge type, to node) (fixed values).
NAMED: dict[str, tuple] = {
    "list_documents": ("all", "document"), "list_concepts": ("all", "concept"), "list_summaries": ("all", "summary"),
    "document": ("by", "document", "document_id"), "chunk": ("by", "chunk", "chunk_id"), "chunks_by_document": ("by", "chunk", "document_id"), "chunks_by_level": ("by", "chunk", "level"),
    "chunks_by_document_and_level": ("by", "chunk", "document_id", "level"), "chunks_by_parent": ("by", "chunk", "parent_id"), "concept_by_name": ("by", "concept", "name"), "concept": ("by", "concept", "concept_id"),
    "summary": ("by", "summary", "summary_id"), "summaries_by_document": ("by", "summary", "document_id"), "summaries_by_document_and_level": ("by", "summary", "document_id", "level"),
    "summaries_by_source": ("by", "summary", "source_id"), "summaries_by_level": ("by", "summary", "level"),
    "document_chunks": ("out", "document", "has_chunk", "chunk"), "parent_chunk": ("in", "chunk", "parent_of", "chunk"), "child_chunks": ("out", "chunk", "parent_of", "chunk"),
    "next_chunk": ("out", "chunk", "next_sibling", "chunk"), "previous_chunk": ("in", "chunk", "next_sibling", "chunk"), "sibling_chunks": ("out", "chunk", "sibling_of", "chunk"),
    "vector_of_chunk": ("out", "chunk", "has_embedding", "chunk_vector"), "chunk_of_vector": ("in", "chunk_vector", "has_embedding", "chunk"),
    "concepts_of_chunk": ("out", "chunk", "defines_concept", "concept"), "definition_chunks": ("in", "concept", "defines_concept", "chunk"), "mention_chunks": ("in", "concept", "mentions_concept", "chunk"),
    "related": ("out", "concept", "relates_to", "concept"), "uses": ("out", "concept", "uses", "concept"), "requires": ("out", "concept", "requires", "concept"), "calculated_from": ("out", "concept", "calculated_from", "concept"),
    "component_of": ("out", "concept", "component_of", "concept"), "recorded_in": ("out", "concept", "recorded_in", "concept"), "supersedes": ("out", "concept", "supersedes", "concept"),
    "dependents": ("in", "concept", "relates_to", "concept"), "used_by": ("in", "concept", "uses", "concept"), "required_by": ("in", "concept", "requires", "concept"),
    "document_summaries": ("out", "document", "has_summary", "summary"), "chunk_summary": ("out", "chunk", "has_summary", "summary"), "summary_children": ("out", "summary", "has_child", "summary"),
    "summary_parent": ("in", "summary", "has_child", "summary"), "vector_of_summary": ("out", "summary", "has_embedding", "summary_vector"), "summary_of_vector": ("in", "summary_vector", "has_embedding", "summary"),
}


@dataclass(frozen=True)
class PropertyGraph:
    """Node tables by kind and their edges. Changes give a new graph; nothing is written until its tables are."""

    nodes: dict[str, DataFrame]
    edges: DataFrame
    keys: dict[str, str] = field(default_factory=lambda: dict(KEYS))

    def by(self, kind: str, **values) -> DataFrame:
        df = self.nodes[kind]
        for column, value in values.items():
            df = df.where(F.col(column) == value)
        return df

    def hop(self, ids: DataFrame, edge: str, to: str, reverse: bool = False) -> DataFrame:
        """(origin, node columns) one hop from ``ids`` (id). Edges count once."""
        a, b = ("dst", "src") if reverse else ("src", "dst")
        step = self.edges.where(F.col("type") == edge).select(F.col(a).alias("origin"), F.col(b).alias(self.keys[to])).distinct()
        return step.join(ids.select(F.col("id").alias("origin")), "origin", "left_semi").join(self.nodes[to], self.keys[to])

    def run(self, name: str, ids: DataFrame | None = None, **values) -> DataFrame:
        kind, *rest = NAMED[name]
        if kind == "all":
            return self.nodes[rest[0]]
        if kind == "by":
            return self.by(rest[0], **{c: values[c] for c in rest[1:]})
        return self.hop(ids, rest[1], rest[2], kind == "in")

    def add(self, kind: str, rows: DataFrame) -> PropertyGraph:
        return replace(self, nodes={**self.nodes, kind: self.nodes[kind].unionByName(rows, allowMissingColumns=True)})

    def link(self, pairs: DataFrame, edge: str) -> PropertyGraph:
        return replace(self, edges=self.edges.unionByName(pairs.select("src", "dst", F.lit(edge).alias("type"))))

    def update(self, kind: str, changes: DataFrame, nulls: bool = False) -> PropertyGraph:
        """Columns of ``changes`` replace those of the same key where they aren't null, or with ``nulls`` even there."""
        key = self.keys[kind]
        new = changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
        df = self.nodes[kind].join(new, key, "left")
        for c in changes.columns:
            if c != key:
                value = F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) if nulls else F.coalesce(F.col(f"__{c}"), F.col(c))
                df = df.withColumn(c, value).drop(f"__{c}")
        return replace(self, nodes={**self.nodes, kind: df.drop("__hit")})

    def drop(self, kind: str, ids: DataFrame) -> PropertyGraph:
        """Without these nodes and every edge of theirs."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = self.nodes[kind].join(gone.withColumnRenamed("id", self.keys[kind]), self.keys[kind], "left_anti")
        return replace(self, nodes={**self.nodes, kind: left}, edges=edges.select("src", "dst", "type"))

    def unlink(self, ids: DataFrame, edge: str) -> PropertyGraph:
        """Without the edges of a type out of these nodes."""
        gone = ids.select(F.col("id").alias("src"), F.lit(edge).alias("type")).distinct()
        return replace(self, edges=self.edges.join(gone, ["src", "type"], "left_anti").select("src", "dst", "type"))
