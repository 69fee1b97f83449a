"""The query surface: one function a tool, each of which returns a DataFrame over a Library's tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import display
from foliant.functions import text as tx
from foliant.functions.vectors import offline_embedding
from foliant.operators import concepts as co
from foliant.operators import graph, search, store


def offline_query(spark, text: str, dim: int = 384) -> list[float]:
    """The deterministic stand-in for an embedding provider, for one query."""
    return list(spark.range(1).select(offline_embedding(F.lit(text), dim).alias("v")).head()[0])


@dataclass
class Library:
    """The tables of a knowledge base, and providers that may be replaced.

    chunks carries its metadata (document_id, semantic_type, flags, sequence_position); embed takes (spark, text).
    """

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    concepts: DataFrame | None = None
    edges: DataFrame | None = None
    defines: DataFrame | None = None
    summaries: DataFrame | None = None
    embed: Callable = field(default=offline_query)

    # chunks

    def search_semantic(self, query: str | Sequence[float], top_k: int = 5, threshold: float | None = 0.0, tags: Sequence[str] | None = None, **conditions) -> DataFrame:
        vector = self.embed(self.chunks.sparkSession, query) if isinstance(query, str) else query
        rows = self.chunks.where(search.chunk_filter(**conditions)) if conditions else self.chunks
        if tags:
            rows = rows.join(search.with_all_tags(self.documents, tags).select("document_id"), "document_id", "left_semi")
        return search.search_similar(self.vectors.select("chunk_id", "embedding").join(rows, "chunk_id"), vector, top_k, threshold).drop("embedding")

    def search_reranked(self, query: str | Sequence[float], score, top_k: int = 5, over: int = 3, threshold: float | None = 0.0, tags: Sequence[str] | None = None, **conditions) -> DataFrame:
        """``over`` times as many rows as asked for by cosine, of which the best by another score remain. ``score`` is a
        column, or a function of the query that gives one; where it fails to give one the order by cosine stays."""
        found = self.search_semantic(query, top_k * over, threshold, tags, **conditions)
        try:
            by = score(query) if callable(score) else score
        except Exception:  # a provider that can't be reached must not fail the search
            by = F.lit(None).cast("double")
        return search.rerank(found, by, top_k)

    def resource(self, uri: str) -> DataFrame:
        """(uri, json) of ``library://documents``, ``library://document/ID``, ``library://chunk/ID`` or ``library://schema``;
        no row for an unknown id."""
        kind, _, name = uri.removeprefix("library://").partition("/")
        if kind == "schema":
            found = {k: v.schema.simpleString() for k in ("documents", "chunks", "vectors", "concepts", "edges", "summaries") if (v := getattr(self, k)) is not None}
            return self.chunks.sparkSession.createDataFrame([(uri, json.dumps(found))], "uri string, json string")
        if kind == "documents":
            rows = self.documents
        elif kind == "document":
            rows = self.documents.where(F.col("document_id") == name)
        elif kind == "chunk":
            rows = display.chunk_record(self.get_chunk(name))
        else:
            raise ValueError(f"unknown resource {uri}")
        return rows.select(F.lit(uri).alias("uri"), F.to_json(F.struct("*")).alias("json"))

    def search_keyword(self, keyword: str, doc_id: str | None = None, case_sensitive: bool = False) -> DataFrame:
        return search.search_keyword(self.chunks, keyword, case_sensitive, search.chunk_filter(doc_id=doc_id) if doc_id else None)

    def search_bm25(self, query: str, k: int = 100) -> DataFrame:
        return search.search_bm25(self.chunks, query, k)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == chunk_id)

    def get_context_window(self, chunk_id: str, window_size: int = 2) -> DataFrame:
        near = graph.context_window(self.chunks, self.get_chunk(chunk_id).select("chunk_id"), window_size)
        return near.select("offset", F.col("neighbour_id").alias("chunk_id")).join(self.chunks, "chunk_id").orderBy("offset")

    def get_parent(self, chunk_id: str) -> DataFrame:
        up = self.get_chunk(chunk_id).select(F.col("parent_id").alias("chunk_id"))
        return self.chunks.join(up, "chunk_id", "left_semi")

    def get_children(self, chunk_id: str) -> DataFrame:
        kids = self.get_chunk(chunk_id).select(F.posexplode("child_ids").alias("position", "chunk_id"))
        return kids.join(self.chunks, "chunk_id").orderBy("position")

    def get_siblings(self, chunk_id: str) -> DataFrame:
        return self.chunks.join(graph.siblings(self.chunks, self.get_chunk(chunk_id).select("chunk_id")).select(F.col("sibling_id").alias("chunk_id")), "chunk_id", "left_semi")

    def get_chunk_images(self, chunk_id: str) -> DataFrame:
        found = self.get_chunk(chunk_id).select("chunk_id", F.explode(F.regexp_extract_all("content", F.lit(r"!\[.*?\]\((.+?)\)"), 1)).alias("image"))
        return found.where(F.lower("image").rlike(r"\.(png|jpe?g)$"))

    # documents

    def list_documents(self, tags: Sequence[str] | None = None) -> DataFrame:
        return search.with_all_tags(self.documents, tags) if tags else self.documents

    def get_document_chunks(self, doc_id: str, level: int | None = None) -> DataFrame:
        return self.chunks.where(search.chunk_filter(doc_id=doc_id, level=level)).orderBy("sequence_position", "chunk_id")

    def get_document_stats(self, doc_id: str) -> DataFrame:
        own = self.chunks.where(F.col("document_id") == doc_id)
        return store.document_stats(own).join(store.chunk_types(own), "document_id")

    # concepts

    def list_concepts(self, doc_id: str | None = None, concept_type: str | None = None) -> DataFrame:
        out = self.concepts
        if doc_id is not None:
            ids = self.chunks.where(F.col("document_id") == doc_id).select("chunk_id")
            out = out.join(self.defines.join(ids, "chunk_id", "left_semi").select("concept_id"), "concept_id", "left_semi")
        return out if concept_type is None else out.where(F.lower("concept_type") == concept_type.lower())

    def get_concept(self, name: str) -> DataFrame:
        spark = self.concepts.sparkSession
        return self.concepts.join(co.resolve(self.concepts, spark.range(1).select(F.lit(name).alias("wanted"))).select("concept_id"), "concept_id", "left_semi")

    def get_related_concepts(self, name: str, include_reverse: bool = False, types: Sequence[str] = ("relates_to",)) -> DataFrame:
        near = graph.related_both(self.edges, types) if include_reverse else graph.related(self.edges, types)
        ids = near.join(self.get_concept(name).select("concept_id"), "concept_id", "left_semi").select(F.col("related_id").alias("concept_id"))
        return self.concepts.join(ids, "concept_id", "left_semi")

    def get_concept_with_citations(self, name: str, chars: int = 200) -> DataFrame:
        rows = self.get_concept(name).join(self.defines, "concept_id").join(self.chunks.select("chunk_id", "document_id", "content"), "chunk_id")
        return rows.select("concept_id", "name", "chunk_id", "document_id", tx.preview("content", chars).alias("preview"))

    def explain_concept(self, name: str, chunks: int = 3, related: int = 5) -> DataFrame:
        """One row: the concept, its first definitions and its first related concepts."""
        c = self.get_concept(name)
        first = lambda df, n, *by: df.withColumn("__r", F.row_number().over(Window.partitionBy("concept_id").orderBy(*by))).where(F.col("__r") <= n)
        cites = first(self.get_concept_with_citations(name, 300), chunks, "chunk_id", "preview").groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "preview"))).alias("definitions"))
        ids = graph.related(self.edges, graph.EDGE_TYPES).join(c.select("concept_id"), "concept_id", "left_semi").select("concept_id", "related_id").distinct()
        near = first(ids, related, "related_id").groupBy("concept_id").agg(F.array_sort(F.collect_list("related_id")).alias("related"))
        return c.join(cites, "concept_id", "left").join(near, "concept_id", "left")

    def search_concepts(self, query: str, top_k: int = 10) -> DataFrame:
        return search.search_concepts(self.concepts, query, top_k)

    def get_concept_graph_dot(self) -> DataFrame:
        return graph.dot_rows(self.edges.where("type = 'relates_to'"))

    def rank_concepts(self, top_k: int = 20) -> DataFrame:
        return graph.rank_concepts(self.concepts, self.edges, top_k)

    # summaries

    def get_summaries(self, doc_id: str, level: str | None = None) -> DataFrame:
        out = self.summaries.where((F.col("document_id") == doc_id) & (F.length("summary_id") > 0))
        return out if level is None else out.where(F.col("level") == level)

    def get_document_summary(self, doc_id: str) -> DataFrame:
        return self.get_summaries(doc_id, "document").orderBy("summary_id").limit(1)

    def get_summary_hierarchy(self, doc_id: str) -> DataFrame:
        return graph.hierarchy(self.get_summaries(doc_id))

    def list_summarized_documents(self) -> DataFrame:
        n = self.summaries.groupBy("document_id").agg(F.count("*").alias("summaries"))
        return n.join(self.documents.select("document_id", "title"), "document_id", "left").withColumn("title", F.coalesce("title", "document_id"))

    def search_summaries(self, query: str | Sequence[float], vectors: DataFrame, top_k: int = 5, level: str | None = None, doc_id: str | None = None) -> DataFrame:
        """``vectors``: summary_id, embedding. Conditions come before the ranking."""
        rows = self.summaries if level is None else self.summaries.where(F.col("level") == level)
        rows = rows if doc_id is None else rows.where(F.col("document_id") == doc_id)
        vector = self.embed(rows.sparkSession, query) if isinstance(query, str) else query
        return search.search_similar(vectors.join(rows, "summary_id"), vector, top_k, key="summary_id").drop("embedding")


def summarize(chunks: DataFrame, sentences: int = 5) -> DataFrame:
    """Three levels of summaries without a model: sections lead with their first sentences, chapters with those of their
    sections, documents with those of their chapters. (summary_id, document_id, level, source_id, parent_summary_id, content)."""
    leaf = chunks.where("level = 2 AND content IS NOT NULL")
    section = leaf.select(F.concat(F.lit("sum_"), "chunk_id").alias("summary_id"), "document_id", F.lit("section").alias("level"), F.col("chunk_id").alias("source_id"), F.concat(F.lit("sum_"), F.coalesce("parent_id", F.concat(F.lit("doc_"), "document_id"))).alias("parent_summary_id"), tx.lead("content", sentences).alias("content"), "sequence_position")

    def roll(rows: DataFrame, keys: list[str]) -> DataFrame:
        lead = tx.lead("content", 1).alias("s")
        rows = rows.select(*keys, "sequence_position", lead)  # only the first few of a group are gathered
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("sequence_position"), F.asc_nulls_first("s")))).where(F.col("__r") <= sentences)
        first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_position", "s"))), lambda x: x["s"]), " ")
        return rows.groupBy(*keys).agg(first.alias("content"), F.min("sequence_position").alias("sequence_position"))

    chapter = roll(section.where(F.col("parent_summary_id") != F.concat(F.lit("sum_doc_"), "document_id")), ["parent_summary_id", "document_id"])
    chapter = chapter.select(F.col("parent_summary_id").alias("summary_id"), "document_id", F.lit("chapter").alias("level"), F.expr("substr(parent_summary_id, 5)").alias("source_id"), F.concat(F.lit("sum_doc_"), "document_id").alias("parent_summary_id"), "content", "sequence_position")
    both = chapter.unionByName(section.where(F.col("parent_summary_id") == F.concat(F.lit("sum_doc_"), "document_id")))
    document = roll(both, ["document_id"]).select(F.concat(F.lit("sum_doc_"), "document_id").alias("summary_id"), "document_id", F.lit("document").alias("level"), F.col("document_id").alias("source_id"), F.lit(None).cast("string").alias("parent_summary_id"), "content", "sequence_position")
    return section.unionByName(chapter).unionByName(document).drop("sequence_position")
