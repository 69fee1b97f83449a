"""Concepts: aggregation over mentions, merging, name resolution, cleaning, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import singular, slug

#: Base types of concepts, and synonyms that map onto them (fixed values).
BASE_TYPES = ("term", "formula", "method", "principle", "process")
SYNONYMS = {"equation": "formula", "technique": "method", "algorithm": "method", "procedure": "process", "law": "principle", "theorem": "principle", "rule": "principle", "definition": "term", "concept": "term", "workflow": "process"}


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def distinct_aliases(arrays: Column) -> Column:
    """Aliases without repeats in other letter case; the first spelling stays."""
    lows = F.transform(arrays, F.lower)
    return F.filter(arrays, lambda a, i: F.array_position(lows, F.lower(a)) == i + 1)


def base_type(c: Column | str) -> Column:
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    known = F.create_map(*[F.lit(x) for kv in {**{b: b for b in BASE_TYPES}, **SYNONYMS}.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), F.lit("term"))


def aggregate(mentions: DataFrame) -> DataFrame:
    """One row a concept_id from mentions (concept_id, ord, name, concept_type, definition, aliases, occurrence).

    The first name and type count, the longest definition (the first of equally long ones), occurrences and aliases
    in order of mention without repeats, and the number of mentions; concepts without any definition are left out."""
    d = F.coalesce("definition", F.lit(""))
    out = mentions.groupBy("concept_id").agg(
        F.min_by("name", "ord").alias("name"),
        F.min_by("concept_type", "ord").alias("concept_type"),
        F.max_by(d, F.struct(F.length(F.trim(d)), -F.col("ord"))).alias("definition"),
        F.count("*").alias("occurrence_count"),
        F.transform(F.array_sort(F.collect_set(F.struct("ord", "occurrence"))), lambda x: x["occurrence"]).alias("occurrences"),
        F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("ord", _texts("aliases").alias("a")))), lambda x: x["a"])).alias("aliases"),
    )
    out = out.withColumn("occurrences", F.array_distinct("occurrences")).withColumn("aliases", F.array_distinct("aliases"))
    return out.where(F.length(F.trim("definition")) > 0)


def merge_by_name(concepts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both tables with one row a name: the stored row's fields win, source_documents are united and sorted, aliases
    united without regard to letter case, stored spellings first."""
    both = concepts.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct("__new", "concept_id")
    out = both.groupBy("name").agg(
        F.min_by("concept_id", rank).alias("concept_id"), F.min_by("concept_type", rank).alias("concept_type"), F.min_by("definition", rank).alias("definition"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(_texts("source_documents"))))).alias("source_documents"),
        F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("__new", "concept_id", _texts("aliases").alias("a")))), lambda x: x["a"])).alias("aliases"),
    )
    return out.withColumn("aliases", distinct_aliases(F.col("aliases")))


def resolve(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, concept_id) for names (wanted): by exact name, else by slug as id, else by alias in any letter case;
    the smallest concept_id of several."""
    by_name = names.join(concepts.select(F.col("name").alias("wanted"), "concept_id"), "wanted").withColumn("way", F.lit(1))
    by_id = names.withColumn("concept_id", slug("wanted")).join(concepts.select("concept_id"), "concept_id", "left_semi").select("wanted", "concept_id", F.lit(2).alias("way"))
    alias = concepts.select("concept_id", F.explode("aliases").alias("a")).select("concept_id", F.lower("a").alias("k"))
    by_alias = names.withColumn("k", F.lower("wanted")).join(alias, "k").select("wanted", "concept_id", F.lit(3).alias("way"))
    return by_name.unionByName(by_id).unionByName(by_alias).groupBy("wanted").agg(F.min(F.struct("way", "concept_id"))["concept_id"].alias("concept_id"))


def is_garbage(least_words: int = 3) -> Column:
    """No definition, or one of fewer words."""
    d = F.trim(F.coalesce("definition", F.lit("")))
    return (d == "") | (F.regexp_count(d, F.lit(r"\S+")) < least_words)


def dedup_keywords(keywords: DataFrame) -> DataFrame:
    """(doc_id, keyword, score): of keywords that are equal in the singular the one of least score."""
    key = singular(F.lower("keyword"))
    w = Window.partitionBy("doc_id", "__k").orderBy("score", "keyword")
    return keywords.withColumn("__k", key).withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).select("doc_id", "keyword", "score")


def header_relations(concepts: DataFrame, numeric: bool = True) -> DataFrame:
    """(src, dst) parent_of pairs: for each concept (document_id, chunk_id, concept_id, header_level) the nearest one
    before it of a smaller level. Order is by the chunk's number, or by its id as text."""
    n = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long") if numeric else F.lit(0)
    w = Window.partitionBy("document_id").orderBy(n, "chunk_id", "concept_id")
    rows = concepts.where("header_level IS NOT NULL").withColumn("__o", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # for each of six levels the last concept before; the parent is the latest of those above this level
    for k in range(1, 7):
        rows = rows.withColumn(f"__p{k}", F.max(F.when(F.col("header_level") == k, F.struct("__o", "concept_id"))).over(before))
    best = F.greatest(*[F.when(F.col("header_level") > k, F.col(f"__p{k}")) for k in range(1, 7)])
    return rows.select(best["concept_id"].alias("src"), F.col("concept_id").alias("dst")).where("src IS NOT NULL")


def export_rows(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept_id", "name", F.col("concept_type").alias("type"), "definition", F.array_join(_texts("aliases"), "; ").alias("aliases"))
