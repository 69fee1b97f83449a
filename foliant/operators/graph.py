"""Navigation: chunk hierarchy and order, typed concept edges, summary trees, co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.common import cut_lineage

#: Edge types between concepts in the order in which results list them (fixed values).
EDGE_TYPES = ("relates_to", "requires", "uses", "calculated_from", "recorded_in", "component_of", "parent_of")


def parents(chunks: DataFrame) -> DataFrame:
    """(chunk_id, parent_id) of chunks whose parent exists."""
    return chunks.select("chunk_id", "parent_id").join(chunks.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_semi").select("chunk_id", "parent_id")


def children(chunks: DataFrame) -> DataFrame:
    """(parent_id, chunk_id, position) in the order of child_ids; ids without a chunk are left out."""
    listed = chunks.select(F.col("chunk_id").alias("parent_id"), F.posexplode("child_ids").alias("position", "chunk_id"))
    return listed.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("parent_id", "chunk_id", "position")


def siblings(chunks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(chunk_id, sibling_id): other chunks of the same parent; none without a parent. ``ids`` names the chunks asked for,
    which keeps the result as small as the question."""
    base = chunks.where("parent_id IS NOT NULL").select("chunk_id", "parent_id")
    asked = base if ids is None else base.join(ids.select("chunk_id"), "chunk_id", "left_semi")
    other = base.select(F.col("chunk_id").alias("sibling_id"), "parent_id")
    return asked.join(other, "parent_id").where("chunk_id <> sibling_id").select("chunk_id", "sibling_id")


def sibling_counts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, siblings): how many other chunks have the same parent. Counted first, so a hot parent is one row."""
    n = chunks.where("parent_id IS NOT NULL").groupBy("parent_id").agg((F.count("*") - 1).alias("siblings"))
    return chunks.select("chunk_id", "parent_id").join(n, "parent_id").select("chunk_id", "siblings")


def ordered_links(rows: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """(key, prev_id, next_id): the rows before and after within a group, in order; keys must be unique.

    Rows are sorted over ranges, so a group of any size is spread over tasks; the ends of the ranges, one row a range,
    are handed to their neighbours."""
    by = [*group, *order, *([key] if key not in order else [])]
    thin = cut_lineage(rows.select(*dict.fromkeys(by)))  # ranges are found by a pass of its own, which shall not make the rows again
    sorted_rows = thin.repartitionByRange(*by).sortWithinPartitions(*by)
    parts = cut_lineage(sorted_rows.withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part", *group).orderBy(*[F.asc(c) for c in by])
    ends = parts.groupBy("__part").agg(*[f(F.struct(*by)).alias(n) for n, f in (("first", F.min), ("last", F.max))]).orderBy("__part").collect()  # one row a range
    same = [(x, y) for x, y in zip(ends, ends[1:], strict=False) if all(x["last"][g] == y["first"][g] for g in group)]
    schema = rows.select(F.col(key).alias("__at"), F.col(key).alias("__other")).schema
    spark = rows.sparkSession
    before = F.broadcast(spark.createDataFrame([(y["first"][key], x["last"][key]) for x, y in same], schema).select(F.col("__at").alias(key), F.col("__other").alias("__before")))
    after = F.broadcast(spark.createDataFrame([(x["last"][key], y["first"][key]) for x, y in same], schema).select(F.col("__at").alias(key), F.col("__other").alias("__after")))
    out = parts.select(key, F.lag(key).over(w).alias("prev_id"), F.lead(key).over(w).alias("next_id")).join(before, key, "left").join(after, key, "left")
    return out.select(key, F.coalesce("prev_id", "__before").alias("prev_id"), F.coalesce("next_id", "__after").alias("next_id"))


def links(chunks: DataFrame, order: str = "sequence_position") -> DataFrame:
    """``chunks`` (unique chunk_ids) with prev_id and next_id within a document and level, in order."""
    return chunks.drop("prev_id", "next_id").join(ordered_links(chunks, ["document_id", "level"], [order, "chunk_id"], "chunk_id"), "chunk_id")


def positions(chunks: DataFrame, order: str) -> DataFrame:
    """0-based sequence_position in a document."""
    return chunks.withColumn("sequence_position", F.row_number().over(Window.partitionBy("document_id").orderBy(order, "chunk_id")) - 1)


def context_window(chunks: DataFrame, ids: DataFrame, k: int = 1) -> DataFrame:
    """(chunk_id, offset, neighbour_id): up to k chunks before and after along prev_id and next_id; 0 is the chunk itself.

    k joins in each direction, each of the size of ``ids``; a missing link ends its direction."""
    step = chunks.select("chunk_id", "prev_id", "next_id")
    out = start = ids.select("chunk_id").join(step.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.lit(0).alias("offset"), F.col("chunk_id").alias("neighbour_id"))
    for sign, link in ((-1, "prev_id"), (1, "next_id")):
        at = start
        for i in range(1, k + 1):
            hop = step.select(F.col("chunk_id").alias("neighbour_id"), F.col(link).alias("to"))
            at = at.join(hop, "neighbour_id").where("to IS NOT NULL").select("chunk_id", F.lit(sign * i).alias("offset"), F.col("to").alias("neighbour_id"))
            at = at.join(step.select(F.col("chunk_id").alias("neighbour_id")), "neighbour_id", "left_semi").select("chunk_id", "offset", "neighbour_id")
            out = out.unionByName(at)
    return out


def related(edges: DataFrame, types: Sequence[str] = ("relates_to",), reverse: bool = False) -> DataFrame:
    """(concept_id, related_id, type): one hop along edges of the given types, or against them."""
    e = edges.where(F.col("type").isin(*types))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return e.select(F.col(a).alias("concept_id"), F.col(b).alias("related_id"), "type").distinct()


def related_both(edges: DataFrame, types: Sequence[str] = ("relates_to",)) -> DataFrame:
    """Forward and reverse neighbours, each once; forward wins."""
    both = related(edges, types).withColumn("way", F.lit(0)).unionByName(related(edges, types, True).withColumn("way", F.lit(1)))
    return both.groupBy("concept_id", "related_id").agg(F.min("way").alias("way"))


def degree(edges: DataFrame, types: Sequence[str] = EDGE_TYPES) -> DataFrame:
    """Outgoing typed edges of each concept."""
    return edges.where(F.col("type").isin(*types)).groupBy(F.col("src").alias("concept_id")).agg(F.count("*").alias("connections"))


def rank_concepts(concepts: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """The k concepts with most outgoing edges, ties by id; concepts without edges have 0."""
    d = concepts.join(degree(edges), "concept_id", "left").withColumn("connections", F.coalesce("connections", F.lit(0).cast("long")))
    return d.orderBy(F.desc("connections"), "concept_id").limit(k)


def prerequisites(edges: DataFrame) -> DataFrame:
    """(concept_id, requires): sorted targets of requires and calculated_from edges."""
    e = edges.where(F.col("type").isin("requires", "calculated_from"))
    return e.groupBy(F.col("src").alias("concept_id")).agg(F.sort_array(F.collect_set("dst")).alias("requires"))


def cooccurrence(membership: DataFrame, item: str, group: str, least: int = 1) -> DataFrame:
    """(item_1, item_2, n): how many groups two items share, first < second. Pairs are made within a group's distinct
    items, which are few (documents of a concept)."""
    m = membership.select(item, group).distinct()
    a, b = m.select(F.col(item).alias("item_1"), group), m.select(F.col(item).alias("item_2"), group)
    return a.join(b, group).where("item_1 < item_2").groupBy("item_1", "item_2").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def hierarchy(summaries: DataFrame) -> DataFrame:
    """(summary_id, depth, root_id) by parent_summary_id; a missing parent makes a root. Depth is at most two below it."""
    s = summaries.select("summary_id", "parent_summary_id")
    known = s.select(F.col("summary_id").alias("parent_summary_id"), F.col("parent_summary_id").alias("grand"))
    one = s.join(known.withColumn("known", F.lit(True)), "parent_summary_id", "left")
    top = s.select(F.col("summary_id").alias("grand")).withColumn("grand_known", F.lit(True))
    two = one.join(top, "grand", "left")
    depth = F.when(F.col("known").isNull(), 0).when(F.col("grand_known").isNull(), 1).otherwise(2)
    root = F.when(depth == 0, F.col("summary_id")).when(depth == 1, F.col("parent_summary_id")).otherwise(F.col("grand"))
    return two.select("summary_id", depth.alias("depth"), root.alias("root_id"))


SPAN = 64  # lines in a block


def section_of_line(sections: DataFrame, lines: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, line_no, section_no): the section whose line range has the line; the deepest, then the last, of several.

    ``strict`` uses each section's own range; otherwise a line that no range has belongs to the nearest section before."""
    s = sections.select("doc_id", "section_no", "level", "start_line", "end_line")
    if not strict:
        best = F.max_by("section_no", F.struct("start_line", "section_no"))
        return lines.join(s, "doc_id").where("line_no >= start_line").groupBy("doc_id", "line_no").agg(best.alias("section_no"))
    # ranges and lines meet in blocks of lines, so that a long document is no single group
    block = lambda c: F.floor(F.col(c) / SPAN)
    s = s.where("end_line >= start_line").withColumn("__b", F.explode(F.sequence(block("start_line"), block("end_line"))))
    inside = F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    best = F.max_by("section_no", F.struct("level", "start_line", "section_no"))
    return lines.withColumn("__b", block("line_no")).join(s, ["doc_id", "__b"]).where(inside).groupBy("doc_id", "line_no").agg(best.alias("section_no"))


def dot_rows(edges: DataFrame) -> DataFrame:
    """Distinct DOT edge lines."""
    from foliant.functions.text import graph_id

    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', graph_id("src"), graph_id("dst"), F.col("type")).alias("line")).distinct()
