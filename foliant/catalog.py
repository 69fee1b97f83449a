"""All queries over the reference's operators, and their SQL.

Each entry applies one operator to its whole tables; the SQL states the same result for another engine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import latest, read_table
from foliant.functions import display, extract, records
from foliant.functions import text as tx
from foliant.functions.vectors import cosine, offline_embedding
from foliant.operators import chunker, concepts, distill, graph, profiles, quality, search, store
from foliant.plans import api, property_graph
from foliant.plans import ingest as stored
from foliant.plans import tables as t
from foliant.plans.tables import sql
from foliant.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DOCUMENT, KEYWORD, PHRASE, TAG = "customer_methods_b1000027", "Inventory", "inventory count audit report", "inventory"
DIM = 384
PROBE = [((i * 37) % 101 - 50) / 50.0 for i in range(DIM)]  # a fixed query vector


def query(name: str, views: str = "", body: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(views, body)
        return f

    return put


# --- scans, filters, point look-ups -------------------------------------------------------------------------------


@query("list_documents", "", f"SELECT doc_id, document_id, title FROM documents WHERE list_contains(coalesce(from_json(CASE WHEN json_valid(tags) THEN tags END, '[\"VARCHAR\"]'), []), '{TAG}')")
def list_documents(s, d):
    return search.with_all_tags(t.documents(s, d), [TAG]).select("doc_id", "document_id", "title")


@query("documents_by_title", "", "SELECT doc_id, title, created_at FROM documents ORDER BY title NULLS FIRST, doc_id")
def documents_by_title(s, d):
    return read_table(s, d, "documents").select("doc_id", "title", "created_at").orderBy(F.asc_nulls_first("title"), "doc_id")


@query("document_chunks", "cur meta des", "SELECT document_id, chunk_id, sequence_position, token_count FROM des WHERE level = 2")
def document_chunks(s, d):
    return t.described(s, d).where(search.chunk_filter(level=2)).select("document_id", "chunk_id", "sequence_position", "token_count")


@query("chunk_filters", "cur meta des", "SELECT chunk_id, document_id FROM des WHERE level = 2 AND semantic_type = 'definition' AND coalesce(has_table, false) = false")
def chunk_filters(s, d):
    return t.described(s, d).where(search.chunk_filter(level=2, semantic_type="definition", has_table=False)).select("chunk_id", "document_id")


@query("chunks_by_topic", "cur meta des", "SELECT chunk_id FROM des WHERE len(list_filter(topic_tags, lambda x: lower(x) = 'inventory')) > 0")
def chunks_by_topic(s, d):
    return t.described(s, d).where(F.exists("topic_tags", lambda x: F.lower(x) == TAG)).select("chunk_id")


@query("keyword_search", "cur", f"SELECT chunk_id, level FROM cur WHERE contains(lower(content), lower('{KEYWORD}'))")
def keyword_search(s, d):
    return search.search_keyword(t.chunks(s, d), KEYWORD).select("chunk_id", "level")


@query("keyword_search_cased", "cur", "SELECT chunk_id, level FROM cur WHERE contains(content, 'Stores')")
def keyword_search_cased(s, d):
    return search.search_keyword(t.chunks(s, d), "Stores", True).select("chunk_id", "level")


@query("embedding_dimensions", "vec", "SELECT len(embedding)::INT AS dim, count(*) AS n FROM vec GROUP BY 1")
def embedding_dimensions(s, d):
    return t.vectors(s, d).groupBy(F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim")).agg(F.count("*").alias("n"))


# --- scalars -------------------------------------------------------------------------------------------------------


@query("token_estimates", "", "SELECT doc_id, (CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::INT AS tokens, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::INT AS words FROM documents")
def token_estimates(s, d):
    return read_table(s, d, "documents").select("doc_id", tx.estimate_tokens("text").alias("tokens"), tx.word_count("text").cast("int").alias("words"))


def _rx(patterns: list[str], flags: str) -> str:
    f = flags.replace("d", "")
    return " OR ".join(f"regexp_matches(c, '(?{f}){p.replace(chr(39), chr(39) * 2)}')" for p in patterns)


_STEPS = " + ".join(f"regexp_matches(c, '(?im){p}')::INT" for p in tx.PROCEDURE)
_TYPE = (
    f"CASE WHEN {_rx(tx.THEOREM, 'im')} THEN 'theorem' WHEN {_rx(tx.DEFINITION, 'im')} THEN 'definition' WHEN {_rx(tx.COMMAND, 'm')} THEN 'cli_command' "
    f"WHEN {_rx(tx.CODE, 'm')} THEN 'code_example' WHEN {_rx(tx.EXAMPLE, 'im')} THEN 'example' WHEN {_STEPS} >= 2 THEN 'procedure' ELSE 'narrative' END"
)


@query("semantic_types", "cur", f"SELECT chunk_id, {_TYPE} AS semantic_type FROM (SELECT chunk_id, coalesce(content, '') AS c FROM cur)")
def semantic_types(s, d):
    return t.chunks(s, d).select("chunk_id", tx.semantic_type("content").alias("semantic_type"))


@query("content_flags", "cur", "SELECT chunk_id, " + ", ".join(f"regexp_matches(coalesce(content, ''), '{p}') AS {k}" for k, p in tx.FLAGS.items()) + " FROM cur")
def content_flags(s, d):
    return t.chunks(s, d).select("chunk_id", *[c.alias(k) for k, c in tx.content_flags("content").items()])


@query("header_info", "cur", "SELECT chunk_id, trim(regexp_extract(l, '^(#{1,6})\\s+(.+)$', 2)) AS header_text, length(regexp_extract(l, '^(#{1,6})\\s+(.+)$', 1))::INT AS header_level FROM (SELECT chunk_id, split_part(content, chr(10), 1) AS l FROM cur) WHERE regexp_matches(l, '^(#{1,6})\\s+(.+)$')")
def header_info(s, d):
    h = tx.header_info("content")
    return t.chunks(s, d).select("chunk_id", h["header_text"].alias("header_text"), h["header_level"].cast("int").alias("header_level")).where("header_level IS NOT NULL")


@query("topic_tags")
def topic_tags(s, d):
    return t.chunks(s, d).select("chunk_id", tx.topic_tags("content").alias("tags"))


@query("slugs", "", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\\w\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '-') AS slug, coalesce(nullif(trim(regexp_replace(regexp_replace(title, '[^\\w\\-]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'document') AS file_name FROM documents WHERE title IS NOT NULL")
def slugs(s, d):
    return read_table(s, d, "documents").where("title IS NOT NULL").select("doc_id", tx.slug("title").alias("slug"), tx.file_slug("title").alias("file_name"))


@query("lead_summaries", "", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:3], ' ') AS summary FROM documents")
def lead_summaries(s, d):
    return read_table(s, d, "documents").select("doc_id", tx.lead("text", 3).alias("summary"))


@query("offline_embeddings")
def offline_embeddings(s, d):
    v = offline_embedding(F.col("text"), 16)
    return read_table(s, d, "documents").select("doc_id", v.alias("embedding"))


# --- quality -------------------------------------------------------------------------------------------------------

_M = (
    "SELECT *, words::DOUBLE / pages AS words_per_page, words::DOUBLE / lines AS words_per_line FROM (SELECT doc_id, len(regexp_extract_all(c, '\\S+'))::INT AS words, len(string_split(c, chr(10)))::INT AS lines, "
    "greatest(1, len(regexp_extract_all(c, '\\S+')) // 300)::INT AS pages, len(regexp_extract_all(c, '(?m)^#{1,6}\\s+.+$'))::INT AS headings, length(c) AS chars, length(regexp_replace(c, '[\\p{L}\\p{M}\\p{N}\\p{Pc}\\p{Z}\\s]', '', 'g')) AS special, "
    "len(list_filter(string_split(c, chr(10)), lambda x: trim(x, ' \t\r') = ''))::INT AS blank FROM (SELECT doc_id, coalesce(text, '') AS c FROM documents))"
)


@query("quality_metrics", "", f"SELECT doc_id, words AS word_count, lines AS line_count, pages AS estimated_pages, headings AS heading_count, CASE WHEN chars = 0 THEN 0.0 ELSE special::DOUBLE / chars END AS special_char_ratio, blank::DOUBLE / lines AS empty_line_ratio, words_per_page, words_per_line FROM ({_M})")
def quality_metrics(s, d):
    m = quality.metrics("text")
    keep = ("word_count", "line_count", "estimated_pages", "heading_count", "special_char_ratio", "empty_line_ratio", "words_per_page", "words_per_line")
    return read_table(s, d, "documents").select("doc_id", *[m[k].alias(k) for k in keep])


@query("quality_reports")
def quality_reports(s, d):
    return quality.reports(read_table(s, d, "documents").select("doc_id", "text")).select("doc_id", "score", "status", F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["severity"])).alias("issues"))


@query(
    "stored_report_scores", "",
    "SELECT document_id, checked_at, (100 - (CASE WHEN words_per_page < 50 THEN 30 WHEN words_per_page < 100 THEN 15 ELSE 0 END) - (CASE WHEN special_char_ratio > 0.2 THEN 25 WHEN special_char_ratio > 0.1 THEN 12 ELSE 0 END) "
    "- (CASE WHEN empty_line_ratio > 0.7 THEN 10 WHEN empty_line_ratio > 0.55 THEN 5 ELSE 0 END) - (CASE WHEN words_per_line > 500 THEN 30 WHEN words_per_line > 200 THEN 15 ELSE 0 END) "
    "- (CASE WHEN word_count >= 5000 AND heading_count <= 0 THEN 20 WHEN word_count >= 5000 AND heading_count < 1 THEN 10 ELSE 0 END) - (CASE WHEN broken_table_count >= 3 THEN 15 WHEN broken_table_count >= 1 THEN 7 ELSE 0 END) "
    "- (CASE WHEN ocr_confidence_avg < 0.6 THEN 20 WHEN ocr_confidence_avg < 0.8 THEN 10 ELSE 0 END))::INT AS score FROM quality_metrics",
)
def stored_report_scores(s, d):
    return read_table(s, d, "quality_metrics").select("document_id", "checked_at", quality.score().cast("int").alias("score"))


@query("quality_status_counts", "", "SELECT status, count(*) AS n FROM (SELECT * FROM quality_metrics QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY checked_at DESC) = 1) GROUP BY 1")
def quality_status_counts(s, d):
    q = read_table(s, d, "quality_metrics").groupBy("document_id").agg(F.max_by("status", "checked_at").alias("status"))
    return q.groupBy("status").agg(F.count("*").alias("n"))


@query("content_stats", "", "SELECT section_no, doc_id, length(c)::INT AS characters, len(regexp_extract_all(c, '\\S+'))::INT AS words, len(string_split(c, chr(10)))::INT AS lines, len(regexp_extract_all(c, '(?m)^#{1,6}\\s'))::INT AS headings, ((length(c) - length(replace(c, '|---', ''))) // 4)::INT AS tables, (((length(c) - length(replace(c, '```', ''))) // 3) // 2)::INT AS code_blocks FROM (SELECT doc_id, section_no, coalesce(content, '') AS c FROM sections QUALIFY row_number() OVER (PARTITION BY doc_id, section_no ORDER BY parsed_at DESC) = 1)")
def content_stats(s, d):
    cs = quality.content_stats("content")
    cur = t.latest(read_table(s, d, "sections"), ["doc_id", "section_no"], "parsed_at")
    return cur.select("section_no", "doc_id", *[cs[k].alias(k) for k in ("characters", "words", "lines", "headings", "tables", "code_blocks")])


@query("chunk_quality", "cur meta des", "SELECT document_id, count(*) AS chunk_count, count(*) FILTER (w = 0) AS empty_chunks, count(*) FILTER (w > 0 AND w < 10) AS small_chunks, avg(w) AS avg_chunk_words FROM (SELECT document_id, len(regexp_extract_all(coalesce(content, ''), '\\S+')) AS w FROM des) GROUP BY 1")
def chunk_quality(s, d):
    return quality.chunk_quality(t.described(s, d)).select("document_id", "chunk_count", "empty_chunks", "small_chunks", "avg_chunk_words")


# --- generators ----------------------------------------------------------------------------------------------------


@query("markdown_chunks")
def markdown_chunks(s, d):
    return chunker.document_chunks(read_table(s, d, "documents")).select("document_id", "chunk_id", "level", "token_count", "parent_id", "prev_id", "next_id", "section_path", "sequence_position")


@query("markdown_sections", "", "SELECT document_id, count(*) AS headings FROM (SELECT document_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_full_match(line, '(#{1,6})\\s+(.+)') GROUP BY 1")
def markdown_sections(s, d):
    return chunker.document_sections(read_table(s, d, "documents")).where("section_no > 0").groupBy("document_id").agg(F.count("*").alias("headings"))


@query("special_blocks")
def special_blocks(s, d):
    return chunker.document_blocks(read_table(s, d, "documents")).select("document_id", "block_no", "block_type", "start_line", "end_line")


@query("image_links", "", "SELECT doc_id, unnest(regexp_extract_all(text || chr(10) || '![' || coalesce(title, '') || '](figures/' || document_id || '.png)', '!\\[.*?\\]\\((.+?)\\)', 1)) AS image FROM documents WHERE text IS NOT NULL")
def image_links(s, d):
    """Every text with a figure appended, since these texts have none of their own."""
    figure = F.concat(F.lit("\n!["), F.coalesce("title", F.lit("")), F.lit("](figures/"), "document_id", F.lit(".png)"))
    c = read_table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat("text", figure).alias("content"))
    return c.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(r"!\[.*?\]\((.+?)\)"), 1)).alias("image"))


@query("section_of_line", "", "WITH s AS (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY doc_id, section_no ORDER BY parsed_at DESC) = 1), l AS (SELECT DISTINCT doc_id, start_line + 1 AS line_no FROM s) SELECT l.doc_id, l.line_no, arg_max(s.section_no, {'a': s.level, 'b': s.start_line, 'c': s.section_no}) AS section_no FROM l JOIN s ON l.doc_id = s.doc_id AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY 1, 2")
def section_of_line(s, d):
    cur = t.latest(read_table(s, d, "sections"), ["doc_id", "section_no"], "parsed_at")
    return graph.section_of_line(cur, cur.select("doc_id", (F.col("start_line") + 1).alias("line_no")).distinct())


@query("central_summaries")
def central_summaries(s, d):
    return t.chunks(s, d).select("chunk_id", extract.summary_column("content", 3).alias("summary"))


@query("chunk_keywords")
def chunk_keywords(s, d):
    return t.chunks(s, d).select("chunk_id", F.transform(extract.keyword_column("content", 5), lambda k: k["keyword"]).alias("keywords"))


@query("extracted_concepts")
def extracted_concepts(s, d):
    m = extract.mentions(t.described(s, d).select("chunk_id", "sequence_position", "content"))
    return m.groupBy("concept_id").agg(F.min_by("name", F.struct("ord", "name")).alias("name"), F.count("*").alias("mentions"))


@query("rolled_up_summaries", "cur meta des", "SELECT level, count(*) AS n FROM (SELECT 'section' AS level FROM des WHERE level = 2 AND content IS NOT NULL UNION ALL SELECT 'chapter' FROM (SELECT DISTINCT parent_id, document_id FROM des WHERE level = 2 AND content IS NOT NULL AND parent_id IS NOT NULL) UNION ALL SELECT 'document' FROM (SELECT DISTINCT document_id FROM des WHERE level = 2 AND content IS NOT NULL)) GROUP BY 1")
def rolled_up_summaries(s, d):
    return api.summarize(t.described(s, d)).groupBy("level").agg(F.count("*").alias("n"))


_SHORT = "SELECT document_id, source_id, w, row_number() OVER (PARTITION BY document_id ORDER BY w, source_id) AS r, count(*) OVER (PARTITION BY document_id) AS n FROM have"


@query(
    "repaired_chapters", "cur meta des vec",
    "SELECT chunk_id AS source_id, 'missing' AS reason FROM des WHERE document_id IS NOT NULL AND chunk_id NOT IN (SELECT source_id FROM (SELECT chunk_id AS source_id FROM des WHERE document_id IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM vec))) "
    "UNION ALL SELECT h.source_id, 'truncated' FROM (SELECT document_id, chunk_id AS source_id, coalesce(word_count, 0) AS w FROM des WHERE document_id IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM vec)) h JOIN "
    "(SELECT document_id, w AS median FROM (" + _SHORT.replace("have", "(SELECT document_id, chunk_id AS source_id, coalesce(word_count, 0) AS w FROM des WHERE document_id IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM vec))") + ") WHERE r = n // 2 + 1) m USING (document_id) WHERE h.w < least(m.median * 0.2, 20.0)",
)
def repaired_chapters(s, d):
    """All chunks are sections; those that have a vector stand for summaries, so the others' are missing."""
    c = t.described(s, d).where("document_id IS NOT NULL").select(F.col("chunk_id").alias("source_id"), "document_id", F.coalesce("word_count", F.lit(0)).alias("word_count"))
    return store.repair_set(c, c.join(t.vectors(s, d).select(F.col("chunk_id").alias("source_id")), "source_id", "left_semi"))


@query("graph_hops", "summ", "SELECT summary_id AS origin, parent_summary_id AS summary_id FROM summ WHERE parent_summary_id IS NOT NULL")
def graph_hops(s, d):
    sm = t.summaries(s, d)
    e = sm.where("parent_summary_id IS NOT NULL").select(F.col("parent_summary_id").alias("src"), F.col("summary_id").alias("dst"), F.lit("has_child").alias("type"))
    g = property_graph.PropertyGraph({"summary": sm}, e)
    return g.run("summary_parent", sm.select(F.col("summary_id").alias("id"))).select("origin", "summary_id")


@query("invalid_chunks", "cur meta des", "SELECT chunk_id FROM des WHERE content IS NULL OR level IS NULL OR token_count IS NULL OR coalesce(semantic_type NOT IN ('definition', 'example', 'procedure', 'theorem', 'narrative', 'cli_command', 'code_example'), false)")
def invalid_chunks(s, d):
    return t.described(s, d).where(F.size(records.chunk_errors()) > 0).select("chunk_id")


_LISTS, _FLAGS, _NUMBERS = ("child_ids", "section_path", "topic_tags", "sibling_ids"), ("has_table", "has_code", "has_math", "has_list", "has_image"), ("level", "token_count", "word_count", "sequence_position", "header_level")
_TEXTS = ("chunk_id", "content", "parent_id", "prev_id", "next_id", "document_id", "semantic_type", "header_text", "block_type")


@query(
    "chunk_nodes", "cur meta des",
    "SELECT " + ", ".join([*[f"coalesce({c}, '') AS {c}" for c in _TEXTS], *[f"coalesce({c}, 0) AS {c}" for c in _NUMBERS], *[f"coalesce({c}, false)::INT AS {c}" for c in _FLAGS], *[f"CAST(to_json(coalesce({c}, [])) AS VARCHAR) AS {c}" for c in _LISTS]]) + " FROM des",
)
def chunk_nodes(s, d):
    return records.to_node(t.described(s, d).drop("ingested_at"))


# --- joins and sequences -------------------------------------------------------------------------------------------


@query("chunk_parents", "cur", "SELECT c.chunk_id, c.parent_id FROM cur c JOIN cur p ON c.parent_id = p.chunk_id")
def chunk_parents(s, d):
    return graph.parents(t.chunks(s, d))


@query("chunk_children", "cur", "SELECT x.parent_id, x.chunk_id, x.position FROM (SELECT chunk_id AS parent_id, unnest(child_ids) AS chunk_id, (generate_subscripts(child_ids, 1) - 1)::INT AS position FROM cur) x JOIN cur c ON x.chunk_id = c.chunk_id")
def chunk_children(s, d):
    return graph.children(t.chunks(s, d))


@query("chunk_siblings", "cur", "SELECT chunk_id, (count(*) OVER (PARTITION BY parent_id) - 1)::BIGINT AS siblings FROM cur WHERE parent_id IS NOT NULL")
def chunk_siblings(s, d):
    return graph.sibling_counts(t.chunks(s, d))


@query("context_windows", "cur", "SELECT chunk_id, 0 AS off, chunk_id AS neighbour_id FROM cur UNION ALL SELECT d.chunk_id, -1, p.chunk_id FROM cur d JOIN cur p ON d.prev_id = p.chunk_id UNION ALL SELECT d.chunk_id, 1, n.chunk_id FROM cur d JOIN cur n ON d.next_id = n.chunk_id")
def context_windows(s, d):
    c = t.chunks(s, d)
    return graph.context_window(c, c, 1).withColumnRenamed("offset", "off")


@query("chunk_links", "cur meta des", "SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM des WINDOW w AS (PARTITION BY document_id, level ORDER BY sequence_position, chunk_id)")
def chunk_links(s, d):
    return graph.ordered_links(t.described(s, d), ["document_id", "level"], ["sequence_position", "chunk_id"], "chunk_id")


@query("related_concepts", "edg", "SELECT DISTINCT src AS concept_id, dst AS related_id, type FROM edg WHERE type IN ('relates_to', 'component_of')")
def related_concepts(s, d):
    return graph.related(t.edges(s, d), ("relates_to", "component_of"))


@query("concept_dependents", "edg", "SELECT DISTINCT dst AS concept_id, src AS related_id, type FROM edg WHERE type = 'relates_to'")
def concept_dependents(s, d):
    return graph.related(t.edges(s, d), reverse=True)


@query("related_both_ways", "edg", "SELECT concept_id, related_id, min(way)::INT AS way FROM (SELECT src AS concept_id, dst AS related_id, 0 AS way FROM edg WHERE type = 'relates_to' UNION ALL SELECT dst, src, 1 FROM edg WHERE type = 'relates_to') GROUP BY 1, 2")
def related_both_ways(s, d):
    return graph.related_both(t.edges(s, d))


@query("chunks_without_vectors", "cur vec", "SELECT chunk_id FROM cur WHERE level = 2 AND chunk_id NOT IN (SELECT chunk_id FROM vec)")
def chunks_without_vectors(s, d):
    return t.chunks(s, d).where("level = 2").join(t.vectors(s, d).select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")


@query("vector_chunks", "cur meta des vec", "SELECT v.chunk_id, d.document_id, d.level FROM vec v JOIN des d ON v.chunk_id = d.chunk_id")
def vector_chunks(s, d):
    return t.vectors(s, d).select("chunk_id").join(t.described(s, d).select("chunk_id", "document_id", "level"), "chunk_id")


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("document_stats", "cur meta des", "SELECT document_id, count(*) AS total_chunks, count(*) FILTER (level = 0) AS level_0, count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2, coalesce(sum(token_count), 0)::BIGINT AS total_tokens FROM des WHERE document_id IS NOT NULL GROUP BY 1")
def document_stats(s, d):
    return store.document_stats(t.described(s, d))


@query("semantic_type_counts", "cur meta des", "SELECT document_id, coalesce(semantic_type, 'unknown') AS type, count(*) AS n FROM des WHERE document_id IS NOT NULL GROUP BY 1, 2")
def semantic_type_counts(s, d):
    return store.chunk_types(t.described(s, d)).select("document_id", F.explode("by_type").alias("x")).select("document_id", "x.type", "x.n")


@query("edge_duplicates", "", "SELECT sum(n)::BIGINT AS total, count(*) AS unique_edges, (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def edge_duplicates(s, d):
    return store.edge_duplicates(read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("dedup_edges", "", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def dedup_edges(s, d):
    return store.dedup_edges(read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("keep_newest", "", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_newest(s, d):
    o = read_table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return store.keep_newest(o, "o_custkey", "o_orderdate", [F.col("o_orderkey")])


@query("aggregated_concepts", "", "SELECT 'c' || l_partkey AS concept_id, count(*) AS occurrence_count, max(length(p_name || ' ' || l_shipmode_))::INT AS longest FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1")
def aggregated_concepts(s, d):
    li, p = read_table(s, d, "lineitem"), read_table(s, d, "part")
    m = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("concept_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("concept_type"),
        F.concat_ws(" ", "p_name", F.concat("l_returnflag", "l_linestatus")).alias("definition"), F.array("p_brand").alias("aliases"), F.col("l_orderkey").cast("string").alias("occurrence"),
    )
    return concepts.aggregate(m).select("concept_id", "occurrence_count", F.length("definition").alias("longest"))


@query("document_cooccurrence", "", "WITH m AS (SELECT DISTINCT l_suppkey AS item, l_orderkey AS grp FROM lineitem) SELECT a.item AS item_1, b.item AS item_2, count(*) AS n FROM m a JOIN m b ON a.grp = b.grp AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 3")
def document_cooccurrence(s, d):
    return graph.cooccurrence(read_table(s, d, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey", 3)


@query("inbox_status", "", "SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'absent') AS absent FROM events")
def inbox_status(s, d):
    return store.status_counts(read_table(s, d, "events"), "event_type", ("click", "view", "absent"))


@query("summarized_documents", "", "SELECT document_id, count(*) AS reports, coalesce(any_value(title), document_id) AS title FROM (SELECT q.document_id, d.title FROM quality_metrics q LEFT JOIN documents d ON q.document_id = d.document_id) GROUP BY 1")
def summarized_documents(s, d):
    q = read_table(s, d, "quality_metrics").groupBy("document_id").agg(F.count("*").alias("reports"))
    return q.join(read_table(s, d, "documents").select("document_id", "title"), "document_id", "left").select("document_id", "reports", F.coalesce("title", "document_id").alias("title"))


@query("unreported_documents", "", "SELECT document_id FROM documents WHERE document_id NOT IN (SELECT document_id FROM quality_metrics WHERE document_id IS NOT NULL)")
def unreported_documents(s, d):
    return read_table(s, d, "documents").select("document_id").join(read_table(s, d, "quality_metrics").select("document_id"), "document_id", "left_anti")


# --- top-k and ranking ---------------------------------------------------------------------------------------------

_P = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0"


@query("semantic_top_k", "vec", f"SELECT chunk_id, CASE WHEN list_dot_product(embedding, embedding) = 0 THEN 0.0 ELSE list_cosine_similarity(embedding, {_P}) END AS score FROM vec WHERE {_USABLE} ORDER BY score DESC, chunk_id LIMIT 10")
def semantic_top_k(s, d):
    """Every stored vector is scored in the scan; which row of a chunk counts is settled on the scores alone."""
    good = (F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    score = F.when(good, cosine(F.col("embedding"), F.array(*[F.lit(x) for x in PROBE]))).alias("score")
    scored = read_table(s, d, "vectors").select("chunk_id", "embedded_at", "model_name", score)
    return latest(scored, ["chunk_id"], "embedded_at", [F.col("model_name").asc_nulls_last()]).where("score IS NOT NULL").select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(10)


PROBES = [[((i * 37 + j * 11 + i * j % 13) % 101 - 50) / 50.0 for i in range(DIM)] for j in range(8)]  # a stated set of query vectors
_PS = ", ".join(f"({j}::BIGINT, {[*p]}::DOUBLE[])" for j, p in enumerate(PROBES))


@query("semantic_top_k_many", "vec", f"SELECT query, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.query, chunk_id, list_cosine_similarity(embedding, q.v) AS score FROM vec, (VALUES {_PS}) q(query, v) WHERE {_USABLE} AND list_dot_product(embedding, embedding) > 0)) WHERE rank <= 5")
def semantic_top_k_many(s, d):
    return search.search_many(t.vectors(s, d), np.array(PROBES), list(range(len(PROBES))), 5)


@query("diverse_results")
def diverse_results(s, d):
    rng = np.random.default_rng(11)
    v = t.vectors(s, d)
    top = search.search_many(v, rng.standard_normal((4, DIM)), list(range(4)), 50)
    return search.diversify(top.join(v.select("chunk_id", "embedding"), "chunk_id"), 5)


@query("bm25", "cur", "SELECT * FROM (SELECT chunk_id, sum(ln(1 + (dn - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av))) AS score FROM (SELECT w.chunk_id, w.n, q.term, len(list_filter(w.t, lambda x: x = q.term)) AS f, count(*) FILTER (list_contains(w.t, q.term)) OVER (PARTITION BY q.term) AS df, count(*) OVER (PARTITION BY q.term) AS dn, avg(w.n) OVER (PARTITION BY q.term) AS av FROM (SELECT chunk_id, t, len(t) AS n FROM (SELECT chunk_id, list_filter(regexp_split_to_array(lower(coalesce(content, '')), '\\W+'), lambda x: x <> '') AS t FROM cur)) w, (SELECT unnest(['audit', 'count', 'inventory', 'report']) AS term) q) WHERE f > 0 GROUP BY 1) ORDER BY score DESC, chunk_id LIMIT 100")
def bm25(s, d):
    return search.search_bm25(t.chunks(s, d), PHRASE, 100)


@query("concept_search", "con", "SELECT concept_id, score::INT AS score FROM (SELECT concept_id, (CASE WHEN lower(name) = 'brand#12' THEN 100 WHEN contains(lower(name), 'brand#12') THEN 50 ELSE 0 END) + (CASE WHEN lower(aliases[1]) = 'brand#12' THEN 80 WHEN contains(lower(aliases[1]), 'brand#12') THEN 40 ELSE 0 END) + (CASE WHEN contains(lower(definition), 'brand#12') THEN 20 ELSE 0 END) AS score FROM con) WHERE score > 0 ORDER BY score DESC, concept_id LIMIT 10")
def concept_search(s, d):
    return search.search_concepts(t.concepts(s, d), "Brand#12").select("concept_id", "score")


@query("ranked_concepts", "con edg", "SELECT concept_id, coalesce(n, 0) AS connections FROM con LEFT JOIN (SELECT src, count(*) AS n FROM edg GROUP BY 1) ON src = concept_id ORDER BY connections DESC, concept_id LIMIT 20")
def ranked_concepts(s, d):
    return graph.rank_concepts(t.concepts(s, d), t.edges(s, d), 20).select("concept_id", "connections")


@query("prerequisites", "edg", "SELECT src AS concept_id, array_to_string(list_sort(list_distinct(list(dst))), ',') AS requires FROM edg WHERE type IN ('requires', 'calculated_from') GROUP BY 1")
def prerequisites(s, d):
    return graph.prerequisites(t.edges(s, d)).select("concept_id", F.array_join("requires", ",").alias("requires"))


# --- concepts, graph and changes -----------------------------------------------------------------------------------


@query("resolved_names", "con", "SELECT wanted, min({'w': way, 'c': concept_id}).c AS concept_id FROM (SELECT name AS wanted, 1 AS way, concept_id FROM con UNION ALL SELECT a, 3, concept_id FROM (SELECT concept_id, aliases[1] AS a FROM con) WHERE a IS NOT NULL) GROUP BY 1")
def resolved_names(s, d):
    c = t.concepts(s, d)
    names = c.select(F.col("name").alias("wanted")).union(c.select(F.explode("aliases"))).distinct()
    return concepts.resolve(c, names)


@query("merged_concepts", "con", "SELECT name, min(concept_id) AS concept_id FROM con GROUP BY 1")
def merged_concepts(s, d):
    c = t.concepts(s, d).withColumn("source_documents", F.array(F.lit("a")))
    return concepts.merge_by_name(c, c.withColumn("source_documents", F.array(F.lit("b")))).select("name", "concept_id")


@query("garbage_concepts", "con", "SELECT concept_id FROM con WHERE len(regexp_extract_all(trim(concept_type), '\\S+')) < 4 UNION ALL SELECT 's' || s_suppkey FROM supplier")
def garbage_concepts(s, d):
    """Parts defined by their type alone, and suppliers without a definition."""
    few = t.concepts(s, d).select("concept_id", F.col("concept_type").alias("definition"))
    none = read_table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("concept_id"), F.lit(" ").alias("definition"))
    return few.unionByName(none).where(concepts.is_garbage(4)).select("concept_id")


@query("exported_concepts", "con", "SELECT concept_id, name, concept_type AS type, definition, array_to_string(aliases, '; ') AS aliases FROM con")
def exported_concepts(s, d):
    return concepts.export_rows(t.concepts(s, d))


@query("header_relations", "cur meta des", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY regexp_extract(chunk_id, '(\\d+)$', 1)::BIGINT, chunk_id) AS o FROM meta WHERE hierarchy_level IS NOT NULL) SELECT arg_max(p.chunk_id, p.o) AS src, c.chunk_id AS dst FROM r c JOIN r p ON c.document_id = p.document_id AND p.o < c.o AND p.hierarchy_level < c.hierarchy_level GROUP BY 2")
def header_relations(s, d):
    return concepts.header_relations(t.metadata(s, d).select("document_id", "chunk_id", F.col("chunk_id").alias("concept_id"), F.col("hierarchy_level").alias("header_level")).where("document_id IS NOT NULL"))


SQL["header_relations"] = SQL["header_relations"].replace(" WITH r AS", ", r AS").replace("WHERE hierarchy_level IS NOT NULL)", "WHERE hierarchy_level IS NOT NULL AND document_id IS NOT NULL)")


@query("summary_hierarchy", "summ", "SELECT summary_id, (CASE level WHEN 'document' THEN 0 WHEN 'chapter' THEN 1 ELSE 2 END)::INT AS depth, coalesce((SELECT p.parent_summary_id FROM summ p WHERE p.summary_id = s.parent_summary_id), s.parent_summary_id, s.summary_id) AS root_id FROM summ s")
def summary_hierarchy(s, d):
    return graph.hierarchy(t.summaries(s, d))


@query("graph_edges_dot", "edg", "SELECT DISTINCT '  \"' || lower(src) || '\" -> \"' || lower(dst) || '\" [label=\"' || type || '\"];' AS line FROM edg")
def graph_edges_dot(s, d):
    return graph.dot_rows(t.edges(s, d))


@query("deleted_document", "cur meta des", f"SELECT chunk_id, document_id FROM des WHERE coalesce(document_id <> '{DOCUMENT}', true)")
def deleted_document(s, d):
    return store.delete_document(t.documents(s, d), t.described(s, d), t.vectors(s, d), DOCUMENT)[1].select("chunk_id", "document_id")


@query("deleted_chunks", "cur meta des", "SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM des WHERE coalesce(token_count, 0) >= 50 WINDOW w AS (PARTITION BY document_id, level ORDER BY sequence_position, chunk_id)")
def deleted_chunks(s, d):
    c = t.described(s, d)
    return store.delete_chunks(c, c.where(F.coalesce("token_count", F.lit(0)) < 50)).select("chunk_id", "prev_id", "next_id")


@query("upserted_nations", "", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'NEW ' || n_name ELSE n_name END AS n_name FROM nation")
def upserted_nations(s, d):
    n = read_table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = n.where("n_regionkey = 1").withColumn("n_name", F.concat(F.lit("NEW "), "n_name"))
    return store.upsert(n, new, ["n_nationkey"]).select("n_nationkey", "n_name")


@query("event_windows", "", "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(s, d):
    """The streaming aggregate, run over the stored rows."""
    return ingest.windowed(read_table(s, d, "events")).select("window_start", "event_type", "n")


@query("event_sessions", "", "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k")
def event_sessions(s, d):
    return ingest.sessions(read_table(s, d, "events"))


# --- what tools show, ingest, profiles, distilled figures -----------------------------------------------------------


@query("chunk_records", "cur meta des", "SELECT chunk_id, document_id, level, coalesce(section_path, []) AS section_path, coalesce(topic_tags, []) AS topic_tags, coalesce(child_ids, []) AS child_ids, coalesce(has_table, false) AS has_table, coalesce(has_list, false) AS has_list FROM des")
def chunk_records(s, d):
    return display.chunk_record(t.described(s, d)).select("chunk_id", "document_id", "level", "section_path", "topic_tags", "child_ids", "has_table", "has_list")


@query("document_records", "cur meta des", "SELECT x.document_id AS doc_id, coalesce(title, '') AS title, coalesce(n, 0)::BIGINT AS chunk_count, created_at FROM (SELECT document_id, title, created_at FROM documents UNION ALL SELECT document_id, any_value(document_id), NULL FROM des WHERE document_id IS NOT NULL GROUP BY document_id) x LEFT JOIN (SELECT document_id, count(*) AS n FROM des GROUP BY 1) USING (document_id)")
def document_records(s, d):
    """Documents waiting for ingestion and books ingested earlier."""
    books = t.described(s, d).where("document_id IS NOT NULL").select("document_id").distinct().select("document_id", F.col("document_id").alias("title"))
    docs = t.documents(s, d).select("document_id", "title", "created_at", "tag_list").unionByName(books, allowMissingColumns=True)
    return display.document_record(docs, t.described(s, d)).drop("tags")


@query("concept_records", "con", "SELECT concept_id, name, concept_type, definition, aliases FROM con")
def concept_records(s, d):
    return display.concept_record(t.concepts(s, d))


@query("reranked_search", "vec cur", f"SELECT chunk_id, score, token_count FROM (SELECT v.chunk_id, list_cosine_similarity(v.embedding, {_P}) AS score, c.token_count FROM vec v JOIN cur c ON v.chunk_id = c.chunk_id WHERE {_USABLE.replace('embedding', 'v.embedding')} AND list_dot_product(v.embedding, v.embedding) > 0 ORDER BY score DESC, v.chunk_id LIMIT 30) ORDER BY token_count DESC NULLS LAST, score DESC, chunk_id LIMIT 10")
def reranked_search(s, d):
    """Three times as many chunks as asked for by cosine; of these the longest remain."""
    v = t.vectors(s, d).where((F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    lib = api.Library(t.documents(s, d), t.chunks(s, d), v)
    return lib.search_reranked(PROBE, F.col("token_count"), 10, threshold=None).select("chunk_id", "score", "token_count")


@query("unpaired_rows", "cur meta vec", "SELECT chunk_id, 'no metadata' AS problem FROM cur WHERE chunk_id NOT IN (SELECT chunk_id FROM meta) UNION ALL SELECT chunk_id, 'no vector' FROM cur WHERE level = 2 AND content IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM vec) UNION ALL SELECT chunk_id, 'metadata of no chunk' FROM meta WHERE chunk_id NOT IN (SELECT chunk_id FROM cur) UNION ALL SELECT chunk_id, 'vector of no chunk' FROM vec WHERE chunk_id NOT IN (SELECT chunk_id FROM cur)")
def unpaired_rows(s, d):
    return stored.unpaired({"documents": t.documents(s, d), "chunks": t.chunks(s, d), "chunk_metadata": t.metadata(s, d), "vectors": t.vectors(s, d)})


@query("ingested_documents")
def ingested_documents(s, d):
    """All four tables of every document, made from its text; one row a document with what was stored."""
    new = stored.ingest(read_table(s, d, "documents").select("document_id", "title", "text"), 16)
    leaves = new["vectors"].join(new["chunks"].select("chunk_id", "document_id"), "chunk_id").groupBy("document_id").agg(F.count("*").alias("vectors"))
    return new["documents"].join(leaves, "document_id", "left").select("document_id", "chunk_count", F.coalesce("vectors", F.lit(0)).alias("vectors"))


@query("restored_document", "cur meta des", f"SELECT count(*) AS chunks, count(*) FILTER (document_id = '{DOCUMENT}') AS own, count(DISTINCT document_id) AS documents FROM des WHERE document_id IS NULL OR document_id <> '{DOCUMENT}' OR level = 2")
def restored_document(s, d):
    """One book stored again with its leaves only: what it had before is replaced, the others stay."""
    c, v = t.described(s, d), t.vectors(s, d)
    books = c.where("document_id IS NOT NULL").select("document_id").distinct()
    again = c.where((F.col("document_id") == DOCUMENT) & (F.col("level") == 2))
    old = {"documents": books, "chunks": c, "chunk_metadata": t.metadata(s, d), "vectors": v}
    new = {"documents": books.where(F.col("document_id") == DOCUMENT), "chunks": again, "chunk_metadata": t.metadata(s, d).join(again, "chunk_id", "left_semi"), "vectors": v.join(again, "chunk_id", "left_semi")}
    out = stored.store_document(old, new)["chunks"]
    return out.agg(F.count("*").alias("chunks"), F.count_if(F.col("document_id") == DOCUMENT).alias("own"), F.countDistinct("document_id").alias("documents"))


_N = "(length(c) - length(replace(c, {0}, '')))::DOUBLE / {1}"


@query(
    "conversion_issues", "",
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN length(c) > 0 AND length(regexp_replace(c, '[\\p{L}\\p{M}\\p{N}\\p{Pc}\\p{Z}\\s]', '', 'g'))::DOUBLE / length(c) > 0.15 THEN 'special_characters' END, CASE WHEN len(regexp_extract_all(c, '\\S+')) < 1000 THEN 'short' END, "
    f"CASE WHEN {_N.format(repr('|---'), 4)} > 0 AND {_N.format(repr('|'), 1)} < 3 * {_N.format(repr('|---'), 4)} THEN 'broken_tables' END, CASE WHEN {_N.format('chr(10) || chr(10) || chr(10)', 3)} > 0.1 * len(string_split(c, chr(10))) THEN 'empty_lines' END], lambda x: x IS NOT NULL), ',') AS issues FROM (SELECT doc_id, coalesce(text, '') AS c FROM documents)",
)
def conversion_issues(s, d):
    return read_table(s, d, "documents").select("doc_id", F.concat_ws(",", quality.conversion_issues("text")).alias("issues"))


_KINDS = {x: x for x in profiles.ALL_TYPES} | {o: k for k, names in profiles.OTHER_NAMES.items() for o in names.split() if o not in profiles.ALL_TYPES}


@query("typed_tags", "meta", "SELECT DISTINCT tag, coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _KINDS.items()) + "}[regexp_replace(lower(trim(tag)), '[- ]', '_', 'g')], 'term') AS concept_type FROM (SELECT unnest(topic_tags) AS tag FROM meta)")
def typed_tags(s, d):
    return t.metadata(s, d).select(F.explode("topic_tags").alias("tag")).distinct().select("tag", profiles.concept_type("tag").alias("concept_type"))


@query("occurrence_edges", "cur meta", "SELECT DISTINCT chunk_id, tag AS concept_id FROM (SELECT chunk_id, unnest(topic_tags) AS tag FROM meta) WHERE chunk_id IN (SELECT chunk_id FROM cur)")
def occurrence_edges(s, d):
    """Tags as concepts that occur in the section summaries of the chunks that carry them."""
    m = t.metadata(s, d).select("chunk_id", F.explode("topic_tags").alias("concept_id"))
    return distill.occurrence_edges(m.select("concept_id", F.array(F.concat(F.lit("summary_"), "chunk_id", F.lit("_section")), F.lit("other")).alias("occurrences")), t.chunks(s, d))


@query("shared_concepts", "meta", "SELECT tag AS concept_id, count(DISTINCT document_id) AS documents, (15 + 5 * (count(DISTINCT document_id) - 1))::BIGINT AS size FROM (SELECT document_id, unnest(topic_tags) AS tag FROM meta WHERE document_id IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT document_id) >= 2")
def shared_concepts(s, d):
    return distill.shared_concepts(t.metadata(s, d).where("document_id IS NOT NULL").select(F.explode("topic_tags").alias("concept_id"), "document_id"))


@query(
    "specialist", "con edg",
    "SELECT 'stock-keeping_specialist' AS name, 'Specialist on ''Stock keeping'' with ' || (SELECT count(*) FROM con) || ' concepts in ' || (SELECT count(*) FROM nation) || ' chapters' AS description, "
    "(SELECT list(name ORDER BY n DESC, concept_id) FROM (SELECT c.name, c.concept_id, coalesce(e.n, 0) AS n FROM con c LEFT JOIN (SELECT src, count(*) AS n FROM edg GROUP BY 1) e ON c.concept_id = e.src ORDER BY n DESC, c.concept_id LIMIT 10)) AS expertise, "
    "(SELECT list(concept_type || ':' || n ORDER BY n DESC, concept_type) FROM (SELECT concept_type, count(*) AS n FROM con GROUP BY 1)) AS concept_types, (SELECT count(*) FROM con) AS total_concepts, (SELECT count(*) FROM nation) AS total_chapters",
)
def specialist(s, d):
    return distill.specialist(t.concepts(s, d), t.edges(s, d), read_table(s, d, "nation"), "Stock keeping")


# --- the stored graph queries ----------------------------------------------------------------------------------------

_ENDS = {"relates_to": ("customer", "u", "c_custkey", "n", "c_nationkey"), "component_of": ("supplier", "s", "s_suppkey", "n", "s_nationkey"), "uses": ("supplier", "s", "s_suppkey", "n", "s_nationkey"), "recorded_in": ("customer", "u", "c_custkey", "n", "c_nationkey"), "calculated_from": ("nation", "n", "n_nationkey", "r", "n_regionkey"), "supersedes": ("nation", "n", "n_nationkey", "r", "n_regionkey"), "requires": ("lineitem", "c", "l_partkey", "s", "l_suppkey")}
_HOPS = {k: v for k, v in property_graph.NAMED.items() if v[0] in ("in", "out") and v[2] != "sibling_of"}


def stored_graph(s: SparkSession, d: str) -> property_graph.PropertyGraph:
    """Books, chunks, vectors and tags, and the business tables as concepts and summaries, as one graph."""
    text = lambda c: F.col(c).cast("string")
    c, v, sm = t.described(s, d).where("document_id IS NOT NULL"), t.vectors(s, d), t.summaries(s, d)
    tags = c.select("chunk_id", F.explode("topic_tags").alias("concept_id"))
    names = {"part": ("c", "p_partkey"), "supplier": ("s", "s_suppkey"), "customer": ("u", "c_custkey"), "nation": ("n", "n_nationkey"), "region": ("r", "r_regionkey")}
    nodes = tags.select("concept_id").distinct()
    for table, (mark, key) in names.items():
        nodes = nodes.unionByName(read_table(s, d, table).select(F.concat(F.lit(mark), text(key)).alias("concept_id")))
    pairs = [
        ("has_chunk", c.select(F.col("document_id").alias("src"), F.col("chunk_id").alias("dst"))), ("parent_of", c.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"))),
        ("next_sibling", c.where("next_id IS NOT NULL").select(F.col("chunk_id").alias("src"), F.col("next_id").alias("dst"))), ("has_embedding", v.select(F.col("chunk_id").alias("src"), F.concat(F.lit("v"), "chunk_id").alias("dst"))),
        ("has_embedding", sm.select(F.col("summary_id").alias("src"), F.concat(F.lit("v"), "summary_id").alias("dst"))), ("defines_concept", tags.select(F.col("chunk_id").alias("src"), F.col("concept_id").alias("dst"))),
        ("mentions_concept", tags.select(F.col("chunk_id").alias("src"), F.col("concept_id").alias("dst"))), ("has_child", sm.where("parent_summary_id IS NOT NULL").select(F.col("parent_summary_id").alias("src"), F.col("summary_id").alias("dst"))),
        ("has_summary", sm.select(F.when(F.col("level") == "document", DOCUMENT).alias("src"), F.col("summary_id").alias("dst")).where("src IS NOT NULL")),
        *[(kind, read_table(s, d, table).select(F.concat(F.lit(a), text(x)).alias("src"), F.concat(F.lit(b), text(y)).alias("dst"))) for kind, (table, a, x, b, y) in _ENDS.items()],
    ]
    edges = None
    for kind, df in pairs:
        df = df.select("src", "dst", F.lit(kind).alias("type"))
        edges = df if edges is None else edges.unionByName(df)
    vectors = {"chunk_vector": v.select(F.concat(F.lit("v"), "chunk_id").alias("vector_id")), "summary_vector": sm.select(F.concat(F.lit("v"), "summary_id").alias("vector_id"))}
    return property_graph.PropertyGraph({"document": c.select("document_id").distinct(), "chunk": c, "concept": nodes, "summary": sm, **vectors}, edges)


_GRAPH = (
    "ch AS (SELECT * FROM des WHERE document_id IS NOT NULL), tg AS (SELECT chunk_id, unnest(topic_tags) AS tag FROM ch), k_document AS (SELECT DISTINCT document_id AS id FROM ch), k_chunk AS (SELECT chunk_id AS id FROM ch), "
    "k_concept AS (SELECT DISTINCT tag AS id FROM tg UNION ALL SELECT 'c' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'u' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region), "
    "k_summary AS (SELECT summary_id AS id FROM summ), k_chunk_vector AS (SELECT 'v' || chunk_id AS id FROM vec), k_summary_vector AS (SELECT 'v' || summary_id AS id FROM summ), "
    "e AS (SELECT document_id AS src, chunk_id AS dst, 'has_chunk' AS type FROM ch UNION ALL SELECT parent_id, chunk_id, 'parent_of' FROM ch WHERE parent_id IS NOT NULL UNION ALL SELECT chunk_id, next_id, 'next_sibling' FROM ch WHERE next_id IS NOT NULL "
    "UNION ALL SELECT chunk_id, 'v' || chunk_id, 'has_embedding' FROM vec UNION ALL SELECT summary_id, 'v' || summary_id, 'has_embedding' FROM summ UNION ALL SELECT chunk_id, tag, 'defines_concept' FROM tg UNION ALL SELECT chunk_id, tag, 'mentions_concept' FROM tg "
    f"UNION ALL SELECT parent_summary_id, summary_id, 'has_child' FROM summ WHERE parent_summary_id IS NOT NULL UNION ALL SELECT '{DOCUMENT}', summary_id, 'has_summary' FROM summ WHERE level = 'document' "
    + " ".join(f"UNION ALL SELECT '{a}' || {x}, '{b}' || {y}, '{kind}' FROM {table}" for kind, (table, a, x, b, y) in _ENDS.items())
    + ")"
)


def _hop_sql(name: str, way: str, start: str, edge: str, to: str) -> str:
    a, b = ("dst", "src") if way == "in" else ("src", "dst")
    return f"SELECT '{name}' AS query, count(DISTINCT o) AS origins, count(*) AS n FROM (SELECT DISTINCT {a} AS o, {b} AS x FROM e WHERE type = '{edge}') WHERE o IN (SELECT id FROM k_{start}) AND x IN (SELECT id FROM k_{to})"


@query("stored_hops", "cur meta des vec summ", "SELECT 1")
def stored_hops(s, d):
    """Every stored query that is a hop, from all nodes it can start at: how many have an answer, and the answers."""
    g, out = stored_graph(s, d), None
    for name, (_, start, *_rest) in _HOPS.items():
        found = g.run(name, g.nodes[start].select(F.col(g.keys[start]).alias("id"))).agg(F.lit(name).alias("query"), F.countDistinct("origin").alias("origins"), F.count("*").alias("n"))
        found = found.select("query", "origins", "n")
        out = found if out is None else out.unionByName(found)
    return out


SQL["stored_hops"] = sql("cur meta des vec summ", "SELECT * FROM (" + " UNION ALL ".join(_hop_sql(k, *v) for k, v in _HOPS.items()) + ")").replace(" SELECT * FROM (SELECT 'document_chunks'", ", " + _GRAPH + " SELECT * FROM (SELECT 'document_chunks'", 1)


@query("changed_graph", "cur meta des vec summ", "SELECT 1")
def changed_graph(s, d):
    """Edges by type after a book's chunks are dropped, other chunks lose their definitions and links are added."""
    g = stored_graph(s, d)
    own = g.nodes["chunk"].where(F.col("document_id") == DOCUMENT).select(F.col("chunk_id").alias("id"))
    top = g.nodes["chunk"].where("level = 1").select(F.col("chunk_id").alias("id"))
    added = g.nodes["summary"].where("level = 'chapter'").select(F.lit(DOCUMENT).alias("src"), F.col("summary_id").alias("dst"))
    return g.drop("chunk", own).unlink(top, "defines_concept").link(added, "has_summary").edges.groupBy("type").agg(F.count("*").alias("n"))


SQL["changed_graph"] = sql("cur meta des vec summ", "").rstrip() + ", " + _GRAPH + (
    f", own AS (SELECT chunk_id FROM ch WHERE document_id = '{DOCUMENT}'), kept AS (SELECT type FROM e WHERE src NOT IN (SELECT chunk_id FROM own) AND dst NOT IN (SELECT chunk_id FROM own) AND NOT (type = 'defines_concept' AND src IN (SELECT chunk_id FROM ch WHERE level = 1)) "
    "UNION ALL SELECT 'has_summary' FROM summ WHERE level = 'chapter') SELECT type, count(*) AS n FROM kept GROUP BY 1"
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
