import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.common import latest
from foliant.functions.vectors import cosine, offline_embedding
from foliant.operators import chunker, concepts, graph, quality, search, store
from foliant.plans.api import Library, summarize


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("d_l1_1", "Chapter one. It is long.", 1, 6, None, ["d_l2_1", "d_l2_2", "gone"], None, None, "d", "narrative", 0, False),
        ("d_l2_1", "Stock is defined as goods.", 2, 6, "d_l1_1", [], None, "d_l2_2", "d", "definition", 1, True),
        ("d_l2_2", "For example, boxes. ![p](a.png)", 2, 7, "d_l1_1", [], "d_l2_1", "d_l2_3", "d", "example", 2, False),
        ("d_l2_3", None, 2, None, None, [], "d_l2_2", "lost", "d", None, 3, None),
        ("e_l2_1", "stock, stock and more STOCK", 2, 6, None, [], None, None, "e", "narrative", 0, None),
    ]
    return spark.createDataFrame(rows, "chunk_id string, content string, level int, token_count int, parent_id string, child_ids array<string>, prev_id string, next_id string, document_id string, semantic_type string, sequence_position int, has_table boolean")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_breaks_ties_alike(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 1, t), ("a", 2, t + dt.timedelta(1)), ("b", 1, None), ("b", 2, t), (None, 9, t)]
    df = spark.createDataFrame(rows, "k string, v int, ts timestamp")
    assert pairs(latest(df, ["k"], "ts").select("k", "v")) == [("a", 2), ("b", 2)]
    assert latest(df.limit(0), ["k"], "ts").count() == 0


def test_hierarchy_hops(chunks):
    assert pairs(graph.parents(chunks)) == [("d_l2_1", "d_l1_1"), ("d_l2_2", "d_l1_1")]
    assert pairs(graph.children(chunks)) == [("d_l1_1", "d_l2_1", 0), ("d_l1_1", "d_l2_2", 1)]
    assert pairs(graph.siblings(chunks)) == [("d_l2_1", "d_l2_2"), ("d_l2_2", "d_l2_1")]


def test_context_window_stops_at_missing_links(chunks):
    got = pairs(graph.context_window(chunks, chunks.where("chunk_id = 'd_l2_2'"), 2))
    assert got == [("d_l2_2", -1, "d_l2_1"), ("d_l2_2", 0, "d_l2_2"), ("d_l2_2", 1, "d_l2_3")]


def test_deleting_chunks_mends_links(chunks):
    got = {r.chunk_id: (r.prev_id, r.next_id, r.child_ids) for r in store.delete_chunks(chunks, chunks.where("chunk_id = 'd_l2_2'")).collect()}
    assert got["d_l2_1"][1] == "d_l2_3" and got["d_l2_3"][0] == "d_l2_1" and got["d_l1_1"][2] == ["d_l2_1", "gone"]


def test_keyword_and_bm25(chunks):
    assert pairs(search.search_keyword(chunks, "STOCK").select("chunk_id")) == [("d_l2_1",), ("e_l2_1",)]
    got = search.search_bm25(chunks, "stock").collect()
    assert [r.chunk_id for r in got] == ["e_l2_1", "d_l2_1"]
    n, avg = 5, (5 + 5 + 6 + 0 + 5) / 5
    f, length = 3, 5
    assert got[0].score == pytest.approx(math.log(1 + (n - 2 + 0.5) / 2.5) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg)), rel=1e-9)


def test_cosine_of_zero_null_and_unequal(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]


def test_top_k_agrees_for_one_and_many(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)] + [(90, None), (91, [0.0] * 8), (92, [1.0])], "chunk_id long, embedding array<double>")
    q = rng.standard_normal((3, 8))
    many = search.search_many(df, q, [0, 1, 2], 4).collect()
    for j in range(3):
        one = [r.chunk_id for r in search.search_similar(df, q[j], 4, None).collect()]
        brute = np.argsort(-(x @ q[j]) / np.linalg.norm(x, axis=1))[:4].tolist()
        assert one == brute == [r.chunk_id for r in sorted((r for r in many if r["query"] == j), key=lambda r: r["rank"])]


def test_diversity_avoids_copies(spark):
    df = spark.createDataFrame([("q", "a", 0.9, [1.0, 0.0]), ("q", "b", 0.89, [1.0, 0.01]), ("q", "c", 0.5, [0.0, 1.0])], "query string, chunk_id string, score double, embedding array<double>")
    assert [r.chunk_id for r in search.diversify(df, 2).orderBy("rank").collect()] == ["a", "c"]


def test_offline_embedding_is_unit_and_stable(spark):
    v = spark.createDataFrame([("x",), ("x",), (" ",), (None,)], "t string").select(offline_embedding(F.col("t"), 8)).collect()
    assert v[0] == v[1] and sum(a * a for a in v[0][0]) == pytest.approx(1) and set(v[2][0]) == set(v[3][0]) == {0.0}


def test_concepts(spark):
    c = spark.createDataFrame([("fifo", "FIFO", "method", "first in first out", ["First-In"], ["a"]), ("cost-of-goods", "Cost of Goods", "term", "", ["COGS"], ["a"]), ("lifo", "LIFO", "method", None, None, None)], "concept_id string, name string, concept_type string, definition string, aliases array<string>, source_documents array<string>")
    names = spark.createDataFrame([("FIFO",), ("cogs",), ("Cost Of goods",), ("none",)], "wanted string")
    assert pairs(concepts.resolve(c, names)) == [("Cost Of goods", "cost-of-goods"), ("FIFO", "fifo"), ("cogs", "cost-of-goods")]
    assert pairs(c.where(concepts.is_garbage(3)).select("concept_id")) == [("cost-of-goods",), ("lifo",)]
    assert [r.concept_id for r in search.search_concepts(c, "cogs").collect()] == ["cost-of-goods"]
    new = c.where("concept_id = 'fifo'").withColumn("aliases", F.array(F.lit("first-in"), F.lit("F.I.F.O."))).withColumn("source_documents", F.array(F.lit("b")))
    row = concepts.merge_by_name(c, new).where("name = 'FIFO'").head()
    assert row.source_documents == ["a", "b"] and row.aliases == ["First-In", "F.I.F.O."]


def test_aggregated_concepts_keep_first_name_and_longest_definition(spark):
    m = spark.createDataFrame([("x", 2, "B", "term", "longer text", ["q"], "o2"), ("x", 1, "A", "method", "short", ["p"], "o1"), ("y", 3, "C", "term", " ", None, "o3")], "concept_id string, ord int, name string, concept_type string, definition string, aliases array<string>, occurrence string")
    row = concepts.aggregate(m).collect()
    assert len(row) == 1 and (row[0].name, row[0].definition, row[0].occurrences, row[0].aliases, row[0].occurrence_count) == ("A", "longer text", ["o1", "o2"], ["p", "q"], 2)


def test_edges(spark):
    e = spark.createDataFrame([("fifo", "lifo", "relates_to"), ("fifo", "cogs", "calculated_from"), ("eoq", "holding", "requires"), ("eoq", "ordering", "requires"), ("fifo", "lifo", "relates_to")], "src string, dst string, type string")
    assert pairs(graph.related(e)) == [("fifo", "lifo", "relates_to")]
    assert pairs(graph.related_both(e)) == [("fifo", "lifo", 0), ("lifo", "fifo", 1)]
    assert pairs(graph.prerequisites(e)) == [("eoq", ["holding", "ordering"]), ("fifo", ["cogs"])]
    assert tuple(store.edge_duplicates(e).head()) == (5, 4, 1) and store.dedup_edges(e).count() == 4


def test_header_relations_use_numeric_order(spark):
    c = spark.createDataFrame([("d", "d_l2_2", "a", 1), ("d", "d_l2_10", "b", 2), ("d", "d_l2_11", "c", 1)], "document_id string, chunk_id string, concept_id string, header_level int")
    assert pairs(concepts.header_relations(c)) == [("a", "b")]
    assert pairs(concepts.header_relations(c, numeric=False)) == []


def test_sections_and_chunks():
    text = "intro\n# A\none\n## B\ntwo\n# C\n" + "Long sentence here. " * 300
    s = chunker.sections(text)
    assert [(x.no, x.parent, x.level, x.heading, x.content[:3]) for x in s] == [(0, None, 0, "", "int"), (1, 0, 1, "A", "one"), (2, 1, 2, "B", "two"), (3, 0, 1, "C", "Lon")]
    rows = chunker.chunk_rows("d", text, l2=128)
    assert rows[0]["section_path"] == ["Introduction"] and [r["level"] for r in rows[:4]] == [2, 2, 2, 1]
    parent = next(r for r in rows if r["level"] == 1)
    kids = [r for r in rows if r["parent_id"] == parent["chunk_id"]]
    assert parent["child_ids"] == [r["chunk_id"] for r in kids] and all(r["token_count"] <= 160 for r in kids)  # 32 sentences of 4 units each, and the spaces between
    leaves = [r for r in rows if r["level"] == 2]
    assert [r["next_id"] for r in leaves[:-1]] == [r["chunk_id"] for r in leaves[1:]] and leaves[-1]["next_id"] is None
    assert chunker.chunk_rows("d", "  ") == [] and len(chunker.chunk_rows("d", "x. " * 5000)) == 1


def test_blocks_and_packing():
    b = chunker.special_blocks("a\n```python\nx\n```\n| h |\n|---|\n| c |\n$$\ny\n$$\n~~~\nopen")
    assert [(k, i, j, lang) for k, _, i, j, lang in b] == [("code", 1, 3, "python"), ("table", 4, 6, ""), ("math", 7, 9, ""), ("code", 10, 12, "")]
    p = chunker.pack_sentences("Aaaa bbbb cccc. " * 20, 20, 5)
    assert all(chunker.size(x) <= 24 for x in p) and p[0][-15:].strip() in p[1]
    assert "".join(chunker.windows("abcdefgh" * 10, 4, 0)) == "abcdefgh" * 10


def test_chunks_of_null_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "# T\nx")], "document_id string, text string")
    assert pairs(chunker.document_chunks(df).select("chunk_id")) == [("c_l2_1",)]
    assert chunker.document_sections(df.limit(0)).count() == 0


def test_blocks_to_markdown(spark):
    b = spark.createDataFrame([(0, 0, "Header", "INTRO", None, None), (0, 1, "Text", "body", None, "a.png"), (0, 2, "Text", " ", None, None)], "chunk_idx int, block_idx int, type string, content string, level int, image_url string")
    assert chunker.blocks_to_markdown(b).head().markdown == "# INTRO\n\nbody\n\n![Text](a.png)"
    assert chunker.html_tables("<table><tr><th>a</th></tr><tr><td>b</td></tr></table>") == "| a |\n| --- |\n| b |"


def test_quality_score_and_status(spark):
    good = "# T\n\n" + "word " * 20
    df = spark.createDataFrame([(good * 12,), ("!?" * 50 + " a b c",), (None,), ("| a | b |\n| c |\nx\n",)], "text string")
    got = quality.reports(df).collect()
    assert got[0].status == "PASS" and got[0].score == 100
    assert got[1].status == "FAIL" and {"HIGH_SPECIAL_CHARS", "LOW_WORD_COUNT"} <= {i.code for i in got[1].issues}
    assert got[2].status == "FAIL" and got[2].word_count == 0 and got[3].broken_table_count == 1


def test_statuses_and_repairs(spark):
    f = spark.createDataFrame([("a", "pending"), ("b", "failed"), ("c", None)], "path string, status string")
    assert tuple(store.status_counts(f).head())[:5] == (3, 1, 0, 0, 1)
    s = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "source_id string")
    m = spark.createDataFrame([("c1", "d", 100), ("c2", "d", 3)], "source_id string, document_id string, word_count int")
    assert pairs(store.repair_set(s, m)) == [("c2", "truncated"), ("c3", "missing")]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "path string, size int")
    assert pairs(store.changed_files(a, a.where("path = 'x'").withColumn("size", F.lit(5)))) == [("x", "size"), ("y", "missing")]


def test_keep_newest_and_upsert(spark):
    rows = [(k, random.Random(i).random(), i) for i, k in enumerate("abcabc")]
    df = spark.createDataFrame(rows, "k string, ts double, v long")
    want = {k: max((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in "abc"}
    assert pairs(store.keep_newest(df, "k", "ts", [F.col("v")])) == sorted(want.values())
    assert store.upsert(df, df.where("k = 'a'").limit(1), ["k"]).count() == 5


def test_library(spark, chunks):
    docs = spark.createDataFrame([("d", "D", ["x", "y"]), ("e", "E", None)], "document_id string, title string, tag_list array<string>")
    vec = spark.createDataFrame([("d_l2_1", [1.0, 0.0]), ("d_l2_2", [0.6, 0.8]), ("e_l2_1", [-1.0, 0.0])], "chunk_id string, embedding array<double>")
    lib = Library(docs, chunks, vec)
    assert [r.chunk_id for r in lib.search_semantic([1.0, 0.0]).collect()] == ["d_l2_1", "d_l2_2"]
    assert [r.chunk_id for r in lib.search_semantic([1.0, 0.0], tags=["x"], semantic_type="example").collect()] == ["d_l2_2"]
    assert lib.get_parent("d_l2_1").head().chunk_id == "d_l1_1" and lib.get_siblings("d_l2_1").head().chunk_id == "d_l2_2"
    assert [r.chunk_id for r in lib.get_context_window("d_l2_2").collect()] == ["d_l2_1", "d_l2_2", "d_l2_3"]
    assert lib.get_chunk_images("d_l2_2").head().image == "a.png" and lib.get_chunk("none").count() == 0
    assert lib.get_document_stats("d").head().total_chunks == 4 and lib.list_documents(["x"]).count() == 1
    s = summarize(chunks)
    assert {r.level for r in s.collect()} == {"section", "chapter", "document"} and graph.hierarchy(s).where("depth = 0").count() == 2


def test_links_over_ranges_are_those_of_one_window(spark):
    from foliant.operators import graph

    rows = [(f"c{i:03}", "hot" if i % 3 else None if i % 2 else f"d{i % 5}", 2, i // 2) for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, level int, sequence_position int").repartition(7)
    got = {r.chunk_id: (r.prev_id, r.next_id) for r in graph.ordered_links(df, ["document_id", "level"], ["sequence_position", "chunk_id"], "chunk_id").collect()}
    groups = {}
    for c, d, _, n in sorted(rows, key=lambda r: (r[3], r[0])):
        groups.setdefault(d, []).append(c)
    want = {c: (g[i - 1] if i else None, g[i + 1] if i + 1 < len(g) else None) for g in groups.values() for i, c in enumerate(g)}
    assert got == want and graph.ordered_links(df.limit(0), ["document_id", "level"], ["sequence_position"], "chunk_id").count() == 0


def test_sections_of_long_documents(spark):
    from foliant.operators import graph

    s = spark.createDataFrame([("d", 0, 1, 0, 1000), ("d", 1, 2, 100, 400), ("d", 2, 3, 130, 130), ("e", 0, 1, 5, 4)], "doc_id string, section_no int, level int, start_line int, end_line int")
    lines = spark.createDataFrame([("d", n) for n in (0, 99, 100, 130, 131, 400, 401, 1000, 1001)] + [("e", 5)], "doc_id string, line_no int")
    got = {(r.doc_id, r.line_no): r.section_no for r in graph.section_of_line(s, lines).collect()}
    assert got == {("d", 0): 0, ("d", 99): 0, ("d", 100): 1, ("d", 130): 2, ("d", 131): 1, ("d", 400): 1, ("d", 401): 0, ("d", 1000): 0}


def test_central_sentences_of_a_long_text():
    from foliant.functions.extract import central_sentences

    text = " ".join(f"The clerk {w} counts stock item {i}." for i, w in enumerate(["daily", "weekly", "often", "seldom"] * 2000))
    assert central_sentences(text, 3).count(".") == 3
