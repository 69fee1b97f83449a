import pytest
from pyspark.sql import functions as F

from foliant.common import latest
from foliant.functions import display
from foliant.operators import distill, profiles, quality, store
from foliant.plans import api, ingest, property_graph

BOOK = "# Stock\n\nA ledger is a record of stock. It is kept by the clerk.\n\n## Counts\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nFor example, count the bins first."


def docs(spark, *rows):
    return spark.createDataFrame(rows, "document_id string, title string, text string")


def test_ingest_store_and_load(spark, tmp_path):
    one = ingest.ingest(docs(spark, ("a", "A", BOOK), ("b", "B", None), ("c", "C", "")), 16)
    assert {n: len(one[n].columns) > 2 for n in ingest.TABLES} == dict.fromkeys(ingest.TABLES, True)
    chunks = one["chunks"].collect()
    assert chunks and all(r.document_id == "a" for r in chunks if r.content) and ingest.unpaired(one).count() == 0
    leaves = [r for r in chunks if r.level == 2 and r.content is not None]
    assert one["vectors"].count() == len(leaves) and one["chunk_metadata"].where("has_table").count() >= 1
    ingest.save(one, str(tmp_path / "kb"))
    back = ingest.load(spark, str(tmp_path / "kb"))
    assert back["chunks"].count() == len(chunks) and back["documents"].where("document_id = 'a'").head().chunk_count == sum(r.document_id == "a" for r in chunks)
    two = ingest.store_document(back, ingest.ingest(docs(spark, ("a", "A2", "# Short\n\nOne line.")), 16))
    assert two["documents"].where("document_id = 'a'").head().title == "A2" and ingest.unpaired(two).count() == 0
    assert two["chunks"].where("document_id = 'a'").count() < len(chunks)
    assert ingest.ingest(docs(spark, ("a", "A", BOOK)).limit(0), 16)["vectors"].count() == 0


def test_profiles_and_types(spark):
    assert profiles.list_profiles() == ["agriculture", "erp", "general", "programming", "stem", "veterinary"]
    assert len(profiles.ALL_TYPES) == len(set(profiles.ALL_TYPES)) == 42 and all(set(p.types) <= set(profiles.ALL_TYPES) for p in profiles.PROFILES.values())
    with pytest.raises(ValueError):
        profiles.get_profile("poetry")
    df = spark.createDataFrame([("Data-Structure",), (" equation ",), ("virus",), ("nonsense",), (None,)], "t string")
    assert [r[0] for r in df.select(profiles.concept_type("t")).collect()] == ["data_structure", "formula", "pathogen", "term", "term"]
    assert [r[0] for r in df.select(profiles.concept_type("t", "general")).collect()] == ["term", "formula", "term", "term", "term"]


def test_occurrences_and_specialist(spark):
    c = spark.createDataFrame([("x", ["summary_b_l1_5_chapter", "summary_b_l1_5_section", "summary_b_l2_1", "b_l1_5", "summary_gone_section"]), ("y", None)], "concept_id string, occurrences array<string>")
    chunks = spark.createDataFrame([("b_l1_5",), ("b_l2_1",)], "chunk_id string")
    assert {tuple(r) for r in distill.occurrence_edges(c, chunks).collect()} == {("b_l1_5", "x"), ("b_l2_1", "x")}
    named = spark.createDataFrame([("x", "Fifo", "method"), ("y", "Lifo", None)], "concept_id string, name string, concept_type string")
    row = distill.specialist(named, spark.createDataFrame([("y", "x")], "src string, dst string"), chunks, "Stock keeping").head()
    assert row.expertise == ["Lifo", "Fifo"] and row.concept_types == ["method:1", "unknown:1"] and row.name == "stock-keeping_specialist"
    none = distill.specialist(named.limit(0), spark.createDataFrame([], "src string, dst string"), chunks, "T").head()
    assert none.total_concepts == 0 and none.expertise == []


def test_conversion_issues(spark):
    df = spark.createDataFrame([(1, "|---|" + "word " * 1200), (2, "%$&" * 50), (3, None), (4, "a\n\n\n" * 30)], "i int, text string")
    got = {r.i: set(r.x) for r in df.select("i", quality.conversion_issues().alias("x")).collect()}
    assert got == {1: {"broken_tables"}, 2: {"special_characters", "short"}, 3: {"short"}, 4: {"short", "empty_lines"}}


def library(spark):
    d = spark.createDataFrame([("d", "T", ["x"], 1), ("e", None, None, 2)], "document_id string, title string, tag_list array<string>, created_at long")
    c = spark.createDataFrame([(f"c{i}", "d", f"text {i}", 2, i) for i in range(6)], "chunk_id string, document_id string, content string, level int, token_count int")
    v = spark.createDataFrame([(f"c{i}", [1.0, i / 10]) for i in range(6)], "chunk_id string, embedding array<double>")
    return api.Library(d, c, v)


def test_reranked_search_and_resources(spark):
    lib = library(spark)
    assert [r.chunk_id for r in lib.search_reranked([1.0, 0.0], F.col("token_count"), 2, 2).collect()] == ["c3", "c2"]

    def fails(query):
        raise OSError("no service")

    assert [r.chunk_id for r in lib.search_reranked([1.0, 0.0], fails, 2).collect()] == ["c0", "c1"]
    assert '"title":"T"' in lib.resource("library://document/d").head().json and lib.resource("library://documents").count() == 2
    assert '"section_path":[]' in lib.resource("library://chunk/c1").head().json and lib.resource("library://chunk/zz").count() == 0
    assert "chunk_id" in lib.resource("library://schema").head().json
    with pytest.raises(ValueError):
        lib.resource("library://nothing")


def test_records(spark):
    lib = library(spark)
    got = {r.doc_id: (r.title, r.tags, r.chunk_count) for r in display.document_record(lib.documents, lib.chunks).collect()}
    assert got == {"d": ("T", ["x"], 6), "e": ("", [], 0)}
    row = display.search_record(lib.chunks.withColumn("score", F.lit(0.123456))).head()
    assert row.similarity_score == 0.1235 and row.has_table is False and row.child_ids == []
    assert store.chunk_types(lib.chunks.withColumn("semantic_type", F.lit(None).cast("string"))).head().by_type[0].type == "unknown"


def test_latest_reads_only_what_is_asked_for(spark, tmp_path):
    rows = [("a", 1, "old", "z"), ("a", 2, "new", "z"), (None, 3, "x", "z"), ("b", None, "only", "z")]
    spark.createDataFrame(rows, "k string, ts int, v string, wide string").write.parquet(str(tmp_path / "t"))
    df = latest(spark.read.parquet(str(tmp_path / "t")), ["k"], "ts", [F.col("v")]).select("k", "v")
    assert {tuple(r) for r in df.collect()} == {("a", "new"), ("b", "only")}
    assert "wide" not in df._jdf.queryExecution().executedPlan().toString()


def test_columns_can_be_cleared(spark):
    g = property_graph.PropertyGraph({"concept": spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "concept_id string, name string, definition string")}, spark.createDataFrame([], "src string, dst string, type string"))
    out = g.update("concept", spark.createDataFrame([("a", None)], "concept_id string, definition string"), nulls=True).nodes["concept"]
    assert {tuple(r) for r in out.select("concept_id", "name", "definition").collect()} == {("a", "A", None), ("b", "B", "y")}
