import pytest

from foliant import config
from foliant.__main__ import main
from foliant.functions import extract
from foliant.operators import concepts
from foliant.plans.property_graph import NAMED, PropertyGraph


@pytest.fixture(scope="module")
def graph(spark):
    nodes = {
        "document": spark.createDataFrame([("d", "D")], "document_id string, title string"),
        "chunk": spark.createDataFrame([("c1", "d", 1), ("c2", "d", 2)], "chunk_id string, document_id string, level int"),
        "concept": spark.createDataFrame([("fifo", "FIFO", None), ("lifo", "LIFO", "x")], "concept_id string, name string, definition string"),
    }
    edges = spark.createDataFrame([("c1", "c2", "parent_of"), ("c2", "fifo", "defines_concept"), ("fifo", "lifo", "relates_to"), ("fifo", "lifo", "relates_to")], "src string, dst string, type string")
    return PropertyGraph(nodes, edges)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_stored_queries(spark, graph):
    assert graph.run("chunks_by_document_and_level", document_id="d", level=2).head().chunk_id == "c2"
    assert graph.run("child_chunks", ids(spark, "c1")).head().chunk_id == "c2" and graph.run("parent_chunk", ids(spark, "c2")).head().chunk_id == "c1"
    assert graph.run("related", ids(spark, "fifo")).count() == 1 and graph.run("dependents", ids(spark, "lifo")).head().concept_id == "fifo"
    assert graph.run("definition_chunks", ids(spark, "fifo")).head().chunk_id == "c2" and graph.run("list_concepts").count() == 2 and len(NAMED) > 40


def test_changes_leave_no_loose_edges(spark, graph):
    g = graph.drop("chunk", ids(spark, "c2"))
    assert g.nodes["chunk"].count() == 1 and g.edges.count() == 2
    assert graph.unlink(ids(spark, "fifo"), "relates_to").edges.count() == 2
    g = graph.update("concept", spark.createDataFrame([("fifo", "first in", None)], "concept_id string, definition string, name string"))
    assert {(r.name, r.definition) for r in g.nodes["concept"].collect()} == {("FIFO", "first in"), ("LIFO", "x")}
    g = graph.add("concept", spark.createDataFrame([("eoq", "EOQ")], "concept_id string, name string")).link(spark.createDataFrame([("eoq", "fifo")], "src string, dst string"), "requires")
    assert g.run("requires", ids(spark, "eoq")).head().concept_id == "fifo"


def test_extraction(spark):
    text = "Stock is kept in the store. The store keeps stock dry. Birds sing. Stock and store cost money."
    assert "Birds" not in extract.central_sentences(text, 2)
    assert [k for k, _ in extract.keywords(text, 2)] == ["stock", "store"]
    df = spark.createDataFrame([("c1", 0, text), ("c2", 1, None), ("c3", 2, "**Lead Time** matters.")], "chunk_id string, sequence_position int, content string")
    assert df.select(extract.summary_column("content", 1), extract.keyword_column("content", 3)).count() == 3
    assert "lead-time" in {r.concept_id for r in extract.mentions(df).collect()}
    assert concepts.aggregate(extract.mentions(df)).count() == 0  # no definition, no concept


def test_providers_see_only_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, " "), (3, None), (4, "c")], "i int, t string")
    got = {r.i: r.n for r in extract.apply_provider(df, "t", "n", "long", lambda ts: [len(t) for t in ts], batch=1, blank=0).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 1}


def test_settings(tmp_path):
    (tmp_path / "u").write_text('level_1_size = 10\ntop_k = 3\nother = "x"')
    (tmp_path / "p").write_text("top_k = 4")
    c = config.load(tmp_path / "u", tmp_path / "p", {"FOLIANT_THRESHOLD": "0.5"})
    assert (c.level_1_size, c.top_k, c.threshold) == (10, 4, 0.5)
    with pytest.raises(ValueError, match="three"):
        config.chunk_sizes("1,2")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\nsome text")
    main(["chunk", str(tmp_path / "in"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).head().chunk_id == "a_l2_1"
