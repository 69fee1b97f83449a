from foliant.functions import records as rc


def test_errors(spark):
    df = spark.createDataFrame([("a", "x", 2, 1, "theorem", 1), (None, "x", 5, None, "poem", 9), ("b", "x", 1, 1, "cli_command", None)], "chunk_id string, content string, level int, token_count int, semantic_type string, header_level int")
    got = [r[0] for r in df.select(rc.chunk_errors()).collect()]
    assert got[0] == [] and got[2] == [] and got[1] == ["missing chunk_id", "missing token_count", "level is not 0, 1 or 2", "unknown semantic_type poem", "header_level is not between 0 and 6"]
    assert [r[0] for r in df.select(rc.chunk_errors(True)).collect()][2] == ["unknown semantic_type cli_command"]
    d = spark.createDataFrame([("d", None)], "document_id string, title string")
    assert d.select(rc.document_errors()).head()[0] == ["missing title"]


def test_nodes_round_trip(spark):
    df = spark.createDataFrame([("a", ["x"], True, None, 3), ("b", None, None, "p", None)], "chunk_id string, child_ids array<string>, has_code boolean, parent_id string, level int")
    flat = rc.to_node(df)
    assert [tuple(r) for r in flat.collect()] == [("a", '["x"]', 1, "", 3), ("b", "[]", 0, "p", 0)]
    assert [tuple(r) for r in rc.from_node(flat, dict(df.dtypes)).collect()] == [("a", ["x"], True, None, 3), ("b", [], False, "p", 0)]


def test_summaries_in_order(spark):
    rows = [("s10", "chapter", "d_l1_10", '["__title__:Ten","p"]'), ("s2", "chapter", "d_l1_2", "oops"), ("sx", "chapter", "intro", None), ("s0", "document", "d", '["q"]')]
    got = rc.ordered_summaries(spark.createDataFrame(rows, "summary_id string, level string, source_id string, key_points string")).collect()
    assert [r.summary_id for r in got] == ["s0", "s2", "s10", "sx"]
    assert [(r.title, r.points) for r in got] == [(None, ["q"]), (None, []), ("Ten", ["p"]), (None, [])]


def test_names_and_listings(spark):
    df = spark.createDataFrame([("a_long_title_of_a_book",), ("x_y",)], "n string")
    assert [tuple(r) for r in df.select(rc.short_name("n", 10), rc.first_words("n")).collect()] == [("a long ti…", "long title of"), ("x y", "x_y")]
    ls = spark.createDataFrame([("  12 my file.pdf",), ("oops",), ("",), (None,)], "value string")
    assert [tuple(r) for r in rc.parse_listing(ls).collect()] == [("my file.pdf", 12)]
    b = spark.createDataFrame([("d", 1, 2, "u"), ("d", 1, 3, None)], "document_id string, chunk_idx int, block_idx int, image_url string")
    assert [r.path for r in rc.block_images(b, "img").collect()] == ["img/d/chunk1_block2.png"]
