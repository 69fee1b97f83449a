import pytest
from foliant.functions import text as tx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column("c")).head()[0]


@pytest.mark.parametrize(("text", "tokens"), [(None, 0), ("", 0), ("a", 1), ("abcdefgh", 2), ("é" * 9, 2)])
def test_tokens(spark, text, tokens):
    assert one(spark, text, tx.estimate_tokens) == tokens


@pytest.mark.parametrize(
    ("text", "kind"),
    [(None, "narrative"), ("Theorem 1. x", "theorem"), ("FIFO is defined as x", "definition"), ("```bash\nls\n```", "cli_command"), ("```python\nx\n```", "code_example"),
     ("For instance, x", "example"), ("First, do. Then, go.", "procedure"), ("Then, go.", "narrative")],
)
def test_semantic_types(spark, text, kind):
    assert one(spark, text, tx.semantic_type) == kind


def test_flags(spark):
    row = spark.createDataFrame([("| a | b |\n```x```\n$y$\n- z\n![i](p.png)",), ("plain",), (None,)], "c string").select(*[v.alias(k) for k, v in tx.content_flags("c").items()]).collect()
    assert all(row[0]) and not any(row[1]) and not any(row[2])


def test_header_is_the_first_line_only(spark):
    df = spark.createDataFrame([("## Title \nx",), ("x\n# y",), (None,)], "c string").select(*[v.alias(k) for k, v in tx.header_info("c").items()]).collect()
    assert [tuple(r) for r in df] == [("Title", 2, "Header"), (None, None, None), (None, None, None)]


def test_tags_are_ordered_by_length_and_text(spark):
    assert one(spark, "**Beta** and *Alfa* and Cost Of Goods, called stock", tx.topic_tags) == ["alfa", "beta", "stock", "cost of goods"]


def test_slugs(spark):
    assert one(spark, " A/B  Testing_x ", tx.slug) == "ab-testing-x"
    assert one(spark, "Inventories of Boxes", tx.singular_slug) == "inventory-of-box"
    assert one(spark, "my file (1).pdf", tx.file_slug) == "my_file_1_pdf"
    assert one(spark, "???", tx.display_slug) == "unnamed"


def test_lead_and_preview(spark):
    assert one(spark, "A b. C d! E f? G.", lambda c: tx.lead(c, 2)) == "A b. C d!"
    assert one(spark, "It is 0. See Fig. 2.15 now. 3 x.", lambda c: tx.lead(c, 4)) == "It is 0. See Fig. 2.15 now. 3 x."
    assert one(spark, "abcdef", lambda c: tx.preview(c, 3)) == "abc..."


def test_json_lists_tolerate_dirt(spark):
    rows = spark.createDataFrame([('["a","b"]',), ("oops",), (None,), ("",)], "c string").select(tx.json_list("c")).collect()
    assert [r[0] for r in rows] == [["a", "b"], [], [], []]


def test_titles(spark):
    df = spark.createDataFrame([("/x/book.md", "\n# My Title\nx"), ("/x/book.md", "x")], "p string, c string").select(tx.title_of("p", "c")).collect()
    assert [r[0] for r in df] == ["My Title", "book"]


def test_sizes(spark):
    df = spark.createDataFrame([(10,), (2048,), (3 * 1024**3,)], "n long").select(tx.file_size("n")).collect()
    assert [r[0] for r in df] == ["10.0 B", "2.0 KB", "3.0 GB"]


def test_formatted_terms(spark):
    assert one(spark, "**Stock** then *stock* and *Lead Time*", tx.formatted_terms) == ["Stock", "Lead Time"]
