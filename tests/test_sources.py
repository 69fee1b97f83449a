import time

from foliant.sources import files
from foliant.streaming import ingest


def test_markdown_source_skips_known(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Alfa\nx")
    (tmp_path / "b.md").write_text("y")
    (tmp_path / "c.txt").write_text("z")
    df = files.read_markdown(spark, str(tmp_path))
    assert sorted((r.document_id, r.title) for r in df.collect()) == [("a", "Alfa"), ("b", "b")]
    assert files.read_markdown(spark, str(tmp_path), skip=df.where("document_id = 'a'")).count() == 1
    listing = files.list_files(spark, str(tmp_path), "*.md")
    assert sorted(r.name for r in listing.collect()) == ["a.md", "b.md"] and files.newest(listing).count() == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("c1", 2, 1, ["a", "b"], "x" * 600)], "chunk_id string, level int, token_count int, section_path array<string>, content string")
    for kind in ("json", "csv", "markdown", "parquet"):
        files.write_chunks(df, str(tmp_path / kind), kind)
    row = spark.read.option("header", True).csv(str(tmp_path / "csv")).head()
    assert row.section_path == "a > b" and len(row.content) == 500
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    base = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 2 AS user_id, 'click' AS event_type, 1.0D AS value FROM range(10)")
    base.write.parquet(src)
    for _ in range(2):
        ingest.ingest_once(ingest.read_events(spark, src, base.schema), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 10
    time.sleep(0.1)
    base.write.mode("append").parquet(src)
    ingest.ingest_once(ingest.read_events(spark, src, base.schema), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 20


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    base = spark.sql("SELECT id % 5 AS event_id, timestamp'2024-01-01 00:00:00' AS ts, 1L AS user_id, 'click' AS event_type, 1.0D AS value FROM range(10)")
    base.write.parquet(src)
    ingest.ingest_once(ingest.first_seen(ingest.read_events(spark, src, base.schema)), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_windows_and_sessions(spark):
    df = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id,0,0) AS ts, 1L AS user_id, 'click' AS event_type, 1.0D AS value FROM range(3)")
    assert ingest.windowed(df).count() == 3 and ingest.sessions(df).count() == 3 and ingest.sessions(df, gap="2 hours").head().n == 3


def test_file_states(spark):
    ls = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    got = ingest.file_states(ls, ls.where("path = 'a'"), ls.where("path = 'b'"))
    assert sorted((r.path, r.status) for r in got.collect()) == [("a", "completed"), ("b", "failed"), ("c", "pending")]
