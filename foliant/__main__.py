"""Command line: runs a named query over a folder of tables, or chunks a folder of markdown files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from foliant import catalog, config
from foliant.operators import chunker
from foliant.sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="foliant")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="show a query's rows")
    q.add_argument("name", choices=sorted(catalog.queries()))
    q.add_argument("--data", default=config.load().data)
    q.add_argument("--rows", type=int, default=20)
    c = sub.add_parser("chunk", help="chunk markdown files")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "markdown"])
    c.add_argument("--sizes", type=config.chunk_sizes, default=(2048, 512, 256))
    c.add_argument("--recursive", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("foliant").getOrCreate()
    if a.command == "query":
        catalog.queries()[a.name](spark, a.data).show(a.rows, truncate=80)
    else:
        docs = files.read_markdown(spark, a.source, recursive=a.recursive)
        files.write_chunks(chunker.document_chunks(docs, l1=a.sizes[0], l2=a.sizes[1]), a.target, a.format)


if __name__ == "__main__":
    main()
