"""Queries of the training-data problems, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import leaks, near_dups, neighbours, oracle, packing, quality, reading, scans, split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": near_dups.p1_found,
    "p1_classes": near_dups.p1_classes,
    "p2_found": quality.p2_found,
    "p2_statistics": quality.p2_statistics,
    "p3_found": neighbours.p3_found,
    "p3_neighbours": neighbours.p3_neighbours,
    "p4_found": split.p4_found,
    "p4_pieces": split.p4_pieces,
    "p5_found": scans.p5_found,
    "p5_paragraphs": scans.p5_paragraphs,
    "p6_found": packing.p6_found,
    "p6_windows": packing.p6_windows,
    "p7_found": leaks.p7_found,
    "p7_report": leaks.p7_report,
    "p8_found": reading.p8_found,
    "p8_levels": reading.p8_levels,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
