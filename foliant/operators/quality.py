"""Quality of converted documents: counts, ratios, issues, score and status, all as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import word_count

WORDS_A_PAGE = 300


@dataclass(frozen=True)
class Thresholds:
    """Limits of warnings and errors (fixed values)."""

    ocr_warning: float = 0.8
    ocr_error: float = 0.6
    low_words_warning: float = 0.10
    low_words_error: float = 0.25
    page_warning: float = 100
    page_error: float = 50
    special_warning: float = 0.10
    special_error: float = 0.20
    empty_warning: float = 0.55
    empty_error: float = 0.70
    tables_warning: int = 1
    tables_error: int = 3
    line_warning: float = 200.0
    line_error: float = 500.0
    heading_words: int = 5000
    headings_warning: int = 1
    headings_error: int = 0
    empty_chunks_warning: float = 0.05
    empty_chunks_error: float = 0.15
    small_chunks_warning: float = 0.10
    small_chunks_error: float = 0.20
    small_chunk_words: int = 10

    def with_(self, **changes) -> Thresholds:
        return replace(self, **changes)


def metrics(c: Column | str) -> dict[str, Column]:
    """Counts and ratios of a markdown text; null counts as empty."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    lines = F.split(c, "\n")
    words, n_lines, chars = word_count(c).cast("int"), F.size(lines), F.length(c)
    pages = F.greatest(F.lit(1), F.floor(words / WORDS_A_PAGE)).cast("int")
    special = F.length(F.regexp_replace(c, r"(?U)[\w\s]", ""))
    blank = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)^\s*$")))
    return {
        "word_count": words,
        "line_count": n_lines,
        "estimated_pages": pages,
        "heading_count": F.regexp_count(c, F.lit(r"(?md)^#{1,6}\s+.+$")),
        "table_count": F.regexp_count(c, F.lit(r"(?md)^\|[-:|]+\|$")),
        "code_block_count": F.regexp_count(c, F.lit(r"```[\s\S]*?```|~~~[\s\S]*?~~~")),
        "list_count": F.regexp_count(c, F.lit(r"(?md)^[\s]*[-*+]\s+.+$|^[\s]*\d+\.\s+.+$")),
        "special_char_ratio": F.coalesce(F.try_divide(special.cast("double"), chars), F.lit(0.0)),
        "empty_line_ratio": blank / n_lines,
        "words_per_page": words / pages,
        "words_per_line": words / n_lines,
    }


def broken_tables(c: Column | str) -> Column:
    """Runs of pipe lines in which a line has another number of cells than the first; a run ends there."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    start = F.struct(F.lit(-1).alias("cells"), F.lit(0).alias("broken"))

    def step(s: Column, line: Column) -> Column:
        t = F.trim(line)
        pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
        row = t.startswith("|") & t.endswith("|") & (F.length(t) > 0)
        bad = row & (s["cells"] >= 0) & (s["cells"] != pipes)
        cells = F.when(~row | bad, -1).when(s["cells"] < 0, pipes).otherwise(s["cells"])
        return F.struct(cells.cast("int").alias("cells"), (s["broken"] + bad.cast("int")).alias("broken"))

    return F.aggregate(F.split(c, "\n"), start, step)["broken"]


def _two(bad: Column, worse: Column, code: str) -> Column:
    return F.when(worse, F.struct(F.lit(code).alias("code"), F.lit("error").alias("severity"))).when(bad, F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity")))


def issues(t: Thresholds = Thresholds()) -> Column:  # noqa: B008
    """Array of (code, severity) from columns named as in metrics, broken_table_count and the two OCR averages."""
    col = F.col
    large = col("word_count") >= t.heading_words
    found = F.array(
        _two(col("ocr_confidence_avg") < t.ocr_warning, col("ocr_confidence_avg") < t.ocr_error, "LOW_OCR_CONFIDENCE"),
        _two(col("low_confidence_word_ratio") > t.low_words_warning, col("low_confidence_word_ratio") > t.low_words_error, "HIGH_LOW_CONFIDENCE_WORDS"),
        _two(col("words_per_page") < t.page_warning, col("words_per_page") < t.page_error, "LOW_WORD_COUNT"),
        _two(col("special_char_ratio") > t.special_warning, col("special_char_ratio") > t.special_error, "HIGH_SPECIAL_CHARS"),
        _two(col("empty_line_ratio") > t.empty_warning, col("empty_line_ratio") > t.empty_error, "HIGH_EMPTY_LINES"),
        _two(col("words_per_line") > t.line_warning, col("words_per_line") > t.line_error, "NO_LINE_BREAKS"),
        F.when(large & (col("heading_count") <= t.headings_error), F.struct(F.lit("NO_STRUCTURE").alias("code"), F.lit("error").alias("severity"))).when(
            large & (col("heading_count") < t.headings_warning), F.struct(F.lit("LOW_STRUCTURE").alias("code"), F.lit("warning").alias("severity"))
        ),
        _two(col("broken_table_count") >= t.tables_warning, col("broken_table_count") >= t.tables_error, "BROKEN_TABLES"),
    )
    return F.array_compact(found)


def score(t: Thresholds = Thresholds(), empty_chunk_ratio: Column | None = None) -> Column:  # noqa: B008
    """100 less penalties, between 0 and 100."""
    col = F.col
    empty = F.lit(0.0) if empty_chunk_ratio is None else empty_chunk_ratio
    large = col("word_count") >= t.heading_words
    penalty = (
        F.when(col("words_per_page") < t.page_error, 30).when(col("words_per_page") < t.page_warning, 15).otherwise(0)
        + F.when(col("special_char_ratio") > t.special_error, 25).when(col("special_char_ratio") > t.special_warning, 12).otherwise(0)
        + F.when(col("empty_line_ratio") > t.empty_error, 10).when(col("empty_line_ratio") > t.empty_warning, 5).otherwise(0)
        + F.when(col("words_per_line") > t.line_error, 30).when(col("words_per_line") > t.line_warning, 15).otherwise(0)
        + F.when(large & (col("heading_count") <= t.headings_error), 20).when(large & (col("heading_count") < t.headings_warning), 10).otherwise(0)
        + F.when(col("broken_table_count") >= t.tables_error, 15).when(col("broken_table_count") >= t.tables_warning, 7).otherwise(0)
        + F.when(col("ocr_confidence_avg") < t.ocr_error, 20).when(col("ocr_confidence_avg") < t.ocr_warning, 10).otherwise(0)
        + F.when(empty > t.empty_chunks_error, 10).when(empty > t.empty_chunks_warning, 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty))


def status(found: Column | str = "issues", points: Column | str = "score") -> Column:
    found, points = (F.col(x) if isinstance(x, str) else x for x in (found, points))
    return F.when(F.exists(found, lambda i: i["severity"] == "error") | (points < 50), "FAIL").when((F.size(found) > 0) | (points < 70), "WARNING").otherwise("PASS")


def reports(texts: DataFrame, column: str = "text", t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """``texts`` with metrics, issues, score and status. OCR averages are used where the columns exist."""
    df = texts.withColumns(metrics(column)).withColumn("broken_table_count", broken_tables(column))
    for c in ("ocr_confidence_avg", "low_confidence_word_ratio"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    return df.withColumn("issues", issues(t)).withColumn("score", score(t)).withColumn("status", status())


def content_stats(c: Column | str) -> dict[str, Column]:
    """Counts of a markdown text: characters, words, lines, headings, tables, code and math blocks, images, links, pages."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    count = lambda s: ((F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)).cast("int")
    images = F.regexp_count(c, F.lit(r"!\[.*?\]\(.*?\)"))
    words = word_count(c).cast("int")
    return {
        "characters": F.length(c), "words": words, "lines": F.size(F.split(c, "\n")), "headings": F.regexp_count(c, F.lit(r"(?md)^#{1,6}\s")), "tables": count("|---"),
        "code_blocks": F.floor(count("```") / 2).cast("int"), "images": images, "math_blocks": (F.floor(count("$$") / 2) + count("\\[")).cast("int"),
        "links": F.regexp_count(c, F.lit(r"\[.*?\]\(.*?\)")) - images, "pages": F.greatest(F.lit(1), F.floor(words / WORDS_A_PAGE)).cast("int"),
    }


def chunk_quality(chunks: DataFrame, by: str = "document_id", t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Per document: chunk_count, empty and small chunks and their ratios, average words."""
    n = word_count("content")
    out = chunks.groupBy(by).agg(F.count("*").alias("chunk_count"), F.count_if(n == 0).alias("empty_chunks"), F.count_if((n > 0) & (n < t.small_chunk_words)).alias("small_chunks"), F.avg(n).alias("avg_chunk_words"))
    return out.withColumn("empty_ratio", F.col("empty_chunks") / F.col("chunk_count")).withColumn("small_ratio", F.col("small_chunks") / F.col("chunk_count"))


#: Limits of the converter's own check (fixed values): share of special characters, words, bars a table, triple breaks a line.
CONVERTED = {"special": 0.15, "words": 1000, "bars": 3, "gaps": 0.1}


def conversion_issues(text: str = "text") -> Column:
    """Codes of what seems wrong with converted markdown: special_characters, short, broken_tables, empty_lines. Null counts as ''."""
    c = F.coalesce(F.col(text), F.lit(""))
    n = lambda part: (F.length(c) - F.length(F.replace(c, F.lit(part)))) / len(part)
    lines, tables = F.size(F.split(c, "\n")), n("|---")
    special = F.length(F.regexp_replace(c, r"[\p{L}\p{M}\p{N}\p{Pc}\p{Z}\s]", "")) / F.length(c)
    found = [
        F.when((F.length(c) > 0) & (special > CONVERTED["special"]), "special_characters"),
        F.when(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) < CONVERTED["words"], "short"),
        F.when((tables > 0) & (n("|") < CONVERTED["bars"] * tables), "broken_tables"),
        F.when(n("\n\n\n") > CONVERTED["gaps"] * lines, "empty_lines"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
