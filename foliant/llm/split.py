"""Problem 4: cut oversized sections at natural boundaries, with an overlap between pieces.

Method: the text is a row of tokens (lines, sentences, words) whose sizes have prefix sums; the offsets at
which a cut may fall are one sorted array a kind of boundary. Each piece takes the last boundary under the
limit by binary search, the next piece steps back by the overlap, and text without any boundary is cut hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import latest, read_table

KINDS = ("paragraph", "line", "sentence", "word", "character")
UNIT = 4  # characters to one unit of size
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SPACE = re.compile(r"\s+")


def _lines(text: str) -> list[tuple[int, int]]:
    """[start, end) of every line without leading and trailing white space; empty where it is blank."""
    out, at = [], 0
    for line in text.split("\n"):
        s = line.strip()
        a = at + (len(line) - len(line.lstrip()) if s else 0)
        out.append((a, a + len(s)))
        at += len(line) + 1
    return out


def boundaries(text: str) -> tuple[list[np.ndarray], list[int]]:
    """Sorted offsets at which a unit begins, and the longest unit in characters, for each of KINDS but the last.

    Paragraphs are separated by blank lines; a fenced block isn't divided by its own. A fence without an end
    runs to the end of the text.
    """
    lines = _lines(text)
    cuts: list[list[int]] = [[], [], [], []]
    longest = [0, 0, 0, 0]
    size, fenced, pending = -1, False, 0
    for a, b in lines:
        blank, fence = a == b, text.startswith("```", a, b)
        if blank and not fenced:
            size, pending = -1, 0
            continue
        if size < 0:
            cuts[0].append(a)
            size = b - a
        elif blank:
            pending += 1  # counts only if more of the block follows
        else:
            size += 1 + pending + b - a
            pending = 0
        longest[0] = max(longest[0], size)
        if fence:
            fenced = not fenced
        if blank:
            continue
        cuts[1].append(a)
        longest[1] = max(longest[1], b - a)
        for k, gap in ((2, _SENTENCE), (3, _SPACE)):
            at = a
            for m in gap.finditer(text, a, b):
                cuts[k].append(at)
                longest[k] = max(longest[k], m.start() - at)
                at = m.end()
            cuts[k].append(at)
            longest[k] = max(longest[k], b - at)
    return [np.array(c, np.int64) for c in cuts], longest


def cut_level(longest: list[int], limit: int) -> str:
    """The first kind for which every unit is within the limit."""
    return next((k for k, n in zip(KINDS, longest, strict=False) if n // UNIT <= limit), KINDS[-1])


def pieces(text: str, cuts: list[np.ndarray], limit: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of consecutive pieces of at most ``limit`` units.

    A coarser boundary is taken if it leaves the piece at least half full. Consecutive pieces share at most
    ``overlap`` units, fewer where the word that begins there would be cut; every piece goes beyond the last, so an
    overlap of the limit or more counts as one character less than the limit.
    """
    room, n, start, done = max(1, limit) * UNIT, len(text), 0, 0
    back = min(max(0, overlap) * UNIT, room - 1)
    while True:
        if n - start <= room:
            yield start, n, "end"
            return
        end, kind = start + room, KINDS[-1]
        for k, at in enumerate(cuts):
            i = int(np.searchsorted(at, start + room, "right")) - 1
            least = max(done, start + (room // 2 if k < 3 else 0))
            if i >= 0 and at[i] > least:
                end, kind = int(at[i]), KINDS[k]
                break
        yield start, end, kind
        done, start = end, end - back
        i = int(np.searchsorted(cuts[3], start, "left"))
        if i < len(cuts[3]) and cuts[3][i] <= end:
            start = int(cuts[3][i])


def split_oversized(sections: DataFrame, config: DataFrame) -> DataFrame:
    """One row a piece of every section that exceeds level_1_size (level 1) or level_2_size (level 2).

    ``sections`` needs doc_id, section_no, content, config_id; ``config`` config_id, level_1_size,
    level_2_size, overlap. Other columns are ignored. Result: doc_id, section_no, level, piece_no, start_char,
    end_char, ended_at, cut_at, piece. A null config_id means ``default``; sections of an unknown configuration
    and null limits give no row, nor does null or empty content. A limit below 1 counts as 1.
    """
    s = sections.select("doc_id", "section_no", "content", F.coalesce("config_id", F.lit("default")).alias("__c"))
    c = config.select(F.col("config_id").alias("__c"), F.struct("level_1_size", "level_2_size", "overlap").alias("__k"))
    c = c.groupBy("__c").agg(F.min("__k").alias("__k"))
    need = F.least("__k.level_1_size", "__k.level_2_size")
    big = s.join(c, "__c").where(F.floor(F.length("content") / UNIT) > need).select("doc_id", "section_no", "content", "__k.*")

    columns = ["doc_id", "section_no", "level", "piece_no", "start_char", "end_char", "ended_at", "cut_at", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[tuple] = []
            for doc, no, text, *sizes, overlap in pdf.itertuples(index=False):
                cuts, longest = boundaries(text)
                for level, limit in enumerate(sizes, 1):
                    if pd.isna(limit) or len(text) // UNIT <= limit:
                        continue
                    where = cut_level(longest, int(limit))
                    got = pieces(text, cuts, int(limit), 0 if pd.isna(overlap) else int(overlap))
                    held.extend((doc, no, level, i, a, b, kind, where, text[a:b]) for i, (a, b, kind) in enumerate(got))
                if len(held) >= 2000:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=columns)

    return big.mapInPandas(run, "doc_id string, section_no int, level int, piece_no int, start_char long, end_char long, ended_at string, cut_at string, piece string")


def _latest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read_table(spark, sf_dir, "sections").select("doc_id", "section_no", "content", "config_id", "parsed_at"), ["doc_id", "section_no"], "parsed_at", [F.xxhash64("content", "config_id")])


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_latest_sections(spark, sf_dir), read_table(spark, sf_dir, "chunk_config"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each oversized section with the boundary its cuts need; a section has pieces if and only if it is one."""
    return p4_pieces(spark, sf_dir).where("piece_no = 0").select("doc_id", "section_no", "level", "cut_at")
