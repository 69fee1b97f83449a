"""Generators over markdown: heading sections, special blocks, sentence packing, two-level chunks.

Each document is one row in and many rows out, without a shuffle: what is sequential within a document runs in one pass
over it, batches go through Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

L1_SIZE, L2_SIZE, OVERLAP_SHARE = 2048, 512, 0.15
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_FENCE = re.compile(r"(`{3,}|~{3,})(\w*)")
_SEPARATOR = re.compile(r"\|?[\s\-:|]+\|")
_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def size(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


@dataclass
class Section:
    no: int
    parent: int | None
    level: int
    heading: str
    path: list[str]
    start: int
    end: int = 0
    content: str = ""
    below: list[Section] = field(default_factory=list)

    def whole(self) -> str:
        """Own content and that of the sections below, in order, without headings."""
        return "\n".join([self.content, *(b.whole() for b in self.below)]) if self.below else self.content


def sections(text: str) -> list[Section]:
    """The text before the first heading as section 0 of level 0, then one section a heading line in order.

    A section's content is what stands between its heading and the next of any level; headings inside code fences
    count. The parent is the last earlier heading of a smaller level, else section 0. Line numbers start at 0.
    """
    lines = text.split("\n")
    out = [Section(0, None, 0, "", [], 0)]
    open_: list[Section] = [out[0]]
    marks = [(i, m) for i, line in enumerate(lines) if (m := _HEADING.fullmatch(line))]
    out[0].end = (marks[0][0] if marks else len(lines)) - 1
    out[0].content = "\n".join(lines[: marks[0][0]]).strip() if marks else text
    for k, (i, m) in enumerate(marks):
        level, stop = len(m.group(1)), marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        while open_[-1].level >= level:
            open_.pop()
        above = open_[-1]
        s = Section(k + 1, above.no, level, m.group(2).strip(), [*above.path, m.group(2).strip()], i, stop - 1, "\n".join(lines[i + 1 : stop]).strip())
        above.below.append(s)
        open_.append(s)
        out.append(s)
    return out


def special_blocks(text: str) -> list[tuple[str, str, int, int, str]]:
    """(type, content, first line, last line, language) of code fences, pipe tables and display formulas, in order."""
    lines, out, i = text.split("\n"), [], 0
    end = len(lines)

    def emit(kind: str, last: int, language: str = "") -> int:
        out.append((kind, "\n".join(lines[i : last + 1]), i, min(last, end), language))
        return last + 1

    while i < end:
        line = lines[i]
        bare = line.strip()
        if m := _FENCE.match(line):
            i = emit("code", next((j for j in range(i + 1, end) if lines[j].startswith(m.group(1))), end), m.group(2) or "")
        elif "|" in line and i + 1 < end and _SEPARATOR.match(lines[i + 1]):
            j = i + 1
            while j + 1 < end and "|" in lines[j + 1]:
                j += 1
            i = emit("table", j)
        elif bare.startswith(("$$", "\\[")):
            close = "$$" if bare.startswith("$$") else "\\]"
            one = len(bare) > 2 and bare.endswith(close)
            i = emit("math", i if one else next((j for j in range(i + 1, end) if close in lines[j]), end))
        else:
            i += 1
    return out


def pack_sentences(text: str, limit: int, overlap: int) -> list[str]:
    """Sentences put together up to ``limit`` tokens; a piece starts with the last sentences of the one before that fit
    ``overlap``. A sentence over the limit stays whole. Text within the limit is one piece, blank text none."""
    if not text.strip():
        return []
    if size(text) <= limit:
        return [text]
    out: list[str] = []
    held: list[tuple[str, int]] = []
    used = 0
    for s in _GAP.split(text):
        n = size(s)
        if held and used + n > limit:
            out.append(" ".join(h for h, _ in held))
            keep, used = [], 0
            for h, m in reversed(held):
                if used + m > overlap:
                    break
                keep.insert(0, (h, m))
                used += m
            held = [(" ".join(h for h, _ in keep), used)] if keep else []
        held.append((s, n))
        used += n
    return [*out, " ".join(h for h, _ in held)]


def windows(text: str, limit: int, overlap: int) -> list[str]:
    """Pieces of 4 * limit characters that share 4 * overlap, for text without sentences."""
    width, step = 4 * limit, 4 * (limit - overlap)
    if not text.strip():
        return []
    if step <= 0:
        step = width
    return [text[a : a + width] for a in range(0, len(text), step) if a == 0 or a + (width - step) < len(text)]


def chunk_rows(doc: str, text: str, l1: int = L1_SIZE, l2: int = L2_SIZE, share: float = OVERLAP_SHARE) -> list[dict]:
    """Chunks of two levels in order of emission, with links and parents. Blank text has none."""
    if not text.strip():
        return []
    tree, blocks = sections(text), special_blocks(text)
    out: list[dict] = []
    count = {1: 0, 2: 0}

    def add(level: int, content: str, tokens: int, path: list[str], parent: dict | None = None, source: str | None = None, kind: str | None = None) -> dict:
        count[level] += 1
        row = {"chunk_id": f"{doc}_l{level}_{count[level]}", "content": content, "level": level, "token_count": tokens, "parent_id": parent and parent["chunk_id"], "child_ids": [], "section_path": path, "source_section": source, "block_type": kind}
        if parent:
            parent["child_ids"].append(row["chunk_id"])
        out.append(row)
        return row

    def leaves(s: Section, parent: dict) -> None:
        rest = s.content
        for kind, body, *_ in blocks:
            if body in rest:
                if body:
                    add(2, body, size(body), s.path, parent, kind=kind)
                rest = rest.replace(body, "", 1)
        for piece in pack_sentences(rest.strip(), l2, int(l2 * share)):
            if piece.strip():
                add(2, piece.strip(), size(piece), s.path, parent)

    if tree[0].content.strip():
        add(2, tree[0].content.strip(), size(tree[0].content), ["Introduction"], source="Introduction")
    for s in tree[1:]:  # sections stand in the order of a walk from above
        whole = s.whole()
        if size(whole) >= l2:
            leaves(s, add(1, whole[: 4 * l1], min(size(whole), l1), s.path, source=s.heading))
        elif s.content.strip():
            add(2, s.content.strip(), size(s.content), s.path, source=s.heading)
    for level in (1, 2):
        ids = [r["chunk_id"] for r in out if r["level"] == level]
        link = dict(zip(ids, zip([None, *ids], [*ids[1:], None], strict=False), strict=False))
        for r in out:
            if r["level"] == level:
                r["prev_id"], r["next_id"] = link[r["chunk_id"]]
    for i, r in enumerate(out):
        r["sequence_position"] = i
    return out


_CHUNK = "document_id string, chunk_id string, content string, level int, token_count int, parent_id string, child_ids array<string>, prev_id string, next_id string, section_path array<string>, source_section string, block_type string, sequence_position int"
_SECTION = "document_id string, section_no int, parent_no int, level int, heading string, path array<string>, content string, start_line int, end_line int"
_BLOCK = "document_id string, block_no int, block_type string, content string, start_line int, end_line int, language string"


def _flat(documents: DataFrame, schema: str, rows, doc: str, text: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def frame(got: list) -> pd.DataFrame:
        return pd.DataFrame(got, columns=names).astype({c: "Int64" for c in names if c in ("parent_no",)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list = []
            for d, t in pdf.itertuples(index=False):
                held.extend(rows(d, t if isinstance(t, str) else ""))
                if len(held) >= 5000:  # whole batches are cheap to hand over, single documents aren't
                    yield frame(held)
                    held = []
            if held:
                yield frame(held)

    return documents.selectExpr(f"CAST({doc} AS string) AS d", f"{text} AS t").mapInPandas(run, schema)


def document_chunks(documents: DataFrame, doc: str = "document_id", text: str = "text", l1: int = L1_SIZE, l2: int = L2_SIZE, share: float = OVERLAP_SHARE) -> DataFrame:
    return _flat(documents, _CHUNK, lambda d, t: [{"document_id": d, **r} for r in chunk_rows(d, t, l1, l2, share)], doc, text)


def document_sections(documents: DataFrame, doc: str = "document_id", text: str = "text") -> DataFrame:
    return _flat(documents, _SECTION, lambda d, t: [(d, s.no, s.parent, s.level, s.heading, s.path, s.content, s.start, s.end) for s in sections(t)], doc, text)


def document_blocks(documents: DataFrame, doc: str = "document_id", text: str = "text") -> DataFrame:
    return _flat(documents, _BLOCK, lambda d, t: [(d, i, *b) for i, b in enumerate(special_blocks(t))], doc, text)


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """(chunk_idx, markdown) from (chunk_idx, block_idx, type, content, level, image_url): headers get their marks, given or
    inferred, images a marker, blank contents are left out."""
    from pyspark.sql import functions as F

    text = F.trim("content")
    level = F.coalesce("level", header_level("content"))
    line = F.when(F.col("type") == "Header", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(F.col("content"))
    line = F.when(F.col("image_url").isNotNull(), F.concat(line, F.format_string("\n\n![%s](%s)", F.col("type"), F.col("image_url")))).otherwise(line)
    kept = blocks.where(F.length(text) > 0).select("chunk_idx", F.struct("block_idx", line.alias("line")).alias("b"))
    return kept.groupBy("chunk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["line"]), "\n\n").alias("markdown"))


def header_level(c):
    """1 for short capitals and chapter-like titles, 2 below 100 characters, else 3."""
    from pyspark.sql import functions as F

    c = F.trim(F.col(c) if isinstance(c, str) else c)
    n, capitals = F.length(c), (F.upper(c) == c) & (F.lower(c) != c)
    return F.when((n < 50) & capitals, 1).when(F.lower(c).rlike("chapter|part|section") & (n < 80), 1).when(n < 100, 2).otherwise(3)


def html_tables(text: str) -> str:
    """HTML tables as pipe tables; a table without rows stays as it is."""

    def table(m: re.Match) -> str:
        rows = [[re.sub(r"<[^>]+>", "", c).strip() for c in re.findall(r"<t[dh][^>]*>(.*?)</t[dh]>", r, re.S | re.I)] for r in re.findall(r"<tr[^>]*>(.*?)</tr>", m.group(), re.S | re.I)]
        rows = [r for r in rows if r]
        if not rows:
            return m.group()
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]])

    return re.sub(r"<table[^>]*>.*?</table>", table, text, flags=re.S | re.I)
