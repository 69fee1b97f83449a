import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import split as sp

CONFIG = [("default", 20, 10, 4), ("none", None, 10, None)]


def plain_level(text, limit):
    """The definition, read plainly."""
    lines = [x.strip() for x in text.split("\n")]
    paragraphs, cur, fenced = [], [], False
    for x in lines:
        if not x and not fenced:
            paragraphs.append(cur)
            cur = []
        else:
            cur.append(x)
        if x.startswith("```"):
            fenced = not fenced
    paragraphs.append(cur)
    units = [["\n".join(p).strip("\n") for p in paragraphs], lines, [s for x in lines for s in re.split(r"(?<=[.!?])\s+", x)], [w for x in lines for w in x.split()]]
    for kind, u in zip(sp.KINDS, units, strict=False):
        if all(len(x) // 4 <= limit for x in u):
            return kind
    return "character"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n`\té", max_size=200), st.integers(1, 12))
def test_cut_level_is_the_definition(text, limit):
    text = text.replace("`", "```")
    assert sp.cut_level(sp.boundaries(text)[1], limit) == plain_level(text, limit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefg .!\n", min_size=1, max_size=400), st.integers(1, 20), st.integers(0, 8))
def test_pieces_give_the_text_back(text, limit, overlap):
    got = list(sp.pieces(text, sp.boundaries(text)[0], limit, overlap))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    out, at = "", 0
    for a, b, _ in got:
        assert a <= at < b and b - a <= 4 * limit and at - a <= 4 * overlap
        out += text[at:b]
        at = b
    assert out == text


def test_sections(spark):
    long_ = "word " * 30
    rows = [("d", 1, long_, None, 1), ("d", 2, "short", "default", 1), ("d", 3, None, "default", 1), ("d", 4, "", "default", 1), ("d", 5, "x" * 90, "unknown", 1), ("d", 6, "y" * 60, "default", 1), ("d", 7, "z" * 60, "none", 1)]
    s = spark.createDataFrame(rows, "doc_id string, section_no int, content string, config_id string, level int")
    c = spark.createDataFrame(CONFIG, "config_id string, level_1_size int, level_2_size int, overlap int")
    got = sp.split_oversized(s, c).collect()
    assert {(r.section_no, r.level, r.cut_at) for r in got} == {(1, 1, "word"), (1, 2, "word"), (6, 2, "character"), (7, 2, "character")}
    assert all(len(r.piece) <= 80 and r.piece == (rows[r.section_no - 1][2])[r.start_char : r.end_char] for r in got)
    assert sp.split_oversized(s.limit(0), c).count() == 0 and sp.split_oversized(s, c.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["```\na\n\nb\n```\nc", "a\n\n```\nb\n\nc", " a \r\n\r\n b "])
def test_fences_and_returns(text):
    assert sp.cut_level(sp.boundaries(text)[1], 1) == plain_level(text, 1)


def test_very_long_text():
    text = "A sentence of words. " * 100_000
    got = list(sp.pieces(text, sp.boundaries(text)[0], 512, 64))
    assert got[-1][1] == len(text) and all(k == "sentence" for *_, k in got[:-1])
