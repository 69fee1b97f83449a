import numpy as np
import pytest

from foliant.llm import packing as pk


def test_blocks_respect_every_limit_and_waste_little():
    rng = np.random.default_rng(0)
    sizes = np.stack([rng.integers(1, 3000, 3000), np.ones(3000, int), rng.integers(0, 500, 3000)], 1)
    sizes[:, 2] = np.minimum(sizes[:, 2], sizes[:, 0])
    limits = np.array([8192, 12, 2500])
    win = pk.pack_block(sizes, limits)
    total = np.stack([np.bincount(win, sizes[:, k]) for k in range(3)], 1)
    assert (total <= limits).all() and len(np.unique(win)) == win.max() + 1
    least = max(int(np.ceil(sizes[:, k].sum() / limits[k])) for k in range(3))
    assert win.max() + 1 <= 1.1 * least + 2
    assert len(pk.pack_block(sizes[:0], limits)) == 0


@pytest.mark.parametrize("block", [50, 10_000])
def test_every_row_has_a_window(spark, block):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(n), int(n // 2)) for i, n in enumerate(rng.integers(0, 60, 400))] + [(1000, 250, 250), (1001, 100, 100), (1002, 101, 0), (7, 10, 10), (None, 5, 5), (None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, tokens long, loss_tokens long, window_id string")
    out = pk.pack(df, capacity=100, max_segments=8, block=block).collect()
    assert len(out) == len(rows) + 3  # 250 in three parts, 101 in two
    by = {}
    for r in out:
        by.setdefault(r.window_id, []).append(r)
    assert all(sum(r.tokens for r in w) <= 100 and len(w) <= 8 and sum(r.loss_tokens for r in w) <= 100 for w in by.values())
    assert {r.doc_id for r in out if r.oversize} == {1000, 1002} and sum(r.tokens for r in out) == sum(r[1] or 0 for r in rows)
    assert {r.doc_id: r.tokens for r in out if r.parts == 1 and r.doc_id == 1001} == {1001: 100}
    assert pk.pack(df.limit(0), capacity=100).count() == 0


def test_sizes(spark):
    q = "Q: What is it?\nA: It is a thing.\nQ: And?\nA: No."
    df = spark.createDataFrame([(1, "Hello world."), (2, None), (3, ""), (4, q)], "doc_id long, text string")
    got = {r.doc_id: (r.tokens, r.loss_tokens) for r in pk.token_sizes(df).collect()}
    enc = pk._encoding(pk.VOCABULARY)
    assert got[1] == (len(enc.encode_ordinary("Hello world.")),) * 2 and got[2] == got[3] == (0, 0)
    assert 0 < got[4][1] < got[4][0]


def test_long_texts_count_as_they_would_at_once():
    enc = pk._encoding(pk.VOCABULARY)
    text = "Some plain words, 12 numbers.\n" * 3000
    assert pk._count(enc, text, 1000) == len(enc.encode_ordinary(text))


def test_questions_and_answers_count_as_whole_texts(spark):
    texts = ["\n".join(f"Q: What is item {i}, größer?\nA: It is {i} of {n}.\n" for i in range(n)) for n in (1, 3, 40)]
    enc = pk._encoding(pk.VOCABULARY)
    got = {r.doc_id: r for r in pk.token_sizes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i].tokens == len(enc.encode_ordinary(t))
        assert 0.3 * got[i].tokens < got[i].loss_tokens < 0.7 * got[i].tokens
    out = pk.pack(pk.token_sizes(spark.createDataFrame([(i, t) for i in range(30) for t in texts], "doc_id long, text string")), capacity=2000, max_loss=1200)
    by = {}
    for r in out.collect():
        by.setdefault(r.window_id, []).append(r)
    assert all(sum(r.tokens for r in w) <= 2000 and sum(r.loss_tokens for r in w) <= 1200 for w in by.values())


def test_loss_limit_binds():
    sizes = np.array([[100, 1, 90]] * 40)
    win = pk.pack_block(sizes, np.array([1000, 64, 300]))
    assert np.bincount(win, sizes[:, 2]).max() == 270 and win.max() + 1 == 14
