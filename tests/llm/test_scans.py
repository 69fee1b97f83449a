import datetime as dt
import random

import pytest

from foliant.llm import scans as sc

WORDS = "ledger factory stock report manager carrier delivery measure before summary standard receipt clerk account monthly inventory described corrected between warehouse number second which every table market invoice finding".split()
T0 = dt.datetime(2024, 1, 1)


def spoil(w, rng):
    pairs = [(a, b) for a, b in (("o", "0"), ("l", "1"), ("e", "c"), ("m", "rn"), ("s", "5"), ("n", "ri")) if a in w[1:]]
    if not pairs:
        return w
    a, b = rng.choice(pairs)
    i = w.index(a, 1)
    return w[:i] + b + w[i + 1 :]


@pytest.fixture(scope="module")
def editor():
    rng = random.Random(1)
    e = sc.Editor({w: 100 for w in WORDS} | {"high-volume": 5, "the": 900, "and": 900})
    spoiled = [spoil(rng.choice(WORDS[:20]), rng) for _ in range(400)]
    e.learn([(w, 1) for w in spoiled if w not in e.vocabulary])
    return e


def test_held_out_words_are_mended(editor):
    rng = random.Random(7)
    cases = [(spoil(w, rng), w) for w in WORDS[20:] * 4]
    cases = [(s, w) for s, w in cases if s != w]
    assert sum(editor.fix(s) == w for s, w in cases) / len(cases) >= 0.9
    assert all(editor.fix(w) is None for w in WORDS) and editor.fix("42") is None and editor.fix("4l2") == "412"


def test_line_ends(editor):
    assert editor.join("ware", "house") == "warehouse" and editor.join("high", "volume") == "high-volume"
    assert editor.join("first", "and") is None and editor.join("x", "") is None


def test_furniture_by_place_and_repetition():
    lines = ["STOCK REPORTS", "The text goes on here", "", "- 12 -", "HARBOUR COUNTS", "and on. Over 40", "units were sold.", "Page 13"]
    assert sc.furniture(lines, [sc.fold("Harbour counts")]) == {0, 3, 4, 7}
    assert sc.furniture(["A line.", "12 units of it", "end."], []) == set()
    assert sc.fold("Ch. Harb0ur counts   39") == sc.fold("Ch. Harbour counts  41")


def book(pages, name="b", level=2):
    return [(f"{name}_l2_{i}", t, level, f"{name}_l2_{i + 1}" if i + 1 < len(pages) else None, T0) for i, t in enumerate(pages)]


def test_pages_end_to_end(spark):
    clean = [" ".join(random.Random(i).choices(WORDS, k=60)) + "." for i in range(40)]
    pages = [f"Stock report | Clerks\nThe 1edger and report were described be-\ntween every table. The ware-\n- {i} -" if i % 2 == 0 else f"Stock report | Clerks\nhouse number and the rnarket table. The manager\n- {i} -" for i in range(10)]
    rows = book(clean, "c") + book(pages) + [("b_l2_3", "old", 2, None, T0 - dt.timedelta(1)), ("n_l2_0", None, 2, None, T0), ("e_l2_0", "", 2, None, T0), ("b_l1_1", "x", 1, None, T0)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, level int, next_id string, ingested_at timestamp")
    meta = spark.createDataFrame([(r[0], r[0].split("_")[0], T0, "x") for r in rows if r[0] != "b_l2_5"], "chunk_id string, document_id string, ingested_at timestamp, content string")
    p, c = sc.scanned_pages(chunks, meta)
    assert p.count() == 10
    e, right = sc.train(p, c)
    assert right is None
    shared = spark.sparkContext.broadcast(e)
    got = {tuple(r) for r in sc.page_faults(sc.with_rare_words(p, right, shared), shared).collect()}
    assert {("b_l2_0", 0, "furniture", ""), ("b_l2_0", 3, "furniture", ""), ("b_l2_0", 1, "hyphen", "between"), ("b_l2_0", 2, "hyphen", "warehouse"), ("b_l2_0", 1, "misread", "ledger"), ("b_l2_1", 1, "misread", "market")} <= got
    assert not any(x[0] == "b_l2_1" and x[3] == "warehouse" for x in got)
    assert sc.repaired(pages[0], [sc.fold("Stock report | Clerks")], "house", e) == "The ledger and report were described between every table. The warehouse"


def test_no_scans(spark):
    chunks = spark.createDataFrame(book(["Plain text. " * 5] * 3), "chunk_id string, content string, level int, next_id string, ingested_at timestamp")
    meta = spark.createDataFrame([], "chunk_id string, document_id string, ingested_at timestamp")
    p, c = sc.scanned_pages(chunks, meta)
    e = spark.sparkContext.broadcast(sc.train(p, c)[0])
    assert p.count() == 0 and sc.page_faults(sc.with_rare_words(p, None, e), e).count() == 0
    assert sc.scanned_pages(chunks.limit(0), meta)[0].count() == 0


def test_heads_of_many_chapters_are_found_within_a_chunk(spark):
    """Thirty chapters of three pages, and one of two: no head is on 8 % of the chunks, and there are more than eight."""
    names = [f"{a.capitalize()} {b}" for a in WORDS[:6] for b in WORDS[6:11]]
    rng = random.Random(3)
    pages, want = [], set()
    for k, name in enumerate([*names, "Harbour invoices"]):
        for _ in range(3 if k < 30 else 2):
            body = [" ".join(rng.choices(WORDS, k=8)) for _ in range(8)]
            body.insert(4, f"{name} {len(pages) + 100}")
            want.add((f"b_l2_{len(pages)}", 4))
            pages.append("\n".join([*body, f"- {len(pages)} -"]))
    rows = book(pages) + book([" ".join(WORDS) + "."] * 3, "c")
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, level int, next_id string, ingested_at timestamp")
    meta = spark.createDataFrame([(r[0], r[0].split("_")[0], T0) for r in rows], "chunk_id string, document_id string, ingested_at timestamp")
    p, _ = sc.scanned_pages(chunks, meta)
    got = {(r.chunk_id, i) for r in p.collect() for i in sc.furniture(r.content.split("\n"), list(r.heads)) if i < 8}
    assert got == want


def test_a_line_that_recurs_once_is_a_head_only_with_a_page_number():
    lines = ["the text goes on", "and on here", "Harbour counts", "the text goes on", "Harbour counts 82", "the text goes on", "and on here"]
    assert sc.furniture(lines, [sc.fold("Harbour counts") + "#"]) == {4}


def test_weights_decide(editor):
    """Without the perceptron's weights nothing is mended and nothing joined."""
    import copy

    bare = copy.deepcopy(editor)
    bare.model.weights, bare.line_ends.weights, bare.cache = {}, {}, {}
    rng = random.Random(7)
    cases = [(s, w) for w in WORDS * 4 if (s := spoil(w, rng)) != w]
    assert sum(editor.fix(s) == w for s, w in cases) >= 0.95 * len(cases)
    assert not any(bare.fix(s) for s, _ in cases) and bare.join("ware", "house") is None and bare.fix("4l2") is None


def test_words_beyond_the_vocabulary_sent_to_tasks_count_as_right(spark):
    clean = [" ".join(WORDS) + "." for _ in range(8)] + ["hcdger hcdger"] * 2
    pages = [f"The 1edger and hcdger were described.\n- {i} -" for i in range(6)]
    chunks = spark.createDataFrame(book(clean, "c") + book(pages), "chunk_id string, content string, level int, next_id string, ingested_at timestamp")
    meta = spark.createDataFrame([(f"{b}_l2_{i}", b, T0) for b, n in (("c", 10), ("b", 6)) for i in range(n)], "chunk_id string, document_id string, ingested_at timestamp")
    p, c = sc.scanned_pages(chunks, meta)
    e, right = sc.train(p, c, vocabulary=len(WORDS))
    shared = spark.sparkContext.broadcast(e)
    rows = sc.with_rare_words(p, right, shared).collect()
    assert len(rows) == 6 and all(set(r.known) >= {"hcdger"} and "ledger" not in r.known for r in rows)
    assert sc.faults(rows[0].content, [], None, False, e, frozenset(rows[0].known))[-1] != (0, "misread", "hcdger")


def scan_of(spark, clean, pages):
    chunks = spark.createDataFrame(book(clean, "c") + book(pages), "chunk_id string, content string, level int, next_id string, ingested_at timestamp")
    meta = spark.createDataFrame([(f"{b}_l2_{i}", b, T0) for b, n in (("c", len(clean)), ("b", len(pages))) for i in range(n)], "chunk_id string, document_id string, ingested_at timestamp")
    return sc.scanned_pages(chunks, meta)


def test_every_unknown_word_teaches(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=28)) for _ in range(750)]
    odd = {c: chr(0x3B1 + i) for i, c in enumerate("abcdefghijklmnop")} | {c: chr(0x430 + i) for i, c in enumerate("qrstuvwxyz")}
    spoiled = sorted({w[:i] + odd[w[i]] + w[i + 1 :] for w in words for i in range(28)})
    pages = [" ".join(spoiled[a : a + 500]) + f"\n- {a} -" for a in range(0, len(spoiled), 500)]
    e, _ = sc.train(*scan_of(spark, [" ".join(words)] * 5, pages))
    assert len(spoiled) == 21_000 and sum(e.confusions.values()) == 21_000


def test_training_in_parts_and_beyond_the_vocabulary_sent(spark, monkeypatch):
    """Words that the editor isn't sent teach confusions too, and parts of the words train one perceptron."""
    rng = random.Random(2)
    clean = [" ".join(WORDS * 250) + "."] * 8
    pages = [" ".join(spoil(rng.choice(WORDS), rng) for _ in range(60)) + f"\n- {i} -" for i in range(12)]
    p, c = scan_of(spark, clean, pages)
    whole, _ = sc.train(p, c)
    few, right = sc.train(p, c, vocabulary=8)
    assert few.confusions == whole.confusions and len(whole.confusions) > 4 and right is not None
    monkeypatch.setattr(sc, "PART", 10)
    parts, _ = sc.train(p, c)
    assert parts.confusions == whole.confusions
    cases = [(s, w) for w in WORDS * 4 if (s := spoil(w, rng)) != w]
    assert sum(parts.fix(s) == w for s, w in cases) >= 0.9 * len(cases) and parts.join("ware", "house") == "warehouse" and parts.join("first", "and") is None
