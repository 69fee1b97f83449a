import datetime as dt
import random
from fractions import Fraction
from itertools import combinations

import numpy as np

from foliant.llm import hashing
from foliant.llm import near_dups as nd

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "chunk_id string, content string, level int, ingested_at timestamp, `class` long, n int"
META = "chunk_id string, document_id string, ingested_at timestamp, content string"


def make(seed=1, families=16, size=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(25, 70))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(t))
                rng.choice([lambda: t.__setitem__(i, rng.choice(vocab)), lambda: t.insert(i, rng.choice(vocab)), lambda: t.pop(i)])()
            texts.append(" ".join(t))
    return texts


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    """rows: (chunk_id, text, document)."""
    s = {c: shingles(t) for c, t, _ in rows}
    doc = {c: d for c, _, d in rows}
    return {tuple(sorted((a, b))) for a, b in combinations(s, 2) if doc[a] != doc[b] and 5 * len(s[a] & s[b]) >= 3 * len(s[a] | s[b])}


def run(spark, rows, extra=(), meta_extra=(), limit=nd.EXPANDED):
    chunks = spark.createDataFrame([(c, t, 2, T0, 7, 1) for c, t, _ in rows] + list(extra), SCHEMA)
    meta = spark.createDataFrame([(c, d, T0, "clash") for c, _, d in rows] + list(meta_extra), META)
    members, links = nd.near_duplicates(chunks, meta)
    return {tuple(r) for r in nd.expand(members, links, limit).collect()}, members, links


def test_same_pairs_as_brute_force(spark):
    rows = [(f"c{i:03}", t, f"d{i % 7}") for i, t in enumerate(make())]
    want = brute(rows)
    got, _, _ = run(spark, rows)
    assert len(want) > 40 and got == want


def test_dirt_has_no_part(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [("a", base, "x"), ("b", base + " more", "y"), ("same", base, "x"), ("nodoc", base, None), ("short", "w1 w2 w3", "z")]
    extra = [("nometa", base, 2, T0, None, None), ("null", None, 2, T0, None, None), ("empty", "", 2, T0, None, None), ("parent", base, 1, T0, None, None), (None, base, 2, T0, None, None),
             ("b", base + " more", 2, T0, None, None), ("old", base, 2, T0, None, None), ("old", "now something else " + " ".join(f"q{i}" for i in range(30)), 2, T0 + dt.timedelta(1), None, None)]
    got, _, _ = run(spark, rows, extra, [(c, "m", T0, None) for c in ("null", "empty", "parent", "old")])
    assert got == {("a", "b"), ("b", "same")}


def test_empty_tables(spark):
    assert run(spark, [])[0] == set()


def test_many_copies_are_linked_not_multiplied(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:03}", base, f"d{i}") for i in range(60)] + [("x", base + " tail", "other")]
    got, members, links = run(spark, rows, limit=10)
    seen = {c for p in got for c in p}
    assert len(seen) == 61 and len(got) <= 2 * 61 and links.count() == 1 and members.count() == 61
    assert len(run(spark, rows[:9], limit=10)[0]) == 36


def test_very_long_text(spark):
    base = " ".join(f"w{i % 5000}x{i}" for i in range(30_000))
    assert run(spark, [("a", base, "x"), ("b", base + " end", "y")])[0] == {("a", "b")}


def test_word_hashes_match_a_plain_reading():
    texts = ["Ab c-d", "", None, "É9z Ab", "x" * 50, "K" + "C"]
    h, at = hashing.word_hashes(texts)
    import re

    words = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    of = {}
    for v, w in zip(h.tolist(), [w for ws in words for w in ws], strict=True):
        assert of.setdefault(w, v) == v
    assert len(set(of.values())) == len(of)


def test_tree_overlaps_match_sets():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(40)]
    q = [nd.pack40(lists[i]) for i in range(40) for _ in range(40)]
    o = [nd.pack40(lists[j]) for _ in range(40) for j in range(40)]
    got = nd.tree_overlaps(q, o, Fraction(3, 5)).reshape(40, 40)
    for i in range(40):
        for j in range(40):
            a, b = set(lists[i].tolist()), set(lists[j].tolist())
            assert got[i, j] == (len(a & b) if 5 * len(a & b) >= 3 * len(a | b) else 0)


def test_variants_share_paths_of_the_tree():
    """Twenty variants of a passage: most members of their lists are counted once for many of them."""
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(1 << 20, 200, replace=False)).astype(np.uint64) + np.uint64(1 << 39)  # common members
    lists = [nd.pack40(np.sort(np.concatenate([base[rng.permutation(200) > 0], rng.choice(1 << 20, 10, replace=False).astype(np.uint64)]))) for _ in range(20)]
    tally = {}
    got = nd.tree_overlaps([lists[0]] * 19, lists[1:], Fraction(3, 5), tally)
    assert (got > 150).all() and tally["nodes"] < 0.75 * tally["members"]


def test_trees_in_parts_and_long_lists(monkeypatch):
    rng = np.random.default_rng(5)
    lists = [nd.pack40(np.unique(rng.integers(0, 70, 100)).astype(np.uint64)) for _ in range(30)]
    q, o = [x for x in lists for _ in lists], lists * 30
    want = nd.tree_overlaps(q, o, Fraction(3, 5)).tolist()
    monkeypatch.setattr(nd, "CELLS", 100)
    assert nd.tree_overlaps(q, o, Fraction(3, 5)).tolist() == want and sum(map(bool, want)) > 30
    monkeypatch.setattr(nd, "LONG", 40)
    assert nd.tree_overlaps(q, o, Fraction(3, 5)).tolist() == want
    assert nd.tree_overlaps([], [], Fraction(3, 5)).tolist() == []


def test_frequent_members_are_spread():
    """Every two sets that post a member meet once, whatever its frequency."""
    n = 40
    packed = np.arange(n, dtype=np.int64) * 12345 + 7
    owner = np.arange(n)
    for rarity in (0, 8 * 14, 8 * 17, 255):
        token, own, pos, side = nd._spread(np.full(n, 99, np.uint32), np.full(n, rarity), packed, owner, owner * 2)
        rows = list(zip(token.tolist(), own.tolist(), side.tolist(), strict=True))
        met = [(a, b) for t, a, s in rows for u, b, r in rows if t == u and a < b and s * 3 + r in (0, 5)]
        assert sorted(met) == list(combinations(range(n), 2)) and (pos == own * 2).all()
        assert len(set(token.tolist())) == (1 if rarity < 8 * 15 else nd.PARTS if rarity == 255 else 8)
