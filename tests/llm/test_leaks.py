import random
import re

import pytest

from foliant.llm import leaks as lk

W = re.compile("[a-z0-9]+")


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = W.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = W.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("block", [1 << 20, 37])
def test_same_links_as_brute_force(spark, block):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(5, 40)))) for i in range(12)] + [(20, None), (21, "")]
    docs = []
    for d in range(60):
        t = text(80)
        src = items[rng.randrange(12)][1].split()
        k = rng.choice([10, 11, 12, 13, 30])
        a = rng.randrange(max(1, len(src) - k + 1))
        docs.append((d, " , ".join(t[:30] + src[a : a + k] + t[30:]).title()))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1] + " x " + items[2][1])]
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, item_id int, window string")
    it = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in lk.leaked_items(df, it, block_windows=block).collect()}
    assert got == brute(docs, items) and len(got) > 20


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    it = spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    assert lk.leaked_items(df.limit(0), it).count() == 0 and lk.leaked_items(df, it.limit(0)).count() == 0
    assert lk.leaked_items(df, it).count() == 1
