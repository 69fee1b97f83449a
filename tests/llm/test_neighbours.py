import datetime as dt
import time
from pathlib import Path

import numpy as np

from foliant.llm import neighbours as nb

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "chunk_id string, embedding array<double>, embedded_at timestamp, similarity double, class string"


def table(spark, rows):
    return spark.createDataFrame([(c, v, t, 0.5, "clash") for c, v, t in rows], SCHEMA)


def clusters(n=60, size=6, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n, nb.DIM))
    return np.concatenate([c + rng.uniform(0.2, 0.45) * rng.standard_normal((size, nb.DIM)) for c in centre])


def found(spark, df, **kw):
    return {tuple(sorted((r.chunk_id, r.other_id))) for r in nb.nearest(*nb.similar_vectors(df, **kw)).collect()}


def test_recall_and_precision_against_brute_force(spark):
    x = clusters()
    ids = [f"c{i:04}" for i in range(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.8}
    got = found(spark, table(spark, [(i, v.tolist(), T0) for i, v in zip(ids, x, strict=True)]), file=8)
    assert len(want) > 300 and len(got & want) / len(want) >= 0.97 and not got - want


def test_unusable_superseded_and_repeated_rows(spark):
    v = np.random.default_rng(1).standard_normal(nb.DIM).tolist()
    bad = [None, [0.0] * nb.DIM, [float("nan"), *v[1:]], [None, *v[1:]], v[:10]]
    rows = [("a", v, T0), ("a", v, T0), ("b", [2 * y for y in v], T0), (None, v, T0), ("gone", v, T0), ("gone", None, T0 + dt.timedelta(1)), ("back", None, T0), ("back", v, T0 + dt.timedelta(1))]
    rows += [(f"bad{i}", y, T0) for i, y in enumerate(bad)]
    assert found(spark, table(spark, rows)) == {("a", "b"), ("a", "back"), ("b", "back")}


def test_empty_table(spark):
    assert found(spark, table(spark, [])) == set()


def test_copies_are_bounded(spark):
    v = np.random.default_rng(1).standard_normal(nb.DIM).tolist()
    out = nb.nearest(*nb.similar_vectors(table(spark, [(f"c{i:03}", v, T0) for i in range(50)]))).collect()
    assert len(out) == 250 and {r.other_id for r in out} == {f"c{i:03}" for i in range(6)}


def test_five_bits_keep_the_cosine():
    x = clusters(5)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    y = nb.unpack5(nb.pack5(x), nb.DIM)
    assert np.abs(x @ x.T - y @ y.T).max() < 0.02
    odd = x[:, :10]
    assert nb.unpack5(nb.pack5(odd), 10).shape == odd.shape and nb.pack5(x[:0]).shape == (0, 256)


def test_blocks_of_a_file_give_the_same_pairs():
    x = clusters(8)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    whole = set(zip(*map(list, nb.compare_blocks(x, 0, 0.8, 1000)), strict=True))
    half = len(x) // 2
    parts = {(i, j) for i, j in zip(*nb.compare_blocks(x, half, 0.8, 1000), strict=True)}
    for a, b in ((0, half), (half, len(x))):
        parts |= {(i + a, j + a) for i, j in zip(*nb.compare_blocks(x[a:b], 0, 0.8, 1000), strict=True)}
    assert whole == parts and whole


def dense(n, cosine, seed=0, spike=0.0):
    """``n`` unit vectors of about the same mutual cosine, the first coordinate so many times the root mean square."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(nb.DIM)
    centre[0] = spike or centre[0]
    x = np.sqrt(cosine) * centre / np.linalg.norm(centre) + np.sqrt((1 - cosine) / nb.DIM) * rng.standard_normal((n, nb.DIM))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def pairs_by_force(x, least=0.8, k=5):
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {(min(i, j), max(i, j)) for i in range(len(x)) for j in top[i].tolist() if s[i, j] >= least}


def test_rounding_loses_no_pair_of_a_file():
    for x in (dense(400, 0.99), dense(400, 0.95), dense(400, 0.8, spike=10.0), dense(400, 0.8, spike=40.0)):
        y = nb.unpack5(nb.pack5(x), nb.DIM)
        i, j = nb.compare_blocks(y, 0, 0.8, 5, nb.turned(x, y) * nb.ANGLE)
        assert pairs_by_force(x) <= set(zip(i.tolist(), j.tolist(), strict=True))
        assert nb.compare_blocks(y, 0, 0.8, 5, nb.turned(x, y) * nb.ANGLE, 10) is None


def test_nearest_within_a_file_in_blocks():
    x = dense(700, 0.95).astype(np.float64)
    i, j, s = nb.nearest_within(x, 0, 0.8, 5)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == pairs_by_force(x) and np.allclose(s, (x[i] * x[j]).sum(axis=1))
    i, j, _ = nb.nearest_within(x, 300, 0.8, 5)
    c = x[:300] @ x[300:].T
    want = {(a, int(b) + 300) for a in range(300) for b in np.argsort(-c[a])[:5] if c[a, b] >= 0.8} | {(int(a), b + 300) for b in range(400) for a in np.argsort(-c[:, b])[:5] if c[a, b] >= 0.8}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert len(nb.nearest_within(np.tile(x[:1], (300, 1)), 0, 0.8, 5)[0]) <= 1500


def test_dense_group_is_found_whole(spark, monkeypatch):
    x = dense(300, 0.99)
    df = table(spark, [(f"c{i:03}", v.tolist(), T0) for i, v in enumerate(x)])
    want = {(f"c{i:03}", f"c{j:03}") for i, j in pairs_by_force(x)}
    assert len(found(spark, df, posted=16) & want) >= 0.995 * len(want)  # every vector is in every file
    monkeypatch.setattr(nb, "BLOCK", 100)
    assert len(found(spark, df, posted=16) & want) >= 0.995 * len(want)


def topics(topic=12, groups=25, size=6, seed=4):
    """Topics whose vectors have cosines of about 0.4, and in them groups of near ones."""
    rng = np.random.default_rng(seed)
    c, g = rng.standard_normal((topic, 1, 1, nb.DIM)), rng.standard_normal((topic, groups, 1, nb.DIM))
    x = 0.63 * c + 0.7 * g + 0.3 * rng.standard_normal((topic, groups, size, nb.DIM))
    x = x.reshape(-1, nb.DIM)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_footrule_is_that_of_the_orders():
    o, _ = nb.in_common(topics()[:40])
    place = np.full((40, nb.DIRECTIONS), nb.ORDER)
    np.put_along_axis(place, o.astype(int), np.arange(nb.ORDER)[None], 1)
    distance = np.abs(place[:, None] - place[None]).sum(axis=2)
    assert (distance == nb.ORDER * (nb.ORDER + 1) - 2 * nb.shared_weights(o, o).astype(int)).all()


def test_footrule_prunes_and_keeps():
    """It drops most pairs of a file of one topic or several, and hardly any that is near enough."""
    for x in (topics(1, 200), topics()):
        s = x @ x.T
        want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.8), strict=True) if i < j}
        tally = {}
        got = set(zip(*nb.compare_blocks(x, 0, 0.8, 1000, None, None, tally), strict=True))
        assert len(want) > 2000 and got <= want and len(got) >= 0.99 * len(want)
        assert tally["compared"] == len(x) * (len(x) - 1) // 2 and tally["passed"] < 0.2 * tally["compared"]


def test_grouped_pivots_find_the_nearest():
    x = topics()
    near, all_of_them = nb.Pivots(x[::2], searched=64).nearest(x, 3), nb.Pivots(x[::2]).nearest(x, 3)
    assert (near[:, 0] == all_of_them[:, 0]).mean() > 0.95 and (near == all_of_them).mean() > 0.9


def test_postings_do_not_grow_with_the_data():
    for size in (10, 1e5, 1e7, 1e9, 1e12):
        blocks, depth = nb.divisions(np.array([size]))
        assert 1 <= blocks[0] <= nb.MOST_BLOCKS and depth[0] == (0 if size < 5e4 else 1 if size < 1.1e6 else 2)


def test_divided_files_and_grouped_pivots(spark, monkeypatch):
    x = topics()
    ids = [f"c{i:04}" for i in range(len(x))]
    want = {(ids[i], ids[j]) for i, j in pairs_by_force(x)}
    df = table(spark, [(i, v.tolist(), T0) for i, v in zip(ids, x, strict=True)])
    for name, value in (("BLOCK", 40), ("MOST_BLOCKS", 2), ("SEARCHED", 16)):
        monkeypatch.setattr(nb, name, value)
    assert nb.divisions(np.array([300.0, 3000.0]))[1].tolist() == [1, 2]
    got = found(spark, df, file=64)
    assert len(want) > 4000 and len(got & want) >= 0.95 * len(want)


def test_postings_grow_with_the_pivots():
    """Pairs with a cosine of 0.86 meet in a file among many pivots too, where three postings part many of them."""
    rng = np.random.default_rng(6)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    centre = rng.standard_normal((10, nb.DIM))
    drawn = lambda n: unit(0.6 * centre[rng.integers(10, size=n)] + 0.8 * rng.standard_normal((n, nb.DIM)))
    x = drawn(1000)
    y = unit(x + 0.6 * unit(rng.standard_normal(x.shape)))
    needed = []
    for n in (200, 6000):
        pivots = nb.Pivots(drawn(n))
        m = nb.postings(pivots, drawn(600), 0.8)
        share = [(pivots.nearest(x, k)[:, :, None] == pivots.nearest(y, k)[:, None, :]).any(axis=(1, 2)).mean() for k in (m, nb.FEWEST)]
        needed.append(m)
        assert share[0] >= 0.96 and (n < 1000 or share[1] < 0.9)
    assert nb.FEWEST <= needed[0] < needed[1] <= nb.MOST_POSTED


def test_short_codes_lose_no_pair_of_a_file(spark):
    for x in (dense(400, 0.95), dense(400, 0.8, spike=40.0), topics(2)):
        y, turned = nb.unpack3(nb.pack3(x), nb.DIM), x @ nb.rotation(nb.DIM)
        turn = nb.turned(turned, y) * nb.ANGLE
        i, j = nb.compare_blocks(y, 0, 0.8, 5, turn)
        want = pairs_by_force(x)
        assert turn.max() < 0.3 and len(want & set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.997 * len(want)
    x = topics(2)
    want = {(f"c{i:03}", f"c{j:03}") for i, j in pairs_by_force(x)}
    got = found(spark, table(spark, [(f"c{i:03}", v.tolist(), T0) for i, v in enumerate(x)]), posted=nb.LONG_CODES + 8)
    assert len(got & want) >= 0.99 * len(want)


def test_regions_hold_every_posting():
    x = topics(groups=150, size=1)
    pivots, size = nb.Pivots(x[::10]), np.linspace(1, 50, len(x[::10]))
    region = nb.regions(pivots.pivots, size, 400)
    held = np.bincount(region, weights=size)
    assert (held <= 400).all() and size.sum() / 400 <= len(held) < 3 * size.sum() / 400
    same = nb.regions(np.tile(x[:1], (50, 1)), np.full(50, 100.0), 150)
    assert len(set(same.tolist())) == 50  # files that are too long together stand alone
    region[:5] = -1
    files = pivots.nearest(x, 8)
    row, of, held = nb.by_region(files, region)
    assert len(row) < 0.6 * files.size and len(set(zip(row.tolist(), of.tolist(), strict=True))) == len(row)
    got = [(int(of[at]), f, int(row[at])) for r in np.unique(of) for own in [np.flatnonzero(of == r)] for f, rows in nb.files_within(held.take(nb.pa.array(own))) for at in own[rows]]
    want = {(int(region[f]), f, i) for i, fs in enumerate(files.tolist()) for f in fs if f >= 5}
    assert len(got) == len(want) and set(got) == want
    none = nb.by_region(files[:0], region)
    assert [len(z) for z in none] == [0, 0, 0]


def shuffled(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {p: p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_a_code_is_sent_once_a_region(spark, monkeypatch):
    """Of 8 postings a vector, most stand in few regions; nothing is near enough to be reranked."""
    x = topics(groups=150, size=1)
    df = table(spark, [(f"c{i:04}", v.tolist(), T0) for i, v in enumerate(x)])
    before, sizes, tidy = shuffled(spark), [], nb._tidy
    monkeypatch.setattr(nb, "_filter", lambda c, f=nb._filter: (sizes.append(sum(v for p, v in shuffled(spark).items() if p not in before)), f(c))[1])
    nb.similar_vectors(df, file=16, posted=8)
    assert len(sizes) == 2 and 100_000 < sizes[1] < 0.75 * len(x) * 8 * 258
    gone = []

    def tidied(s):
        own = [p for p in shuffled(s) if p not in before]
        most = max(own, key=lambda p: p.stat().st_size)
        tidy(s)
        for _ in range(50):
            if most.exists():
                time.sleep(0.1)
        gone.append(not most.exists())

    monkeypatch.setattr(nb, "_tidy", tidied)
    monkeypatch.setattr(nb, "REGION", 1000)
    nb.similar_vectors(df, file=16, posted=8)
    assert gone == [True]


def test_regions_change_no_result(spark, monkeypatch):
    x = topics()
    df = table(spark, [(f"c{i:04}", v.tolist(), T0) for i, v in enumerate(x)])
    want = {(f"c{i:04}", f"c{j:04}") for i, j in pairs_by_force(x)}
    got = []
    for parts in (0.1, 1000):
        monkeypatch.setattr(nb, "REGIONS", parts)
        got.append(found(spark, df, file=32, posted=4))
    assert got[0] == got[1] and len(got[0] & want) >= 0.97 * len(want)
