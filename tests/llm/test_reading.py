import random

import pytest

from foliant.llm import reading as rd

POOLS = {
    "easy": ("The {} sees the {} by the {}.", "dog cat hat box cup boy girl bed toy car bus pen map egg jar bag fox hen net tin pot lid key log pig".split()),
    "middle": ("Most {} compare the {} before the {} closes.", "managers ledger quarter factory supplier auditor inventory report market invoice contract carrier budget shipment customer department statement payment recorder measure".split()),
    "hard": ("The {} presupposes {} and legitimises {}.", "rationalisation accountability heterogeneity capitalisation complementarity disaggregation verification intermediation reconciliation securitisation multidimensionality profitability standardisation counterfactuality interdependence jurisdictionality institutionalisation epistemological determinacy elasticity".split()),
}


def texts(kind, n, seed, held_out=False):
    """Texts of 8 sentences; the last third of a pool's words stands only in held-out ones."""
    rng = random.Random(seed)
    pattern, words = POOLS[kind]
    cut = len(words) * 2 // 3
    pool = words[cut:] if held_out else words[:cut]
    return [" ".join(pattern.format(*(rng.choice(pool) for _ in range(pattern.count("{}")))) for _ in range(8)) for _ in range(n)]


def chained(n, seed, held_out=False):
    """Easy texts whose sentences are strung together with "and", four at a time."""
    for t in texts("easy", n, seed, held_out):
        parts = t.rstrip(".").split(". ")
        yield " ".join(" and ".join(parts[i : i + 4]) + "." for i in range(0, len(parts), 4))


@pytest.fixture(scope="module")
def model():
    docs = texts("easy", 40, 1) + texts("middle", 60, 2) + texts("hard", 40, 3) + list(chained(30, 10))
    return rd.fit([[rd._WORD.findall(s) for s, _ in rd.sentences(t)] for t in docs])


def years(model, text):
    words, _, _ = rd._parse(text)
    return float(model.years(rd.mean_level(model.levels(words))))


def test_held_out_words(model):
    right = [years(model, t) <= 5 for t in texts("easy", 20, 4, True)] + [5 < years(model, t) < 15 for t in texts("middle", 20, 5, True)] + [years(model, t) >= 15 for t in texts("hard", 20, 6, True)]
    assert sum(right) / len(right) >= 0.9


def test_length_counts(model):
    """Held-out chains of easy clauses are no longer for first readers, as the formula says of them."""
    for t in chained(20, 7, held_out=True):
        words, _, _ = rd._parse(t)
        assert rd.years_of(words) > 6 and years(model, t) > 5
    assert all(years(model, t) <= 5 for t in texts("easy", 20, 11, held_out=True))


def test_levels_are_distributions(model):
    p = model.levels([["the", "dog", "sees"], ["capitalisation"] * 300, ["x"]])
    assert p.shape == (3, len(rd.MIDDLES)) and abs(p.sum(axis=1) - 1).max() < 1e-9
    assert rd.fit([]).years(12.0) >= 9


def test_rows(spark, model):
    rows = [(1, texts("easy", 1, 8)[0].replace(". ", ".\n\n")), (2, texts("hard", 1, 9)[0]), (3, None), (4, ""), (5, "a, 1\nb, 2"), (6, "Der Bestand wird in jeder Woche geprüft, und die Planung zeigt den Bericht.")]
    df = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, years double")
    got = {r.doc_id: r for r in rd.reading_levels(df, model).collect()}
    assert got[1].english_prose and got[1].years <= 5 and got[2].english_prose and got[2].years >= 15
    assert not any(got[i].english_prose for i in (3, 4, 5, 6)) and got[3].years is None
    assert rd.reading_levels(df.limit(0), model).count() == 0 and rd.reading_levels(df.limit(0)).count() == 0


def test_headings_and_wrapping_are_no_text():
    s = [x for x, _ in rd.sentences("# Title words\nOne line\nwraps here. Two!\n\nQ: Three?")]
    assert s == ["one line\nwraps here.", "two!", "q: three?"]
