import numpy as np
import pytest

from foliant.llm import quality as q

PROSE = "The clerk counts the goods in the store, and the store keeps them dry. It is a large room."
WRAPPED = "The clerk counts the goods in\nthe store, and the store keeps\nthem dry. It is a large room\nwith windows to the north."
GERMAN = "Der Bestand wird in jeder Woche geprüft, und die Planung zeigt den Bericht."
LIST = "\n".join(f"• Item number {w}" for w in "one two three four five six seven".split())
INDEX = "\n".join(f"old stock systems, {i}, {i + 4}–{i + 8}" for i in range(8))
CONTENTS = "\n".join(f"1.{i} Standard rent processes ............. {i + 9}" for i in range(8))
TABLE = "\n".join(["| a | b |", "|---|---|", *(f"| cell {i} | {i} |" for i in range(8))])
TABS = "\n".join(f"row {i}\t{i * 7}\t{i * 9}.5" for i in range(8))
SYMBOLS = "&:] %%{ !@:^&%^[[%@~<{ [;}=#@! $;:={; ;>[^^@\n" * 5
REPEATED = "meter wage " * 60
INVENTED = "qxwz vbnk plrtz ghjk mnbvc xcvb qwrt zxcv bnmk lkjh gfds\n" * 6


@pytest.mark.parametrize(("text", "kind"), [(PROSE, "prose"), (WRAPPED, "prose"), (GERMAN, "prose"), (PROSE + "\n\n" + LIST[:40], "prose"), (LIST, "list"), (INDEX, "list"), (CONTENTS, "list"), (TABLE, "table"), (TABS, "table"), (SYMBOLS, "junk"), (REPEATED, "junk"), (INVENTED, "junk")])
def test_kinds_of_text(text, kind):
    m = dict(zip(q.FIELDS, q._measure(text)[1:], strict=True))
    assert max(("list", "table", "junk", "prose"), key=lambda k: m[f"{k}_share"]) == kind


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, language string, outlier_score double")


def test_outliers_are_found(spark):
    texts = [PROSE + f" It has {i} doors." for i in range(60)] + [LIST, TABLE, SYMBOLS, None, "", LIST]
    got = {(r.doc_id, r.kind) for r in q.kinds(q.text_statistics(frame(spark, texts))).collect()}
    assert got == {(60, "list"), (61, "table"), (62, "junk"), (65, "list")}


def test_a_third_of_the_rows_may_be_lists(spark):
    texts = [PROSE] * 20 + [LIST] * 10
    assert {r.doc_id for r in q.kinds(q.text_statistics(frame(spark, texts))).collect()} == set(range(20, 30))


GERMAN_LIST = "\n".join(f"• {x} und {y}" for x, y in (("Bestand", "Planung"), ("Bericht", "Woche"), ("Lager", "Halle"), ("Rohre", "Ventile"), ("Kisten", "Paletten")))


def test_a_text_is_found_however_frequent_its_like_in_its_language(spark):
    texts = [PROSE] * 60 + [GERMAN] * 3 + [GERMAN_LIST] * 10
    stats = q.text_statistics(frame(spark, texts))
    assert {r.language for r in stats.where("doc_id >= 60").collect()} == {"de"}
    assert {(r.doc_id, r.kind) for r in q.kinds(stats).collect()} == {(i, "list") for i in range(63, 73)}


def test_the_only_text_of_its_language_is_found(spark):
    texts = [PROSE] * 5 + [GERMAN_LIST]
    assert [(r.doc_id, r.kind) for r in q.kinds(q.text_statistics(frame(spark, texts))).collect()] == [(5, "list")]


def test_empty_table(spark):
    assert q.kinds(q.text_statistics(frame(spark, ["x"]).limit(0))).count() == 0


def test_tails_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(str(lang), float(v), float(c)) for lang, v, c in zip(rng.choice(["en", "de"], 500), rng.integers(0, 40, 500) / 8, rng.integers(0, 4, 500) / 8, strict=True)] + [(None, 1.0, 0.5), ("fr", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "language string, list_share double, telling_word_share double").repartition(7)
    texts = {r for r in rows if r[0] and r[2] >= q.REFERENCE}  # different ones, with enough function words
    for side in (1, -1):
        got = {(r.language, r.value): (r.tail, r.size, r.n) for r in q.tail_probabilities(df, {"list_share": side}).collect()}
        assert {k for k, _ in got} == {"en", "de", ""}  # fr has no reference
        for lang in ("en", "de", ""):
            x = np.array(sorted(v for k, v, _ in texts if k == lang or lang == ""))
            for v in {v for k, v, _ in rows if k == lang or lang == ""}:
                far = (x >= v).sum() if side == 1 else (x <= v).sum()
                assert got[lang, v] == (pytest.approx((far + 1) / (len(x) + 1)), len(x), sum(r[1] == v and (r[0] == lang or lang == "") for r in rows))


def test_the_score_decides(spark):
    """Without it, prose with a small list would be a case; with it, the share of lines only names the kind."""
    mixed = (PROSE + " ") * 3 + "\n\n" + LIST
    stats = q.text_statistics(frame(spark, [PROSE + f" It has {i} doors." for i in range(60)] + [mixed, LIST]))
    row = stats.where("doc_id = 60").collect()[0]
    assert row.list_share + row.table_share + row.junk_share > q.NAMED
    assert [r.doc_id for r in q.kinds(stats).collect()] == [61]


def test_no_reference(spark):
    assert {r.doc_id for r in q.kinds(q.text_statistics(frame(spark, [LIST, TABLE, "", None]))).collect()} == {0, 1}
