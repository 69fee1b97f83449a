"""Problem 8: how many years of schooling each English text asks for.

Method: every sentence gets a distribution over levels of difficulty from a regularised linear model over its words,
the character runs inside them, and its length. A document's mean sentence level is then calibrated to years. There are
no labelled texts, so the model is fitted on a bounded sample of sentences labelled by the public Flesch-Kincaid formula,
each with its own length: long chains of easy clauses ask for more years than the same words in short sentences. The
model carries the formula over to words that it misjudges, because their neighbours and their parts are known.

A word contributes the same to every sentence, so its weights are computed once a task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import read_table
from foliant.llm.quality import COMMON

SAMPLE_DOCS, SAMPLE_SENTENCES = 2000, 8  # the model is fitted on so many documents, and so many whole sentences of each
BITS = 16  # of the hashed feature space
LONGEST = 96  # words from which sentences count as equally long; part of the model, not a cut of the text
PRIMARY, SPECIALIST = 5.0, 15.0
CUTS = (1.0, 3.0, PRIMARY, 7.0, 9.0, 11.0, 13.0, SPECIALIST, 18.0, 22.0)  # the formula's years that divide the levels of sentences
MIDDLES = np.array([0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 16.5, 20.0, 26.0])  # years that stand for each level
PROSE, ENGLISH = 0.5, 0.05  # least share of the text in whole sentences, and of function words
_EN = frozenset(COMMON["en"].split()) - {"and", "or"}
_OTHER = [frozenset(v.split()) - {"and", "a", "in", "an", "so", "also"} for k, v in COMMON.items() if k != "en"]
_WORD = re.compile(r"[a-z]+(?:['’][a-z]+)?")
_PARAGRAPH = re.compile(r"\n\s*\n|\n(?=\s*(?:#{1,6} |[QA]: |[-*+•] |\d+[.)] |\([a-z]\) ))|(?<=\n)(?=\|)")
_HEADING = re.compile(r"^[ \t]*#{1,6} .*$", re.M)
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+")
_VOWELS = re.compile(r"[aeiouy]+")


def syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    if n > 1 and word.endswith("e") and not word.endswith(("le", "ee")):
        n -= 1
    return max(1, n)


def sentences(text: str) -> Iterator[tuple[str, bool]]:
    """(lower-case sentence, whether it ends as one); headings are left out."""
    for par in _PARAGRAPH.split(_HEADING.sub("\n", text)):
        par = par.strip()
        for s in _SENTENCE.split(par):
            s = s.strip()
            if s:
                yield s.lower(), s.rstrip("\"'”’)")[-1:] in ".!?"


def features(word: str) -> list[int]:
    """Hashed places of the word itself, then of its character runs of 3 and 4, with its ends marked."""
    w = f"^{word}$"
    runs = {w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)}
    return [zlib.crc32(r.encode()) & ((1 << BITS) - 1) for r in (w, *sorted(runs))]


def length_features() -> np.ndarray:
    """A row for every length: its size, its logarithm, and soft steps along the way."""
    n = np.arange(LONGEST + 1)
    steps = 1 / (1 + np.exp(-(n[:, None] - np.arange(4, LONGEST, 4)) / 2))
    return np.column_stack([n / 20, np.log1p(n), steps])


def years_of(words: list[list[str]]) -> float:
    """Flesch-Kincaid years of sentences given as words (the formula's published constants)."""
    n = sum(map(len, words))
    return 0.39 * n / len(words) + 11.8 * sum(syllables(w) for s in words for w in s) / n - 15.59


class LevelModel:
    """Weights of every level by hashed feature and by length, and knots that turn a mean level into years."""

    def __init__(self, weights: np.ndarray, lengths: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.weights, self.lengths, self.knots, self.cache = weights, lengths, knots, {}

    def word(self, w: str) -> np.ndarray:
        v = self.cache.get(w)
        if v is None:
            if len(self.cache) > 200_000:  # bounds the memory of a task
                self.cache.clear()
            at = features(w)
            v = self.cache[w] = self.weights[at[1:]].mean(axis=0) + self.weights[at[0]]
        return v

    def levels(self, words: list[list[str]]) -> np.ndarray:
        """Distribution over the levels for each sentence."""
        n = np.array([len(s) for s in words])
        flat = np.array([self.word(w) for s in words for w in s])
        z = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None] + self.lengths[np.minimum(n, LONGEST)]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def years(self, level: float | np.ndarray) -> np.ndarray:
        return np.interp(level, *self.knots)


def fit(sample: list[list[list[str]]], rounds: int = 80, l2: float = 1e-5, rate: float = 0.3) -> LevelModel:
    """A model from documents as lists of sentences as lists of words. Without any, it calls everything middle."""
    flat, kinds = [s for d in sample for s in d], len(MIDDLES)
    shape = length_features()
    if not flat:
        return LevelModel(np.zeros((1 << BITS, kinds)), np.zeros((LONGEST + 1, kinds)), (np.array([0.0, 30.0]), np.array([9.0, 10.0])))
    label = np.searchsorted(CUTS, [years_of([s]) for s in flat])
    # a sentence is the mean of its words, a word the sum of its features: two sparse steps, the second over words only
    number = {w: i for i, w in enumerate(dict.fromkeys(w for s in flat for w in s))}
    own = [features(w) for w in number]
    places, f_of = np.array([p for f in own for p in f]), np.concatenate([[0], np.cumsum([len(f) for f in own])])
    f_weight = np.concatenate([[1.0, *[1.0 / (len(f) - 1)] * (len(f) - 1)] for f in own])
    f_word = np.repeat(np.arange(len(own)), np.diff(f_of))
    n = np.array([len(s) for s in flat])
    word, starts = np.array([number[w] for s in flat for w in s]), np.concatenate([[0], np.cumsum(n)[:-1]])
    row, long = np.repeat(np.arange(len(flat)), n), shape[np.minimum(n, LONGEST)]
    used, slot = np.unique(places, return_inverse=True)
    theta = np.zeros((len(used) + shape.shape[1], kinds))
    goal = np.eye(kinds)[label]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        by_word = np.add.reduceat(theta[slot] * f_weight[:, None], f_of[:-1], axis=0)
        z = np.add.reduceat(by_word[word], starts, axis=0) / n[:, None] + long @ theta[len(used) :]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        err = (z / z.sum(axis=1, keepdims=True) - goal) / len(flat)
        back = err / n[:, None]
        g = np.empty_like(theta)
        for c in range(kinds):
            to_word = np.bincount(word, back[row, c], minlength=len(own))
            g[: len(used), c] = np.bincount(slot, to_word[f_word] * f_weight, minlength=len(used))
        g[len(used) :] = long.T @ err
        g += l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros((1 << BITS, kinds))
    weights[used] = theta[: len(used)]
    model = LevelModel(weights, shape @ theta[len(used) :], (MIDDLES[[0, -1]], MIDDLES[[0, -1]]))
    docs = [d for d in sample if d]
    level = np.array([mean_level(model.levels(d)) for d in docs])
    years = np.array([years_of(d) for d in docs])
    # calibration: medians of the formula's years over bins of the mean level, made non-decreasing
    edges = np.linspace(0, MIDDLES[-1], 53)
    at = np.digitize(level, edges)
    knots = [(np.median(level[at == b]), np.median(years[at == b])) for b in np.unique(at)]
    x, y = (np.array(k) for k in zip(*knots, strict=True))
    model.knots = (x, np.maximum.accumulate(y))
    return model


def mean_level(p: np.ndarray) -> float:
    """The mean of the years that stand for the levels, over the sentences' distributions."""
    return float((p @ MIDDLES).mean())


def _parse(text: str) -> tuple[list[list[str]], float, float]:
    """(words by sentence, share of the text in whole sentences, share of English function words or 0 for other languages)."""
    out, whole, size, low = [], 0, 0, []
    for s, ended in sentences(text):
        words = _WORD.findall(s)
        size += len(s)
        letters = sum(map(len, words))
        if ended and len(words) >= 3 and letters >= 0.55 * len(s):
            whole += len(s)
        if words and letters >= 0.5 * len(s):
            out.append(words)
        low.extend(words)
    n = len(low) or 1
    english = sum(map(_EN.__contains__, low)) / n
    if max(sum(map(o.__contains__, low)) for o in _OTHER) / n > max(0.15, english):
        english = 0.0
    return out, whole / (size or 1), english


def fit_on(documents: DataFrame, docs: int = SAMPLE_DOCS, per_doc: int = SAMPLE_SENTENCES) -> LevelModel:
    """A model fitted on a bounded sample: the ``docs`` documents of smallest hash, ``per_doc`` evenly spaced sentences of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, t in pdf.itertuples(index=False):
                words, whole, english = _parse(t)
                if whole >= PROSE and english >= ENGLISH and words:
                    rows.append((h, [" ".join(words[i]) for i in sorted({int(i) for i in np.linspace(0, len(words) - 1, per_doc)})]))
            yield pd.DataFrame(rows, columns=["h", "s"])

    some = documents.where("text IS NOT NULL").select(F.xxhash64("text").alias("h"), "text")
    total = documents.count()
    share = min(1.0, 2.0 * docs / max(total, 1))
    some = some.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)  # read what the sample needs, not all
    got = some.mapInPandas(run, "h long, s array<string>").orderBy("h").limit(docs).toPandas()
    return fit([[s.split() for s in d] for d in got["s"]])


def reading_levels(documents: DataFrame, model: LevelModel | None = None) -> DataFrame:
    """(doc_id, years, primary, middle, specialist, sentences, english_prose), one row a document row.

    The three shares are those of the sentences that ask for at most 5, for 5 to 15 and for 15 years or more. years is
    null for texts without words. Null and empty texts aren't prose. Other columns are ignored. Without a ``model``, one
    is fitted on a bounded sample.
    """
    model = model or fit_on(documents)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.lengths, model.knots))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    low, high = CUTS.index(PRIMARY) + 1, CUTS.index(SPECIALIST) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LevelModel(*shared.value)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                words, whole, english = _parse(t) if isinstance(t, str) else ([], 0.0, 0.0)
                if not words:
                    rows.append((None, None, None, None, 0, False))
                    continue
                p = m.levels(words)
                share = p.mean(axis=0)
                rows.append((float(m.years(mean_level(p))), float(share[:low].sum()), float(share[low:high].sum()), float(share[high:].sum()), len(words), whole >= PROSE and english >= ENGLISH))
            out = pd.DataFrame(rows, columns=["years", "primary", "middle", "specialist", "sentences", "english_prose"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, years double, primary double, middle double, specialist double, sentences long, english_prose boolean")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("years") <= PRIMARY, "primary").when(F.col("years") >= SPECIALIST, "specialist")
    return p8_levels(spark, sf_dir).where("english_prose").select("doc_id", band.alias("band")).where("band IS NOT NULL")
