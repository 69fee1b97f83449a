"""Extractive summaries, keywords and concepts without an external service, and hooks for services.

A provider is a function from a list of texts to a list of results; it runs on Arrow batches in the executors, so
its concurrency is the number of partitions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import formatted_terms

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Words that don't make keywords (fixed values).
STOP = frozenset("a an and are as at be but by can do for from has have how i if in into is it its many more most much no not of on one or our she so some such than that the their then there these they this to two up was we were what when which while who will with you your".split())


def central_sentences(text: str, n: int = 3, damping: float = 0.85, rounds: int = 30) -> str:
    """The n sentences that share most words with the others (a random walk over that graph), in their own order."""
    s = [x.strip() for x in _SENTENCE.split(text.strip()) if x.strip()]
    if len(s) <= n:
        return " ".join(s)
    bags = [set(w.lower() for w in _WORD.findall(x)) - STOP for x in s]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*bags)))}
    # words of all sentences in one row, so that memory grows with the text and not with its square
    at = np.array([vocabulary[w] for b in bags for w in sorted(b)], np.int64)
    many = np.array([len(b) for b in bags])
    owner = np.repeat(np.arange(len(s)), many)
    size = np.log(np.maximum(many, 1)) + 1

    def shared(v: np.ndarray) -> np.ndarray:
        """Sum over the other sentences of v times the words in common, divided by both sizes; few sizes differ."""
        out = np.zeros(len(s))
        for c in np.unique(size):
            words = np.bincount(at, np.where(size == c, v, 0)[owner], minlength=len(vocabulary) or 1)
            out += np.bincount(owner, words[at], minlength=len(s)) / (c + size)
        return out - v * many / (2 * size)

    total = np.maximum(shared(np.ones(len(s))), 1e-12)
    rank = np.full(len(s), 1 / len(s))
    for _ in range(rounds):
        rank = (1 - damping) / len(s) + damping * shared(rank / total)
    best = sorted(np.lexsort((np.arange(len(s)), -np.round(rank, 12)))[:n])
    return " ".join(s[i] for i in best)


def keywords(text: str, n: int = 5, most_words: int = 3) -> list[tuple[str, float]]:
    """(phrase, score), smaller is better: frequent, early phrases of words that stand in few other contexts."""
    count: Counter = Counter()
    first: dict[str, int] = {}
    total = 0
    for x in _SENTENCE.split(text):
        words = [w.lower() for w in _WORD.findall(x)]
        for i in range(len(words)):
            for k in range(1, most_words + 1):
                p = words[i : i + k]
                if len(p) == k and p[0] not in STOP and p[-1] not in STOP and min(map(len, p)) > 1 and len(p[-1]) > 2:
                    count[" ".join(p)] += 1
                    first.setdefault(" ".join(p), total + i)
        total += len(words)
    score = {p: (1 + first[p] / (total + 1)) / (c * (1 + 0.5 * p.count(" ")) * (1.5 if c > 1 and " " in p else 1)) for p, c in count.items()}
    return sorted(score.items(), key=lambda x: (x[1], x[0]))[:n]


def _central(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([central_sentences(t, int(k)) if isinstance(t, str) else None for t, k in zip(text, n, strict=True)])


def _keywords(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([[{"keyword": k, "score": s} for k, s in keywords(t, int(m))] if isinstance(t, str) else [] for t, m in zip(text, n, strict=True)])


def summary_column(c: Column | str, sentences: int = 3) -> Column:
    return F.pandas_udf(_central, "string")(c, F.lit(sentences))


def keyword_column(c: Column | str, most: int = 5) -> Column:
    return F.pandas_udf(_keywords, "array<struct<keyword:string,score:double>>")(c, F.lit(most))


def mentions(chunks: DataFrame, most: int = 5) -> DataFrame:
    """Concept mentions of chunks without a model: keywords and formatted terms as terms; input of concepts.aggregate."""
    from foliant.functions.text import singular_slug

    names = F.array_distinct(F.concat(F.transform(keyword_column("content", most), lambda k: k["keyword"]), formatted_terms("content")))
    rows = chunks.select("chunk_id", F.coalesce("sequence_position", F.lit(0)).cast("long").alias("ord"), F.explode(names).alias("name"))
    return rows.select(singular_slug("name").alias("concept_id"), "ord", "name", F.lit("term").alias("concept_type"), F.lit("").alias("definition"), F.array().cast("array<string>").alias("aliases"), F.col("chunk_id").alias("occurrence"))


def apply_provider(df: DataFrame, column: str, out: str, out_type: str, provider: Callable[[Sequence[str]], Sequence], batch: int = 32, blank=None) -> DataFrame:
    """``df`` with a provider's result for each text, in batches; blank and null texts get ``blank`` without a call."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{out}` {out_type}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[column].tolist()
            full = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            got: list = [blank] * len(texts)
            for a in range(0, len(full), batch):
                part = full[a : a + batch]
                for i, v in zip(part, provider([texts[i] for i in part]), strict=True):
                    got[i] = v
            yield pdf.assign(**{out: pd.Series(got, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, schema)
