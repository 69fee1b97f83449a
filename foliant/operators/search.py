"""Retrieval: filtered semantic top-k, keyword, BM25, diversity and concept search."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.vectors import cosine

#: Parameters of BM25 and of the diversity trade-off; both are choices of this engine.
K1, B, LAMBDA = 1.2, 0.75, 0.5


def chunk_filter(
    doc_id: str | None = None, level: int | None = None, semantic_type: str | None = None, header_level: int | None = None, has_table: bool | None = None,
    has_code: bool | None = None, has_math: bool | None = None, has_image: bool | None = None,
) -> Column:
    """Conjunction of the conditions that are given; None leaves a column alone."""
    cond = F.lit(True)
    for name, want in (("document_id", doc_id), ("level", level), ("semantic_type", semantic_type), ("header_level", header_level)):
        if want is not None:
            cond &= F.col(name) == want
    for name, flag in (("has_table", has_table), ("has_code", has_code), ("has_math", has_math), ("has_image", has_image)):
        if flag is not None:
            cond &= F.coalesce(F.col(name), F.lit(False)) == flag
    return cond


def with_all_tags(documents: DataFrame, tags: Sequence[str], column: str = "tag_list") -> DataFrame:
    """Documents that carry every one of the tags."""
    want = F.array(*[F.lit(t) for t in tags]) if tags else F.array().cast("array<string>")
    return documents.where(F.size(F.array_except(want, F.coalesce(F.col(column), F.array().cast("array<string>")))) == 0)


def search_similar(vectors: DataFrame, query: Sequence[float], k: int = 5, threshold: float | None = 0.0, condition: Column | None = None, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k rows of highest cosine, ties by key. The condition filters before the ranking, so k rows come back if
    there are as many; ``threshold`` None keeps all. TakeOrderedAndProject keeps k rows a task, nothing is shuffled."""
    df = vectors if condition is None else vectors.where(condition)
    df = df.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).where(F.col("score").isNotNull())
    if threshold is not None:
        df = df.where(F.col("score") >= threshold)
    return df.orderBy(F.desc("score"), key).limit(k)


def search_many(vectors: DataFrame, queries: np.ndarray, names: Sequence, k: int = 5, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query, key, score, rank): the k best rows for each of a stated, bounded set of query vectors.

    Every task scores its rows against all queries by matrix products and keeps k a query, so what is shuffled is k rows
    a query and batch. Rows of another length, with nulls or all zero have no score."""
    q = np.asarray(queries, np.float64)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    shared = vectors.sparkSession.sparkContext.broadcast((q, list(names)))
    key_type = vectors.schema[key].dataType.simpleString()

    def run(batches):
        q, names = shared.value
        for pdf in batches:
            ok = [i for i, v in enumerate(pdf[vector]) if v is not None and len(v) == q.shape[1]]
            if not ok:
                continue
            x = np.array([np.asarray(pdf[vector].iloc[i], dtype=np.float64) for i in ok])
            n = np.linalg.norm(x, axis=1)
            good = np.isfinite(n) & (n > 0)
            ids, x = pdf[key].to_numpy()[ok][good], x[good] / n[good, None]
            s = x @ q.T
            for j in range(q.shape[0]):
                best = np.lexsort((ids, -s[:, j]))[:k]
                yield pd.DataFrame({"query": [names[j]] * len(best), key: ids[best], "score": s[best, j]})

    kind = "long" if len(names) and isinstance(names[0], (int, np.integer)) else "string"
    part = vectors.select(key, vector).mapInPandas(run, f"query {kind}, {key} {key_type}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_keyword(chunks: DataFrame, keyword: str, case_sensitive: bool = False, condition: Column | None = None) -> DataFrame:
    """Rows whose content has the keyword as a substring. Null content never matches."""
    df = chunks if condition is None else chunks.where(condition)
    return df.where(F.col("content").contains(keyword) if case_sensitive else F.lower("content").contains(keyword.lower()))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(c), r"\W+"), lambda t: t != "")


def _equals(term: str):
    return lambda x: x == term


def search_bm25(chunks: DataFrame, query: str, k: int = 100, k1: float = K1, b: float = B, key: str = "chunk_id") -> DataFrame:
    """(key, score) by BM25 over lower-cased words; ties by key.

    Only the query's terms are counted: one pass gives each row's term counts and length, an aggregate over all rows
    gives document frequencies, and that one row is joined back."""
    terms = sorted({t for t in re.split(r"\W+", query.lower()) if t})
    df = chunks.select(key, tokens(F.coalesce("content", F.lit(""))).alias("t"))
    df = df.select(key, F.size("t").alias("n"), *[F.size(F.filter("t", _equals(t))).alias(f"f{i}") for i, t in enumerate(terms)])
    stats = df.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    both = df.where(F.greatest(*[F.col(f"f{i}") for i in range(len(terms))], F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("n") / F.col("avg_n")))
    return both.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def diversify(candidates: DataFrame, k: int = 5, trade: float = LAMBDA, query: str = "query", key: str = "chunk_id", vector: str = "embedding", most: int = 1000) -> DataFrame:
    """(query, key, rank): maximal marginal relevance among each query's ``most`` best candidates (query, key, score, vector)."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    few = candidates.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True], kind="stable")
        x = np.array([np.asarray(v, np.float64) for v in pdf[vector]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        score, near, out = pdf["score"].to_numpy(), np.full(len(pdf), -np.inf), []
        free = np.ones(len(pdf), bool)
        while free.any() and len(out) < k:
            gain = trade * score - (1 - trade) * (near if out else 0)
            i = int(np.flatnonzero(free)[np.argmax(gain[free])])
            out.append(i)
            free[i] = False
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame({query: pdf[query].to_numpy()[out], key: pdf[key].to_numpy()[out], "rank": range(1, len(out) + 1)})

    return few.select(query, key, "score", vector).groupBy(query).applyInPandas(run, f"{query} {kinds[query]}, {key} {kinds[key]}, rank int")


def rerank(results: DataFrame, score: Column, n: int, key: str = "chunk_id") -> DataFrame:
    """The n best of given results by another score (a provider's column); equal and null scores keep the old order."""
    return results.withColumn("rerank_score", score).orderBy(F.desc_nulls_last("rerank_score"), F.desc("score"), key).limit(n)


def search_concepts(concepts: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Concepts by additive score: name equal 100 or contains 50, an alias equal 80 or contains 40, definition contains 20."""
    q = query.lower()
    name, definition = F.lower("name"), F.lower(F.coalesce("definition", F.lit("")))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower)
    score = (
        F.when(name == q, 100).when(name.contains(q), 50).otherwise(0)
        + F.when(F.array_contains(aliases, q), 80).when(F.exists(aliases, lambda a: a.contains(q)), 40).otherwise(0)
        + F.when(definition.contains(q), 20).otherwise(0)
    )
    return concepts.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "concept_id").limit(k)
