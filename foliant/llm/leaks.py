"""Problem 7: documents that contain passages of evaluation items.

Method: a prefix-filtered set join. A document and an item are linked if an item window of MIN_WORDS
consecutive words occurs in the document. Each window is a set of SHINGLE-word shingles with their offsets; as
all of them must be found, one necessary shingle is a sufficient prefix, and the rarest over the whole corpus
gives the fewest candidates. Candidates must leave room for the window before and after the shingle (length and
position), and what remains is verified over the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import cut_lineage, read_table
from foliant.llm.hashing import run_hashes, texts_of, word_hashes

MIN_WORDS, SHINGLE = 12, 5
BLOCK_WINDOWS = 1 << 17  # item windows in one broadcast; the driver holds at most 8 counters for each


def _item_windows(batches: Iterator[pa.RecordBatch], k: int, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in texts_of(batch, "text"):
            h, at = word_hashes(texts)
            whole, wat = run_hashes(h, at, n)
            short, sat = run_hashes(h, at, k)
            width = n - k + 1
            count = np.diff(wat)
            first = np.arange(wat[-1]) + np.repeat(sat[:-1] - wat[:-1], count)
            shingles = short[first[:, None] + np.arange(width)] if len(first) else np.zeros((0, width), np.uint64)
            values = pa.array(shingles.astype(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), count))), pa.array(whole.astype(np.int64)), pa.FixedSizeListArray.from_arrays(values, width).cast(pa.list_(pa.int64()))],
                ["item_id", "window", "shingles"],
            )


def _sorted_lookup(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in sought that are among the sorted keys, their places in keys); a bit table settles most at once."""
    bits = max(16, int(len(keys) * 16 - 1).bit_length())
    table = np.zeros(1 << bits, bool)
    shift = np.uint64(64 - bits)
    table[(keys >> shift).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(sought >> shift).astype(np.int64)])
    at = np.searchsorted(keys, sought[maybe])
    at[at == len(keys)] = 0
    hit = keys[at] == sought[maybe]
    return maybe[hit], at[hit]


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id, windows): documents and the items of which they contain ``min_words`` consecutive words.

    ``documents`` needs doc_id and text, ``items`` item_id and text; other columns are ignored and may have any
    name. Null, empty and shorter texts match nothing; null ids are kept as they are. Rows of the same id count as
    one; ``windows`` is the number of different item windows found. The item side is broadcast in blocks of at most
    ``block_windows`` windows: a larger item set costs a pass over the documents for each block, not memory.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    docs = documents.select("doc_id", "text")
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    windows = items.select("item_id", "text").mapInArrow(lambda it: _item_windows(it, shingle, min_words), f"item_id {item_type}, window long, shingles array<long>").distinct()
    windows = cut_lineage(windows)
    unique = cut_lineage(windows.groupBy("window").agg(F.first("shingles").alias("shingles")))
    total = unique.count()
    result = None
    blocks = max(1, -(-total // block_windows))
    for block in range(blocks):
        # bounded: at most about block_windows windows, of which each is min_words - shingle + 2 numbers
        part = unique.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).toPandas()
        if not len(part):
            continue
        whole = part["window"].to_numpy(np.int64).view(np.uint64)
        sets = np.stack(part["shingles"].to_numpy()).astype(np.int64).view(np.uint64)
        sought = sc.broadcast(np.unique(sets))

        def count(it: Iterator[pa.RecordBatch], keys=sought) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(keys.value), np.int64)
            for batch in it:
                for _, _, texts in texts_of(batch, "text"):
                    h, at = word_hashes(texts)
                    g, _ = run_hashes(h, at, shingle)
                    _, place = _sorted_lookup(keys.value, g)
                    n += np.bincount(place, minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

        freq = np.zeros(len(sought.value), np.int64)
        seen_at = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        freq[seen_at["at"].to_numpy(np.int64)] = seen_at["n"].to_numpy(np.int64)
        # rarity order: count over the corpus, ties by the shingle itself; shingles that never occur rule the window out
        rank = np.searchsorted(sought.value, sets)
        seen = freq[rank]
        alive = seen.min(axis=1) > 0
        offset = np.lexsort((sets.T, seen.T), axis=0)[0] if len(sets) else np.zeros(0, np.int64)
        prefix, offset, whole = sets[np.arange(len(sets)), offset][alive], offset[alive], whole[alive]
        order = np.argsort(prefix, kind="stable")
        index = sc.broadcast((prefix[order], offset[order], whole[order]))

        def probe(it: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            prefix, offset, whole = index.value
            keys, first, many = np.unique(prefix, return_index=True, return_counts=True)
            for batch in it:
                for a, b, texts in texts_of(batch, "text"):
                    if not len(keys):
                        continue
                    h, at = word_hashes(texts)
                    g, gat = run_hashes(h, at, shingle)
                    pos, place = _sorted_lookup(keys, g)
                    doc = np.searchsorted(gat, pos, "right") - 1
                    n = many[place]
                    entry = np.arange(n.sum()) + np.repeat(first[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                    doc = np.repeat(doc, n)
                    start = at[doc] + np.repeat(pos - gat[np.searchsorted(gat, pos, "right") - 1], n) - offset[entry]
                    fits = (start >= at[doc]) & (start + min_words <= at[doc + 1])
                    doc, start, entry = doc[fits], start[fits], entry[fits]
                    if not len(doc):
                        continue
                    run = h[start[:, None] + np.arange(min_words)]
                    same = run_hashes(run.ravel(), np.arange(len(run) + 1) * min_words, min_words)[0] == whole[entry]
                    pairs = np.unique(np.stack([doc[same], whole[entry[same]].view(np.int64)], 1), axis=0)
                    ids = batch.column("doc_id").slice(a, b - a).take(pa.array(pairs[:, 0]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(pairs[:, 1])], ["doc_id", "window"])

        found = docs.mapInArrow(probe, f"doc_id {id_type}, window long")
        result = found if result is None else result.unionAll(found)
    if result is None:
        result = docs.select("doc_id", F.lit(0).cast("long").alias("window")).limit(0)
    links = result.distinct().join(windows.select("item_id", "window"), "window")
    return links.groupBy("doc_id", "item_id").agg(F.countDistinct("window").alias("windows"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).select("doc_id", "item_id")
