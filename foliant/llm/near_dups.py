"""Problem 1: chunks of different books that are the same passage with small edits.

Method: a prefix-tree join. Each text is its set of word runs in one global order. A tree of whole sets can't be spread
over tasks without sending every set to dozens of them, so the sets that may meet are found first: two sets can only be
similar enough if the rare ends of their lists share enough members, so only these are posted and joined, and pairs whose
shared members leave too little room for the rest are dropped. The sets that a set may meet are then sent to it once and
stand in a prefix tree, common members first, so that variants of a passage share long paths. The set's list is carried
down the tree: the overlap so far is counted once a node, and a subtree is left as soon as the overlap plus what remains
of both lists can't reach what the threshold needs. All pairs of the result come out of that walk.

Equal sets are one class; everything up to the result works on classes, whatever the number of copies. No text is
shuffled, only sets of 5-byte members, once. Members that very many sets post are split over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import cut_lineage, latest, read_table
from foliant.llm.hashing import distinct, distinct_counts, mix, run_hashes, texts_of, word_hashes

RUN, THRESHOLD, MIN_WORDS = 3, Fraction(3, 5), 20
COUNTER_BITS = 22  # 2^22 counters order the word runs by rarity; 4 MB are broadcast, whatever the data
SLICES, FAN = 64, 64
SHARED = 3  # members that the heads of two similar sets must share; each takes heads longer by one
EXPANDED = 32  # copies up to which a class is spelled out in pairs; more copies are linked to two members of their class
CELLS = 1 << 21  # members of one part of a tree; 16 MB
LONG = 1 << 15  # members from which a list is no branch of a tree but is compared on its own
CROWD, PARTS = 1 << 14, 256  # occurrences of a member for which a further task is taken, and most such tasks
HUGE = (1 << 24) - 1  # set sizes from here on are not told apart in postings
FILTER_BITS = 1 << 25  # of the fixed-size filter over sets in hopeful pairs (4 MB)
_M40, _M32 = np.uint64((1 << 40) - 1), np.uint64((1 << 32) - 1)


def run_counts(texts: DataFrame, run: int, bits: int = COUNTER_BITS) -> np.ndarray:
    """Logarithms, as 8 bits, of 2^bits counters over the word runs of all texts; runs share counters by hash.

    Any function of the run alone gives a valid global order; this one puts rare runs first. Tasks emit their
    counters in slices, which are added up in groups of at most FAN, level by level, so no task gets more.
    """
    width, slices = (1 << bits) // SLICES, SLICES
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, _, part in texts_of(batch, "text"):
                g, _ = run_hashes(*word_hashes(part), run)
                if len(g):
                    slots, m = distinct_counts(g >> shift)
                    n[slots.astype(np.int64)] += m.astype(np.uint32)
        for i in range(slices):
            part = n[i * width : (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "task", "n"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in table["n"]:
            total += np.frombuffer(x.as_buffer(), np.uint32)
        total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, task int, n binary"
    sums, tasks = texts.select("text").mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while True:
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("slice", "task").applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    out = np.zeros(1 << bits, np.uint8)
    for i, n in sums.select("slice", "n").toLocalIterator():
        out[i * width : (i + 1) * width] = np.minimum(255, np.log2(np.maximum(np.frombuffer(n, np.uint32), 1)) * 8)
    return out


def ordered_sets(texts: list[str | None], counts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted 40-bit members of all texts, offsets by text, words by text). 8 bits of rarity stand above 32 of hash."""
    h, at = word_hashes(texts)
    g, gat = run_hashes(h, at, run)
    weight = counts[(g >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)].astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(gat))
    both = distinct((doc << np.uint64(40)) | (weight << np.uint64(32)) | (g & _M32))
    return both & _M40, np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(40)), np.diff(at)


def pack40(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def unpack40(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(members of all lists, offsets)."""
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64), np.concatenate([[0], np.cumsum([len(b) // 5 for b in blobs])]).astype(np.int64)


def needed(na, nb, t: Fraction):
    """Least overlap of sets of these sizes whose similarity is at least t."""
    p, q = t.numerator, t.numerator + t.denominator
    return -(-(p * (na + nb)) // q)


def head_size(n, t: Fraction):
    """Members of a set of size n of which a similar set must have SHARED in its own head (or all it needs to)."""
    return np.minimum(n, n - -(-(t.numerator * n) // t.denominator) + SHARED)


def _common_first(blobs: list[bytes]) -> list[np.ndarray]:
    """The lists the other way round, as ascending numbers."""
    x, at = unpack40(blobs)
    x = _M40 - x
    return [x[at[i] : at[i + 1]][::-1] for i in range(len(blobs))]


def tree_overlaps(query: list[bytes], other: list[bytes], t: Fraction, tally: dict[str, int] | None = None) -> np.ndarray:
    """Overlap of query[i] and other[i] if it reaches the threshold, else 0.

    The lists that one query may meet stand in a prefix tree: sorted, so that the lists below a node are neighbours. The
    trees are walked level by level, in parts of at most CELLS members. ``tally`` counts the nodes visited and the members
    of the lists that stood for.
    """
    out = np.zeros(len(query), np.int64)
    number = {q: i for i, q in enumerate(dict.fromkeys(query))}
    q_of = np.array([number[q] for q in query], np.int64)
    heads, lists = _common_first(list(number)), _common_first(other)
    nx, ny = np.array([len(h) for h in heads], np.int64)[q_of], np.array([len(y) for y in lists], np.int64)
    need = needed(nx, ny, t)
    possible = need <= np.minimum(nx, ny)
    for i in np.flatnonzero(possible & (np.maximum(nx, ny) > LONG)):
        n = len(np.intersect1d(heads[q_of[i]], lists[i], assume_unique=True))
        out[i] = n if n >= need[i] else 0
    keys = [y.astype(">u8").tobytes() for y in lists]
    rows = sorted(np.flatnonzero(possible & (np.maximum(nx, ny) <= LONG)).tolist(), key=lambda i: (q_of[i], keys[i]))
    a = 0
    while a < len(rows):
        b, width = a, 0
        while b < len(rows) and (b == a or max(width, ny[rows[b]]) * (b - a + 1) <= CELLS):
            width, b = max(width, int(ny[rows[b]])), b + 1
        part = np.array(rows[a:b])
        out[part] = _walk(heads, q_of[part], [lists[i] for i in part], need[part], tally)
        a = b
    return out


def _walk(heads: list[np.ndarray], group: np.ndarray, lists: list[np.ndarray], need: np.ndarray, tally: dict[str, int] | None) -> np.ndarray:
    """Overlaps of sorted lists with the head of their group, as far as they reach ``need``; else 0."""
    own, group = np.unique(group, return_inverse=True)
    x = np.concatenate([heads[g] for g in own])
    xat = np.concatenate([[0], np.cumsum([len(heads[g]) for g in own])])
    xkeys = (np.repeat(np.arange(len(own), dtype=np.uint64), np.diff(xat)) << np.uint64(40)) | x
    nx, ny = np.diff(xat)[group], np.array([len(y) for y in lists])
    width = int(ny.max(initial=0))
    tree = np.zeros((len(lists), width + 1), np.uint64)
    tree[np.repeat(np.arange(len(lists)), ny), np.arange(ny.sum()) - np.repeat(np.cumsum(ny) - ny, ny)] = np.concatenate(lists) + np.uint64(1)  # 0: no more members
    same = np.zeros((len(lists), width), bool)  # the row goes through the same node as the row before
    same[1:] = np.logical_and.accumulate((tree[1:, :width] == tree[:-1, :width]) & (group[1:] == group[:-1])[:, None], axis=1)
    overlap, alive = np.zeros(len(lists), np.int64), np.ones(len(lists), bool)
    passed = np.zeros(len(lists), np.int64)  # members of the query that the path has gone beyond
    for d in range(width):
        alive &= ny > d
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        node = tree[rows, d] - np.uint64(1)
        new = ~same[rows, d] | (np.diff(rows, prepend=-2) != 1)  # the first row of a node that is still alive
        key = (group[rows[new]].astype(np.uint64) << np.uint64(40)) | node[new]
        at = np.searchsorted(xkeys, key)
        hit = np.zeros(len(key), bool)
        inside = at < len(xkeys)
        hit[inside] = xkeys[at[inside]] == key[inside]
        owner = np.cumsum(new) - 1
        overlap[rows] += hit[owner]
        passed[rows] = (at - xat[group[rows[new]]] + hit)[owner]
        bound = overlap[rows] + np.minimum(nx[rows] - passed[rows], ny[rows] - d - 1)
        gone = rows[bound < need[rows]]
        alive[gone], overlap[gone] = False, -(1 << 40)
        if tally is not None:
            tally["nodes"], tally["members"] = tally.get("nodes", 0) + len(key), tally.get("members", 0) + len(rows)
    return np.where(overlap >= need, overlap, 0)


def _sets(batch: pa.RecordBatch, ranks: np.ndarray, run: int, min_words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, members, offsets, class, too short) of parts of a batch."""
    for a, b, part in texts_of(batch, "text"):
        keys, at, words = ordered_sets(part, ranks, run)
        n = np.diff(at)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys))])
        yield a, b, keys, at, mix((total[at[1:]] - total[at[:-1]]) ^ n.astype(np.uint64)).view(np.int64), (words < min_words) | (n == 0)


def text_classes(texts: DataFrame, ranks: Broadcast, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(``texts``' columns but text, class): the same class for the same set; null for texts with fewer words."""
    ids = [c for c in texts.columns if c != "text"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _, cls, short in _sets(batch, ranks.value, run, min_words):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ids], pa.array(cls, mask=short)], [*ids, "class"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.drop("text").schema)
    return texts.mapInArrow(go, f"{kept}, class long")


def _spread(token: np.ndarray, rarity: np.ndarray, packed: np.ndarray, owner: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, owner, position, side) of postings: side 0, but for members that are so frequent (``rarity`` is 8 times the
    logarithm of their number) that their postings are spread over parts: there once on side 1, in one part by the set,
    and once in every part on side 2."""
    parts = np.minimum(PARTS, np.exp2(rarity / 8.0) / CROWD).astype(np.int64)
    many = np.flatnonzero(parts > 1)
    side = np.zeros(len(token), np.int64)
    if not len(many):
        return token, owner, pos, side
    p, few = parts[many], parts <= 1
    salted = lambda i, part: mix((token[i].astype(np.uint64) << np.uint64(9)) + part.astype(np.uint64) + np.uint64(1)).astype(np.uint32)
    i = np.repeat(many, p)
    every = np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p)
    first = salted(many, mix(packed[owner[many]].view(np.uint64)) % p.astype(np.uint64))
    at = np.concatenate([np.flatnonzero(few), many, i])
    side = np.repeat([0, 1, 2], [int(few.sum()), len(many), len(i)])
    return np.concatenate([token[few], first, salted(i, every)]), owner[at], pos[at], side


def similar_classes(texts: DataFrame, ranks: Broadcast, threshold: Fraction = THRESHOLD, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(class_1, class_2, overlap, similarity), class_1 < class_2, of different similar sets among rows (text)."""
    t = Fraction(threshold)
    p, q = t.numerator, t.denominator

    # A posting is (hash of the member, 40 bits of the class and 24 of the set's size): as few bytes as possible,
    # since this is what grows most. Clashes of either hash only add pairs that the verification drops.
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are posted once; bounded by the task's own input
        for batch in batches:
            for _, _, keys, at, cls, short in _sets(batch, ranks.value, run, min_words):
                new = np.array([not s and c not in seen and not seen.add(c) for c, s in zip(cls.tolist(), short.tolist(), strict=True)], bool)
                n = np.where(new, np.diff(at), 0)
                h = np.where(new, head_size(n, t), 0)
                i = np.repeat(np.arange(len(n)), h)
                pos = np.arange(h.sum()) - np.repeat(np.concatenate([[0], np.cumsum(h)[:-1]]), h)
                member = keys[pos + np.repeat(at[:-1], h)]
                packed = ((cls.view(np.uint64) << np.uint64(24)) | np.minimum(n, HUGE).astype(np.uint64)).view(np.int64)
                token, i, pos, side = _spread((member & _M32).astype(np.uint32), (member >> np.uint64(32)).astype(np.int64), packed, i, pos)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int32)), pa.array(packed[i]), pa.array((pos * 3 + side).astype(np.int32))], ["token", "set", "at"])

    posts = texts.select("text").mapInArrow(post, "token int, set long, at int").repartition("token").dropDuplicates(["token", "set", "at"])
    a, b = (posts.select("token", F.col("set").alias(f"set_{i}"), F.floor(F.col("at") / 3).cast("int").alias(f"pos_{i}"), (F.col("at") % 3).alias(f"side_{i}")) for i in (1, 2))
    sides = (F.col("side_1") * 3 + F.col("side_2")).isin(0, 5)  # both of a member in one task, or first side with second
    n1, n2 = (F.col(f"set_{i}").bitwiseAND(HUGE) for i in (1, 2))
    huge = F.greatest(n1, n2) == HUGE  # the size isn't known exactly: no bound holds
    least = F.ceil((n1 + n2) * p / (p + q) - 1e-9)
    # with `least` members in common, the SHARED-th of them leaves room for the others behind it
    room = (F.least(n1, n2) * q >= F.greatest(n1, n2) * p) & (F.col("pos_1") < n1 - least + SHARED) & (F.col("pos_2") < n2 - least + SHARED)
    shared = a.join(b, "token").where(sides & (F.col("set_1") < F.col("set_2")) & (huge | room)).groupBy("set_1", "set_2").agg(F.count("*").alias("m"))
    hopeful = shared.where(huge | (F.col("m") >= F.least(F.lit(SHARED), least)))
    short = lambda c: F.shiftrightunsigned(F.col(c), 24)
    hopeful = cut_lineage(hopeful.select(short("set_1").alias("short_1"), short("set_2").alias("short_2")))

    # sets are read again for those in hopeful pairs: a filter of fixed size keeps most others out of the shuffle
    ends = hopeful.select(F.explode(F.array("short_1", "short_2")).alias("s"))
    words = ends.select(F.pmod("s", F.lit(FILTER_BITS)).alias("b")).groupBy(F.shiftright("b", 5).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 AS int)))").alias("v"))
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    got = words.toPandas()
    table[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).astype(np.uint32)
    wanted = texts.sparkSession.sparkContext.broadcast(table)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, keys, at, cls, short in _sets(batch, ranks.value, run, min_words):
                low = (cls.view(np.uint64) << np.uint64(24)) >> np.uint64(24)
                b = (low % np.uint64(FILTER_BITS)).astype(np.int64)
                keep = ((wanted.value[b >> 5] >> (b & 31).astype(np.uint32)) & 1).astype(bool) & ~short
                i = np.array([j for j in np.flatnonzero(keep) if cls[j] not in seen and not seen.add(cls[j])], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(low[i].view(np.int64)), pa.array(cls[i]), pa.array([pack40(keys[at[j] : at[j + 1]]) for j in i], pa.binary())], ["short", "class", "members"])

    sets = texts.select("text").mapInArrow(load, "short long, class long, members binary").repartition("short").dropDuplicates(["short", "class"])
    x, y = (sets.select(*[F.col(c).alias(f"{c}_{i}") for c in sets.columns]) for i in (1, 2))
    pairs = hopeful.join(x, "short_1").join(y, "short_2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                one, two = part.column("members_1").to_pylist(), part.column("members_2").to_pylist()
                got = tree_overlaps(two, one, t)  # rows come sorted by the second set: what it may meet stands together
                at = np.flatnonzero(got)
                union = np.array([(len(one[i]) + len(two[i])) // 5 for i in at], np.int64) - got[at]
                yield pa.RecordBatch.from_arrays([part.column("class_1").take(pa.array(at)), part.column("class_2").take(pa.array(at)), pa.array(got[at]), pa.array(got[at] / np.maximum(union, 1))], ["class_1", "class_2", "overlap", "similarity"])

    done = pairs.select("class_1", "class_2", "members_1", "members_2").mapInArrow(verify, "class_1 long, class_2 long, overlap long, similarity double")
    return done.select(F.least("class_1", "class_2").alias("class_1"), F.greatest("class_1", "class_2").alias("class_2"), "overlap", "similarity")


def near_duplicates(chunks: DataFrame, metadata: DataFrame, threshold: Fraction = THRESHOLD, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): leaf chunks with their class, and similar classes.

    ``chunks`` needs chunk_id, content, level, ingested_at; ``metadata`` chunk_id, document_id, ingested_at; other
    columns are ignored. Of repeated chunk_ids the latest row counts, here and there. Left out are chunks whose
    latest row isn't level 2 or has fewer than ``min_words`` words (null and empty content), and those without a
    metadata row or with a null document_id or chunk_id.
    """
    texts = chunks.select("chunk_id", "level", "ingested_at", F.col("content").alias("text"))
    ranks = chunks.sparkSession.sparkContext.broadcast(run_counts(texts, run))
    rows = text_classes(texts, ranks, run, min_words)
    thin = latest(rows, ["chunk_id"], "ingested_at", [F.col("class").asc_nulls_last(), F.col("level")])
    book = latest(metadata.select("chunk_id", "document_id", "ingested_at"), ["chunk_id"], "ingested_at", [F.col("document_id").asc_nulls_last()]).drop("ingested_at")
    members = thin.where("level = 2 AND class IS NOT NULL").select("chunk_id", "class").join(book.where("document_id IS NOT NULL"), "chunk_id")
    return members, similar_classes(texts.where("level = 2"), ranks, threshold, run, min_words)


def expand(members: DataFrame, links: DataFrame, limit: int = EXPANDED) -> DataFrame:
    """(chunk_id_1, chunk_id_2) of different documents, first < second.

    Classes of at most ``limit`` copies are spelled out. Of larger ones, two members of different documents stand
    for all, and every other copy is linked to one of these two: as many rows as copies, and no link is lost.
    """
    item = F.struct("document_id", "chunk_id")
    # one class, one row: sizes and stand-ins need no window over a class
    stats = members.groupBy("class").agg(F.count("*").alias("size"), F.min(item).alias("lo"), F.max(item).alias("hi"))
    m = members.join(stats, "class")
    stands = (F.col("size") <= limit) | (item == F.col("lo")) | (item == F.col("hi"))
    side = m.where(stands).select("class", "chunk_id", "document_id", "size")
    one = side.select(*[F.col(c).alias(f"{c}_1") for c in side.columns])
    two = side.select(*[F.col(c).alias(f"{c}_2") for c in side.columns])
    across = links.select("class_1", "class_2").join(one, "class_1").join(two, "class_2")
    within = one.where(F.col("size_1") > 1).join(two, F.col("class_1") == F.col("class_2"))
    other = F.when(F.col("document_id") == F.col("lo.document_id"), F.col("hi")).otherwise(F.col("lo"))
    star = m.where(F.col("size") > limit).select(F.col("chunk_id").alias("chunk_id_1"), F.col("document_id").alias("document_id_1"), other["chunk_id"].alias("chunk_id_2"), other["document_id"].alias("document_id_2"))
    cols = ["chunk_id_1", "document_id_1", "chunk_id_2", "document_id_2"]
    found = across.select(*cols).unionByName(within.where("chunk_id_1 < chunk_id_2").select(*cols)).where("document_id_1 <> document_id_2")
    star = star.where("document_id_1 <> document_id_2")
    pair = lambda df: df.select(F.least("chunk_id_1", "chunk_id_2").alias("chunk_id_1"), F.greatest("chunk_id_1", "chunk_id_2").alias("chunk_id_2"))
    return pair(found).unionByName(pair(star)).distinct()


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "chunk_metadata"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = _inputs(spark, sf_dir)
    return expand(cut_lineage(members), cut_lineage(links))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a leaf chunk: its class, the copies in it and the number of similar classes."""
    members, links = (cut_lineage(df) for df in _inputs(spark, sf_dir))
    ends = links.select(F.explode(F.array("class_1", "class_2")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"))
    return members.join(sizes, "class").join(ends, "class", "left").select("chunk_id", F.col("class").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
