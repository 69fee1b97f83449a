"""Problem 3: the most similar vectors of every vector.

Method: a permutation index. A bounded sample of the vectors are pivots, and each vector is posted in the inverted files
of its nearest ones. Within a file each vector is the order of its nearest among further pivots, directions drawn at
random, after what the file's members have in common is taken out of it (it would make all orders alike). Pairs are
ranked by the footrule distance of these orders and cut where a pair as similar as asked would hardly ever lie; as the
directions are random, how far that is follows from geometry, whatever the data (``least_weights``). Those left are
compared by their cosine over 5-bit or 3-bit coordinates, and every pair that these, within a proven bound of their rounding,
leave possible is reranked by the cosine over 16-bit ones, which is within 1e-5 of the exact one. A file that leaves too
many pairs to list is reranked as a whole, in blocks.

Pivots are as many as the vectors ask for, up to a broadcast of fixed size, and are looked up in two levels. The more there
are, the less often two similar vectors have one of a few nearest in common, so how many files a vector is posted in is
measured with these pivots (``postings``). Where they are many, coordinates are posted in 3 bits instead of 5, within a
bound of their own. A file that is long all the same is compared in a few blocks, and one too long for these is divided by the first directions of its
members' orders, so that a vector's postings never grow with the data. Equal vectors are one class up to the result.

Files of pivots that lie near one another form a region, which one task compares file by file: a vector's code is sent
once to each region that it has files in, with the numbers of these files, not once to each file (``regions``).
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.common import cut_lineage, latest, read_table
from foliant.llm.hashing import mix

DIM, K, LEAST = 384, 5, 0.80
FEWEST, MOST_POSTED = 3, 32  # inverted files of each vector
PARTED = 0.02  # share of pairs a quarter of the way from what is asked to equality that may have no file in common
TRIED = 1024  # vectors besides the pivots with which that is measured
LONG_CODES = 4  # inverted files up to which 5 bits a coordinate are posted
DIRECTIONS, ORDER = 128, 40  # random pivots within a file, and how many of them are in a vector's order
LOST = 0.003  # share of the pairs exactly as similar as asked that the footrule distance may part
FILE = 256  # vectors to a pivot; the pivots are a sample of one in so many vectors,
MOST_PIVOTS = 1 << 16  # and at most so many (25 MB as sent)
SEARCHED = 2048  # pivots up to which all are compared with a vector; beyond, those of its nearest groups
MOST_BLOCKS = 3  # of a file; a longer one is divided
SUBFILES = 6  # of each vector in a divided file
BLOCK = 16384  # members of a file in one block
REGION = 1 << 17  # postings to files that one task has at once
REGIONS = 4  # for each core at least, where the data are few
SLACK = 0.01  # cosines so far below what is asked, and a share of what rounding may turn, are near enough for the footrule distance
ANGLE = 1 / 20_000  # unit of the angles by which 5-bit coordinates turn a vector, as posted
LISTED = 32  # pairs a member up to which a file lists them; beyond, its members are reranked with one another
FILTER_BITS = 1 << 25
_PRIME = np.random.Generator(np.random.PCG64(3)).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 unit vectors) of the usable embeddings of a batch: ``dim`` numbers, none null or NaN, not all 0."""
    col = batch.column("embedding")
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(n == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    col = col.take(pa.array(rows))
    flat = col.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)  # nulls become NaN
    ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
    rows, x = rows[ok], x[ok]
    big = np.abs(x).max(axis=1, keepdims=True) if len(x) else np.ones((0, 1))
    x = x / big
    return rows, (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _classes(x: np.ndarray) -> np.ndarray:
    """One number for equal unit vectors."""
    bits = np.ascontiguousarray(x + np.float32(0)).view(np.uint32).astype(np.uint64)
    return mix((mix(bits) * _PRIME[: x.shape[1]]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _pivot_orders(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each vector, nearest first."""
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 2048):
        s = x[a : a + 2048] @ pivots.T
        near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(s), 1))
        out[a : a + 2048] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    return out


class Pivots:
    """Nearest pivots; many pivots stand in groups around some of them, of which the nearest ``groups`` are searched."""

    def __init__(self, pivots: np.ndarray, searched: int = SEARCHED, groups: int = 12):
        self.pivots, self.heads = pivots, None
        if len(pivots) > searched:
            count = int(np.sqrt(len(pivots))) + 1
            self.heads, self.groups = pivots[:: max(1, len(pivots) // count)], groups
            self.group = _pivot_orders(pivots, self.heads, 1)[:, 0]
            self.members = [np.flatnonzero(self.group == g) for g in range(len(self.heads))]

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        if self.heads is None:
            return _pivot_orders(x, self.pivots, k)
        seen = _pivot_orders(x, self.heads, min(self.groups, len(self.heads)))
        best, at = np.full((len(x), k), -np.inf, np.float32), np.zeros((len(x), k), np.int32)
        for g in np.unique(seen):
            own = self.members[g]
            rows = np.flatnonzero((seen == g).any(axis=1))
            for a in range(0, len(rows) if len(own) else 0, 2048):
                r = rows[a : a + 2048]
                s = np.concatenate([best[r], x[r] @ self.pivots[own].T], axis=1)
                i = np.concatenate([at[r], np.broadcast_to(own.astype(np.int32), (len(r), len(own)))], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best[r], at[r] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return np.take_along_axis(at, np.argsort(-best, axis=1, kind="stable"), 1)


def postings(pivots: Pivots, x: np.ndarray, least: float, parted: float = PARTED) -> int:
    """In how many files vectors like ``x``, which are no pivots, must be posted for pairs to meet."""
    most = min(MOST_POSTED, len(pivots.pivots))
    if not len(x) or most <= FEWEST:
        return min(FEWEST, most)
    c = (1 + 3 * least) / 4
    other = np.random.Generator(np.random.PCG64(13)).standard_normal(x.shape).astype(np.float32)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other *= np.sqrt(1 - c * c) / np.maximum(np.sqrt((other * other).sum(axis=1, keepdims=True)), 1e-9)
    own, its = pivots.nearest(x, most), pivots.nearest(c * x + other, most)
    met = np.maximum(np.arange(most)[:, None], np.arange(most)[None, :]) + 1  # postings from which two places count
    met = np.where(own[:, :, None] == its[:, None, :], met, most + 1).min(axis=(1, 2))
    return max(FEWEST, min(most, int(np.quantile(met, 1 - parted, method="higher"))))


@cache
def directions(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).standard_normal((dim, DIRECTIONS)).astype(np.float32)


def shared_weights(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Over the pivots that two orders share, the sum of the smaller of the two weights (ORDER - place), for all pairs.

    The footrule distance of two orders, a missing pivot standing at place ORDER, is ORDER * (ORDER + 1) minus twice that."""
    k = cols.shape[1]
    table = np.zeros((DIRECTIONS, len(cols)), np.uint8)
    for place in range(k):
        table[cols[:, place], np.arange(len(cols))] = k - place
    weight = np.arange(k, 0, -1).astype(np.uint8)[:, None]
    out = np.empty((len(rows), len(cols)), np.uint16)
    for i, order in enumerate(rows):  # what one row needs stays in the processor's cache
        least = np.minimum(table[order], weight)
        out[i] = least.reshape(k // 5, 5, -1).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.uint16)  # five weights fit a byte
    return out


GRID = 64


@cache
def least_weights(lost: float = LOST, pairs: int = 4000) -> np.ndarray:
    """For a cosine of i / GRID, the shared weight below which at most the share ``lost`` of such pairs lie, less one.

    The scalar products of two vectors with random directions are normal and as correlated as the vectors' cosine, so
    this holds for vectors of any data and any dimension. None is asked of pairs that need no positive cosine."""
    rng = np.random.Generator(np.random.PCG64(12))
    out = np.zeros(GRID + 1, np.uint16)
    for i in range(1, GRID + 1):
        c = i / GRID
        a = rng.standard_normal((pairs, DIRECTIONS))
        b = c * a + np.sqrt(1 - c * c) * rng.standard_normal((pairs, DIRECTIONS))
        w = np.zeros((2, pairs, DIRECTIONS))
        for side, z in enumerate((a, b)):
            np.put_along_axis(w[side], np.argsort(-z, axis=1)[:, :ORDER], np.arange(ORDER, 0, -1.0)[None, :], 1)
        out[i] = max(out[i - 1], np.quantile(np.minimum(*w).sum(axis=1), lost, method="lower") - 1, 0)
    return out


def pack5(x: np.ndarray) -> np.ndarray:
    """Vectors as 5 bits a coordinate, up to a factor, three coordinates to 16 bits."""
    scale = np.abs(x).max(axis=1, keepdims=True, initial=1e-30)
    q = np.zeros((len(x), -(-x.shape[1] // 3) * 3), np.uint16) + 16
    q[:, : x.shape[1]] = np.rint(x / scale * 15) + 16
    q = q.reshape(len(x), q.shape[1] // 3, 3)
    return np.ascontiguousarray(q[..., 0] | (q[..., 1] << 5) | (q[..., 2] << 10)).view(np.uint8)


def unpack5(raw: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors of pack5's rows."""
    word = np.ascontiguousarray(raw).view(np.uint16)
    x = np.stack([(word >> s) & 31 for s in (0, 5, 10)], axis=-1).reshape(len(raw), word.shape[1] * 3)[:, :dim].astype(np.float32) - 16
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@cache
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.Generator(np.random.PCG64(14)).standard_normal((dim, dim)))[0].astype(np.float32)


STEP3 = 0.586  # of eight even steps, the one that turns normally distributed coordinates least


def pack3(x: np.ndarray) -> np.ndarray:
    """Unit vectors, turned at random so that coordinates of any data are alike, as three planes of one bit a coordinate."""
    q = np.clip(np.floor(x @ rotation(x.shape[1]) * (np.sqrt(x.shape[1]) / STEP3)) + 4, 0, 7).astype(np.uint8)
    return np.concatenate([np.packbits(q >> s & 1, axis=1) for s in (0, 1, 2)], axis=1)


def unpack3(raw: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors of pack3's rows, which stay turned."""
    planes = np.unpackbits(raw.reshape(len(raw), 3, -1), axis=2, count=dim)
    x = (planes[:, 0] | planes[:, 1] << 1 | planes[:, 2] << 2).astype(np.float32) - np.float32(3.5)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The angles between unit vectors and their rounded forms, in units of ANGLE, rounded up."""
    chord = np.sqrt(((x.astype(np.float64) - y) ** 2).sum(axis=1))
    return np.ceil((2 * np.arcsin(np.minimum(chord / 2, 1)) + 1e-5) / ANGLE).astype(np.uint16)


def in_common(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(orders, common part) of the members of a file: each is ``common * centre + rest``, and its order is that of the
    directions nearest to the rest."""
    centre = x.mean(axis=0, dtype=np.float64)
    centre /= np.sqrt((centre * centre).sum()) or 1.0
    centre = centre.astype(np.float32)
    along, d = x @ centre, directions(x.shape[1])
    s = x @ d - along[:, None] * (centre @ d)
    near = np.argpartition(-s, ORDER - 1, axis=1)[:, :ORDER]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1).astype(np.uint8), along


def compare_blocks(vectors: np.ndarray, split: int, least: float, keep: int, turn: np.ndarray | None = None, most: int | None = None, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (i, j) of one file, or of its first ``split`` members with the others, that pass the footrule distance, and
    whose cosine may be at least ``least`` and among the ``keep`` largest of either; None if more than ``most`` may reach
    ``least``. ``tally`` counts the pairs compared and those that pass.

    ``turn`` bounds the angle by which each vector is off. The angle of a pair is then off by at most the sum of its
    two, so rounding leaves out no pair that belongs to the result, however near the others are.
    """
    n = len(vectors)
    exact = turn is None
    turn = np.zeros(n) if exact else turn
    blur = 0.0 if exact else 2e-6  # of cosines in single precision
    floor = least if exact else np.cos(min(np.pi, np.arccos(least) + 2 * turn.max(initial=0))) - blur
    orders, along = in_common(vectors)
    # the cosine that the rests must have if the whole vectors are near enough, by steps of their common parts
    steps = np.linspace(-1, 1, GRID * 2 + 1)
    at, up = np.clip(((along + 1) * GRID).astype(np.int64), 0, 2 * GRID - 1), steps[1:]
    low_up = np.array([steps[:-1], up])
    near = least - SLACK - 1.5 * float(turn.max(initial=0)) ** 2  # orders are those of rounded vectors
    corners = [(near - np.outer(p, q)) / np.sqrt(np.maximum(1e-9, np.outer(1 - p * p, 1 - q * q))) for p in low_up for q in low_up]
    needed = least_weights()[(np.clip(np.minimum.reduce(corners), 0, 1) * GRID).astype(np.int64)]
    left, right = (np.arange(split), np.arange(split, n)) if split else (np.arange(n), np.arange(n))
    score = {i: [] for i in (0, 1, 2, 3)}
    step, listed = 512, 0
    for a in range(0, len(left), step):
        i = left[a : a + step]
        cols = right if split else right[a:]
        for b in range(0, len(cols), 2048):
            j = cols[b : b + 2048]
            ok = shared_weights(orders[i], orders[j]) >= needed[at[i]].take(at[j], axis=1)
            if not split:
                ok &= i[:, None] < j[None, :]
            x, y = np.nonzero(ok)
            if tally is not None:
                tally["compared"] = tally.get("compared", 0) + (ok.size if split else int((i[:, None] < j[None, :]).sum()))
                tally["passed"] = tally.get("passed", 0) + len(x)
            if len(x) > 0.04 * ok.size:
                low = (vectors[i] @ vectors[j].T)[x, y]
                x, y = i[x], j[y]
            else:
                x, y = i[x], j[y]
                low = np.concatenate([np.einsum("ij,ij->i", vectors[x[c : c + 4096]], vectors[y[c : c + 4096]]) for c in range(0, len(x), 4096)] or [np.zeros(0, np.float32)])
            near = low >= floor
            x, y, low = x[near], y[near], low[near]
            high = low
            if not exact:
                off = turn[x] + turn[y]
                low, high = low.astype(np.float64) - blur, low.astype(np.float64) + blur
                high = np.cos(np.maximum(0, np.arccos(np.clip(high, -1, 1)) - off))
                low = np.cos(np.minimum(np.pi, np.arccos(np.clip(low, -1, 1)) + off))
                may = high >= least - 1e-6
                x, y, low, high = x[may], y[may], low[may], high[may]
            listed += len(x)
            if most is not None and listed > most:
                return None
            for s, v in zip((0, 1, 2, 3), (x, y, low, high), strict=True):
                score[s].append(v)
    x, y, low, high = (np.concatenate(score[s]) if score[s] else np.zeros(0, np.int64) for s in (0, 1, 2, 3))
    if not len(x):
        return x.astype(np.int64), y.astype(np.int64)
    both, other = np.concatenate([x, y]), np.concatenate([low, low])
    o = np.lexsort((-other, both))
    first = np.concatenate([[True], both[o][1:] != both[o][:-1]])
    place = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    bound = np.full(n, -np.inf)  # keep others are at least so near
    bound[both[o][place == keep - 1]] = other[o][place == keep - 1]
    good = (high >= bound[x]) | (high >= bound[y])
    return x[good], y[good]


def nearest_within(x: np.ndarray, split: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of unit vectors, or of the first ``split`` with the others: for each its ``k`` nearest of at least
    ``least``, of equally near ones the first. Both ways of a pair count; each pair comes once, i < j."""
    n = len(x)
    sides = [(np.arange(split), np.arange(split, n)), (np.arange(split, n), np.arange(split))] if split else [(np.arange(n), np.arange(n))]
    out = []
    for rows, cols in sides:
        for a in range(0, len(rows), 512):
            i = rows[a : a + 512]
            s = x[i] @ x[cols].T
            if not split:
                s[np.arange(len(i)), i] = -2
            s[s < least] = -2
            r = min(k, len(cols))
            kth = np.partition(s, len(cols) - r, axis=1)[:, len(cols) - r, None]
            ahead, equal = s > kth, s == kth
            ahead |= equal & (np.cumsum(equal, axis=1) <= r - ahead.sum(axis=1, keepdims=True))
            p, q = np.nonzero(ahead & (s >= least))
            out.append((np.minimum(i[p], cols[q]), np.maximum(i[p], cols[q]), s[p, q]))
    i, j, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    _, one = np.unique(i * n + j, return_index=True)
    return i[one], j[one], s[one]


def _unit(pivots: np.ndarray) -> np.ndarray:
    x = pivots.astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def divisions(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, depth) of files of these sizes: as many blocks as BLOCK asks for, up to MOST_BLOCKS; files longer than
    that are divided by one or two of the directions nearest to their members."""
    depth = np.zeros(len(sizes), np.int64)
    for parts in (DIRECTIONS, DIRECTIONS * (DIRECTIONS - 1) // 2):
        long = (sizes > BLOCK * MOST_BLOCKS) & (depth < 2)
        depth[long] += 1
        sizes = np.where(long, sizes / np.where(depth == 2, (DIRECTIONS - 1) / 2, parts / SUBFILES), sizes)
    return np.clip(np.ceil(sizes / BLOCK), 1, MOST_BLOCKS).astype(np.int64), depth


def subfiles(x: np.ndarray, file: np.ndarray, pivots: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, part of their file): SUBFILES times, once for rows whose file isn't divided."""
    d, part = depth[file], np.zeros((len(x), SUBFILES), np.int64)
    far = np.flatnonzero(d)
    if len(far):
        p = pivots[file[far]]
        rest = x[far] - (x[far] * p).sum(axis=1, keepdims=True) * p
        near = np.argsort(-(rest @ directions(x.shape[1])), axis=1)[:, :SUBFILES].astype(np.int64)
        two = np.array([(a, b) for b in range(1, 4) for a in range(b)])  # the pairs of the first four
        pairs = np.sort(near[:, two], axis=2)
        part[far] = np.where(d[far, None] == 2, (pairs[:, :, 0] + 1) * (DIRECTIONS + 1) + pairs[:, :, 1] + 1, near + 1)
    yield np.arange(len(x)), part[:, 0]
    for j in range(1, SUBFILES if len(far) else 1):
        yield far, part[far, j]


def regions(pivots: np.ndarray, sizes: np.ndarray, most: float) -> np.ndarray:
    """The region of each pivot's file: pivots are halved along the direction in which they differ most until the files
    of a part have at most ``most`` members together, or are one."""
    out, todo, count = np.zeros(len(pivots), np.int64), [np.arange(len(pivots))], 0
    while todo:
        i = todo.pop()
        if len(i) <= 1 or sizes[i].sum() <= most:
            out[i], count = count, count + 1
            continue
        y = pivots[i] - pivots[i].mean(axis=0)
        along = y[np.argmax((y * y).sum(axis=1))]
        for _ in range(20):
            along = (y @ along) @ y
            along = along / max(np.sqrt((along * along).sum()), 1e-30)
        o = i[np.argsort(y @ along, kind="stable")]
        filled = np.cumsum(sizes[o])
        half = int(np.clip(np.searchsorted(filled, filled[-1] / 2), 1, len(i) - 1))
        todo += [o[:half], o[half:]]
    return out


def by_region(files: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(rows, regions, files in these) of vectors posted in ``files``; files whose region is negative are left out."""
    row, place = np.nonzero(region[files] >= 0)
    file = files[row, place].astype(np.int32)
    o = np.lexsort((region[file], row))
    row, file = row[o], file[o]
    of = region[file]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (of[1:] != of[:-1])])[: len(row)])
    ends = np.concatenate([first, [len(row)]]).astype(np.int32) * 4
    return row[first], of[first], pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(file)])


def files_within(posted: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """(file, rows posted in it) of a region's rows, each with the files that by_region gave it."""
    files = posted.to_pylist()
    file, row = np.frombuffer(b"".join(files), np.int32), np.repeat(np.arange(len(files)), [len(f) // 4 for f in files])
    o = np.argsort(file, kind="stable")
    ends = np.flatnonzero(np.diff(file[o], append=-1)) + 1
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        yield int(file[o[a]]), row[o[a:b]]


def similar_vectors(vectors: DataFrame, k: int = K, least: float = LEAST, dim: int = DIM, posted: int | None = None, file: int = FILE) -> tuple[DataFrame, DataFrame]:
    """(members (chunk_id, class), links (class, other, similarity)): for each class of equal usable vectors, similar
    classes with an exact cosine of at least ``least``, both ways, among which are its ``k`` nearest ones.

    ``vectors`` needs chunk_id, embedding, embedded_at; other columns are ignored. Of repeated chunk_ids the latest
    row counts; where it is null, of another dimension, all zero or has null, NaN or infinite numbers, the chunk_id has
    no vector. Null chunk_ids are left out.
    """
    spark = vectors.sparkSession
    v = vectors.select("chunk_id", "embedded_at", "embedding")
    total = v.count()  # from the files' footers
    pivots_wanted = int(min(MOST_PIVOTS, max(16, total // file)))
    chance = min(1.0, 1.3 * (pivots_wanted + TRIED) / max(total, 1))
    limit = np.uint64(min(int(chance * 2.0**64), 2**64 - 1))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _usable(batch, dim)
            cls = _classes(x)
            of = np.zeros(batch.num_rows, np.int64)
            of[rows] = cls
            bad = np.ones(batch.num_rows, bool)
            bad[rows] = False
            drawn = np.zeros(batch.num_rows, np.int64) - 1
            drawn[rows] = np.where(mix(cls.view(np.uint64) + np.uint64(17)) <= limit, np.arange(len(rows)), -1)
            vecs = [None if d < 0 else np.rint(x[d] / np.abs(x[d]).max() * 127).astype(np.int8).tobytes() for d in drawn]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("embedded_at"), pa.array(of, mask=bad), pa.array(vecs, pa.binary())], ["chunk_id", "embedded_at", "class", "vec"])

    ts = v.schema["embedded_at"].dataType.simpleString()
    read = cut_lineage(v.mapInArrow(thin, f"chunk_id {v.schema['chunk_id'].dataType.simpleString()}, embedded_at {ts}, class long, vec binary"))
    members = cut_lineage(latest(read.drop("vec"), ["chunk_id"], "embedded_at", [F.col("class").asc_nulls_last()]).where("class IS NOT NULL").select("chunk_id", "class"))
    # bounded: about 1.3 * MOST_PIVOTS vectors at most, of a byte a number
    drawn = read.where("vec IS NOT NULL").dropDuplicates(["class"]).orderBy(F.xxhash64("class")).limit(pivots_wanted + TRIED).select("vec").toPandas()
    tried, drawn = drawn.iloc[pivots_wanted:], drawn.iloc[:pivots_wanted]
    pivots = np.stack([np.frombuffer(b, np.int8) for b in drawn["vec"]]) if len(drawn) else np.zeros((1, dim), np.int8)
    searched = SEARCHED
    whole = Pivots(_unit(pivots), searched)
    m = postings(whole, _unit(np.stack([np.frombuffer(b, np.int8) for b in tried["vec"]])) if len(tried) else np.zeros((0, dim), np.float32), least) if posted is None else min(posted, len(pivots))
    short = m > LONG_CODES
    share = np.bincount(whole.nearest(whole.pivots, m).ravel(), minlength=len(pivots)) / max(len(pivots), 1)
    plan = divisions(share * total)
    together = (plan[0] == 1) & (plan[1] == 0)  # the others are parted by their blocks and parts
    region = np.full(len(pivots), -1, np.int64)
    region[together] = regions(whole.pivots[together], (share * total)[together], min(REGION, total * m / (REGIONS * spark.sparkContext.defaultParallelism)))
    live = _filter(members.select("class"))
    shared = spark.sparkContext.broadcast((pivots, plan, live, region))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, plan, live, region = shared.value
        whole = Pivots(_unit(pivots), searched)
        seen: set[int] = set()  # equal vectors within a task; bounded by the task's own input
        for batch in batches:
            _, x = _usable(batch, dim)
            cls = _classes(x)
            known = _may_hold(live, cls)
            new = np.array([i for i, c in enumerate(cls.tolist()) if known[i] and c not in seen and not seen.add(c)], np.int64)
            x, cls = x[new], cls[new]
            o = whole.nearest(x, m)
            packed = pack3(x) if short else pack5(x)
            turn = (turned(x @ rotation(dim), unpack3(packed, dim)) if short else turned(x, unpack5(packed, dim))).reshape(-1, 1).view(np.uint8)
            codes = pa.array([c.tobytes() for c in np.concatenate([turn, packed], axis=1)], pa.binary())
            row, of, files = by_region(o, region)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - of), pa.array(cls[row]), codes.take(pa.array(row)), files], ["file", "class", "code", "files"])
            for j in range(m):
                for row, sub in subfiles(x, o[:, j], whole.pivots, plan[1]):
                    own = region[o[row, j]] < 0
                    row, sub = row[own], sub[own]
                    nb = plan[0][o[row, j]]
                    own = (cls[row].view(np.uint64) % nb.astype(np.uint64)).astype(np.int64)
                    i = np.repeat(np.arange(len(row)), nb)  # block b meets block t of the same file in the task {b, t}
                    t = np.arange(len(i)) - np.repeat(np.concatenate([[0], np.cumsum(nb)[:-1]]), nb) if len(i) else i
                    lo, hi = np.minimum(own[i], t), np.maximum(own[i], t)
                    key = (o[row, j][i].astype(np.int64) << 40) | (sub[i] << 16) | (lo << 8) | hi
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls[row][i]), codes.take(pa.array(row[i])), pa.array([b""] * len(key))], ["file", "class", "code", "files"])

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of a region (negative) or of blocks of one file."""
        file, cls = key[0].as_py(), table["class"].to_numpy()
        code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        if file >= 0:
            return compared(file, cls, code)
        return pa.concat_tables([compared(f << 40, cls[rows], code[rows]) for f, rows in files_within(table["files"])])

    def compared(file: int, cls: np.ndarray, code: np.ndarray) -> pa.Table:
        lo, split = (file >> 8) & 0xFF, (file >> 8) & 0xFF != file & 0xFF
        second = (cls.view(np.uint64) % np.uint64(shared.value[1][0][file >> 40])).astype(np.int64) != lo
        _, one = np.unique(cls, return_index=True)  # the same class from several tasks
        one = one[np.argsort(second[one], kind="stable")] if split else one
        cls, cut = cls[one], int((~second[one]).sum()) if split else 0
        code = code[one]
        turn, vec = np.ascontiguousarray(code[:, :2]).view(np.uint16)[:, 0] * ANGLE, (unpack3 if short else unpack5)(code[:, 2:], dim)
        if split and cut in (0, len(cls)):
            x = y = np.zeros(0, np.int64)
        else:
            got = compare_blocks(vec, cut, least, k, turn, LISTED * len(cls))
            x, y = (np.arange(len(cls)),) * 2 if got is None else got  # a member with itself: all are compared when reranked
        return pa.table({"file": pa.array(np.full(len(x), file, np.int64)), "class_1": pa.array(np.minimum(cls[x], cls[y])), "class_2": pa.array(np.maximum(cls[x], cls[y]))})

    posts = v.select("embedding").mapInArrow(post, "file long, class long, code binary, files binary")
    pairs = posts.groupBy("file").applyInArrow(search, "file long, class_1 long, class_2 long")
    whole = F.when(F.col("class_1") == F.col("class_2"), F.col("file")).alias("whole")  # stays with each such file
    pairs = cut_lineage(pairs.groupBy("class_1", "class_2", whole).agg(F.min("file").alias("file")).drop("whole"))
    needed = spark.sparkContext.broadcast(_filter(pairs.select(F.explode(F.array("class_1", "class_2")).alias("class"))))
    if total * m > REGION:
        _tidy(spark)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            _, x = _usable(batch, dim)
            cls = _classes(x)
            known = _may_hold(needed.value, cls)
            i = np.array([i for i, c in enumerate(cls.tolist()) if known[i] and c not in seen and not seen.add(c)], np.int64)
            big = np.abs(x[i]).max(axis=1, keepdims=True, initial=1e-30)
            yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array([r.tobytes() for r in np.rint(x[i] / big * 32767).astype(np.int16)], pa.binary())], ["class", "vec"])

    exact = v.select("embedding").mapInArrow(load, "class long, vec binary").dropDuplicates(["class"])
    # the pairs of a file share their vectors: each is sent there once, not once a pair
    members_of = pairs.select(F.col("file").alias("at"), F.explode(F.array("class_1", "class_2")).alias("class")).distinct()

    def rerank(key: tuple[pa.Scalar, ...], pair: pa.Table, vecs: pa.Table) -> pa.Table:
        cls = vecs["class"].to_numpy()
        o = np.argsort(cls)
        x = np.frombuffer(b"".join(vecs["vec"].to_pylist()), np.int16).reshape(-1, dim)[o].astype(np.float32)
        x /= np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        one, two = pair["class_1"].to_numpy(), pair["class_2"].to_numpy()
        own, one, two = one[one == two], one[one != two], two[one != two]
        i, j = np.searchsorted(cls[o], one), np.searchsorted(cls[o], two)
        s = np.concatenate([(x[i[a : a + 4096]].astype(np.float64) * x[j[a : a + 4096]]).sum(axis=1) for a in range(0, len(i), 4096)] or [np.zeros(0)])
        if len(own):  # the file as a whole
            file = key[0].as_py()
            lo, split = (file >> 8) & 0xFF, (file >> 8) & 0xFF != file & 0xFF
            own = np.sort(own)
            second = (own.view(np.uint64) % np.uint64(shared.value[1][0][file >> 40])).astype(np.int64) != lo
            own = own[np.argsort(second, kind="stable")] if split else own
            a, b, t = nearest_within(x[np.searchsorted(cls[o], own)].astype(np.float64), int((~second).sum()) if split else 0, least - 1e-6, k)
            one, two = np.concatenate([one, np.minimum(own[a], own[b])]), np.concatenate([two, np.maximum(own[a], own[b])])
            s = np.concatenate([s, t])
        return pa.table({"class": one, "other": two, "similarity": np.minimum(1.0, s)})

    done = pairs.groupBy("file").cogroup(members_of.join(exact, "class").groupBy("at")).applyInArrow(rerank, "class long, other long, similarity double")
    done = done.where(F.col("similarity") >= least - 1e-6).groupBy("class", "other").agg(F.max("similarity").alias("similarity"))
    alive = members.select("class").distinct()
    done = done.join(alive, "class", "left_semi").join(alive.withColumnRenamed("class", "other"), "other", "left_semi")
    done = cut_lineage(done.select("class", "other", "similarity"))  # used twice, so that it isn't made twice
    return members, done.unionByName(done.select(F.col("other").alias("class"), F.col("class").alias("other"), "similarity"))


def _tidy(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of results that are cut off, the postings. It does so when the driver's garbage is
    collected, which may not happen before the end, and until then they take disk beside those of the next steps."""
    gc.collect()
    time.sleep(1.2)  # py4j lets go of plans that Python has dropped once a second
    spark.sparkContext._jvm.System.gc()


def _filter(classes: DataFrame) -> np.ndarray:
    """A bit table of fixed size of the classes' low bits."""
    b = F.pmod("class", F.lit(FILTER_BITS))
    words = classes.select(b.alias("b")).groupBy(F.shiftright("b", 5).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 AS int)))").alias("v")).toPandas()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint32)
    return table


def _may_hold(table: np.ndarray, cls: np.ndarray) -> np.ndarray:
    b = cls & (FILTER_BITS - 1)
    return ((table[b >> 5] >> (b & 31).astype(np.uint32)) & 1).astype(bool)


def nearest(members: DataFrame, links: DataFrame, k: int = K) -> DataFrame:
    """(chunk_id, other_id, similarity): the k most similar other chunk_ids of each, as far as links has them.

    Equal vectors come first, by chunk_id; of equally similar chunk_ids those with the smaller id count. A class of many
    copies is represented by its k + 1 smallest ids, so each chunk_id gets at most k rows.
    """
    linked = links.select("class").distinct()
    copied = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    members = members.join(linked.unionByName(copied).distinct(), "class", "left_semi")  # the others have no row
    salted = Window.partitionBy("class", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).orderBy("chunk_id")
    first = Window.partitionBy("class").orderBy("chunk_id")
    some = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    some = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select(F.col("class").alias("other"), F.col("chunk_id").alias("other_id"))
    own = members.select("class").distinct().select("class", F.col("class").alias("other"), F.lit(1.0).alias("similarity"))
    # candidates of a class: at most a few of its nearest classes matter
    by = Window.partitionBy("class").orderBy(F.desc("similarity"), "other")
    near = links.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).drop("r").unionByName(own)
    cand = near.join(some, "other")
    top = Window.partitionBy("class").orderBy(F.desc(F.col("class") == F.col("other")), F.desc("similarity"), "other_id")
    cand = cand.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    out = members.join(cand, "class").where("chunk_id <> other_id")
    last = Window.partitionBy("chunk_id").orderBy("r")
    return out.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).select("chunk_id", "other_id", "similarity")


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = similar_vectors(read_table(spark, sf_dir, "vectors"))
    return nearest(members, links)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = p3_neighbours(spark, sf_dir)
    return n.select(F.least("chunk_id", "other_id").alias("chunk_id_1"), F.greatest("chunk_id", "other_id").alias("chunk_id_2")).distinct()
