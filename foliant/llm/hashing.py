"""Words of whole texts as 64-bit hashes, computed on byte arrays instead of one word at a time.

A word is a maximal run of a-z or 0-9 after lower-casing. Its hash is a polynomial in an odd base over
random values of its bytes, modulo 2^64 and mixed afterwards: with prefix sums over the whole buffer,
every word costs two look-ups, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 1 << 20  # bytes handled at once; bounds the temporary arrays, however long a text is
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        for k, b in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            _POW[k] = np.cumprod(a)
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted different values; np.unique takes many times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(at, append=len(x))


def _windows(n: int, bounds: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """[a, b) parts of at most about WINDOW bytes that don't cut a word."""
    a = 0
    while a < n:
        b = min(n, a + WINDOW)
        if b < n:
            step = 64
            while b < n and is_word[b]:
                gap = np.flatnonzero(~is_word[b : b + step])
                b, step = (b + int(gap[0]), step) if len(gap) else (min(n, b + step), step * 4)
        yield a, b
        a = b


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, offsets: words of text i are [offsets[i], offsets[i+1]))."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    is_word = _WORD[data]
    hashes, starts = [], []
    for a, b in _windows(len(data), ends, is_word):
        w = np.zeros(b - a + 2, np.int8)
        w[1:-1] = is_word[a:b]
        edge = np.diff(w)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            continue
        p, inv = _powers(max(WINDOW + 4096, b - a))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * p[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64)))
        starts.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.searchsorted(np.concatenate(starts), ends)
    return np.concatenate(hashes), np.concatenate([[0], at]).astype(np.int64)


def run_hashes(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words that stays inside one text, offsets by text)."""
    n = np.maximum(np.diff(offsets) - k + 1, 0)
    out = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], n)
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total = total * _U(0xD6E8FEB86659FD93) + h[at + j]
    return mix(total), out


def texts_of(batch, column: str, window: int = 4 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """(from, to, texts) of an Arrow batch in parts of at most about ``window`` bytes; a longer text is alone."""
    col = batch.column(column)
    size, a, texts = 0, 0, []
    for i, x in enumerate(col):
        t = x.as_py()
        if texts and size + len(t or "") > window:
            yield a, i, texts
            size, a, texts = 0, i, []
        texts.append(t)
        size += len(t or "")
    if texts:
        yield a, len(col), texts
