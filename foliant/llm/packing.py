"""Problem 6: put texts together into training windows of fixed capacity.

Method: vector bin packing. Every text has a size in several dimensions (tokens, segments, loss-bearing tokens)
and every window a limit in each. A window takes, as long as anything fits, the text whose size has the largest
dot product with the room that is left, weighted by how scarce each dimension is.

Only ids and sizes are shuffled. Texts are spread over blocks of bounded size that are packed on their own; the
windows that a block leaves under-filled are broken up and packed together in a second round, again in blocks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import cut_lineage, read_table
from foliant.llm.hashing import texts_of

CAPACITY, MAX_SEGMENTS = 8192, 64
BLOCK = 6_000  # texts packed by one task at once
FILLED = 0.97  # windows below this share of the capacity are packed again
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_TURN = re.compile(r"\n[QA]:")
#: Pre-splitting pattern of the public byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding_of(table: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoding(path: str):
    with open(path, "rb") as f:
        return _encoding_of(f.read())


def _tokens(enc, text: str, step: int = 1 << 20) -> Iterator[list[int]]:
    """Tokens of a text; very long ones are encoded in parts that end before white space."""
    a = 0
    while a < len(text):
        b = min(len(text), a + step)
        while b < len(text) and not (text[b].isspace() and not text[b - 1].isspace()) and b < a + 2 * step:
            b += 1
        yield enc.encode_ordinary(text[a:b])
        a = b


def _count(enc, text: str, step: int = 1 << 20) -> int:
    return sum(map(len, _tokens(enc, text, step)))


def _answers(enc, text: str) -> tuple[int, int]:
    """(tokens, tokens that begin in an answer) of a text of questions and answers."""
    marks = [(len(text[: m.start()].encode("utf-8", "replace")), m.group() == "\nA:") for m in _TURN.finditer(text)]
    size = np.array([len(enc.decode_single_token_bytes(x)) for part in _tokens(enc, text) for x in part], np.int64)
    turn = np.searchsorted([at for at, _ in marks], np.cumsum(size) - size, "right") - 1
    answer = np.array([a for _, a in marks] + [False])  # the last stands for what comes before all marks
    return len(size), int(answer[turn].sum())


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, loss_tokens) of each row, counted over the whole text. Loss-bearing are the answers (from a line
    ``A:`` to the next ``Q:``) of a text in question and answer form, else the whole text. Null and empty texts have 0 tokens."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    with open(vocabulary, "rb") as f:
        table = documents.sparkSession.sparkContext.broadcast(f.read())  # about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding_of(table.value)
        for batch in batches:
            for a, b, texts in texts_of(batch, "text"):
                tokens, loss = [], []
                for t in texts:
                    t = t or ""
                    n, answers = _answers(enc, t) if t.startswith("Q:") and "\nA:" in t else (_count(enc, t), None)
                    tokens.append(n)
                    loss.append(n if answers is None else answers)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(tokens, pa.int64()), pa.array(loss, pa.int64())], ["doc_id", "tokens", "loss_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, tokens long, loss_tokens long")


def pack_block(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Window number of each row of ``sizes`` (items by dimensions), none of which exceeds ``limits``.

    Equal rows are one class with a stock, so a step looks at the different sizes only.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    kinds, inverse, stock = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    scaled = kinds / limits
    weight = (sizes.sum(0) / limits) / max((sizes.sum(0) / limits).max(), 1e-12)  # scarcer dimensions weigh more
    big = np.argsort(-(scaled * weight).sum(1), kind="stable")
    kinds, scaled, stock = kinds[big], scaled[big], stock[big]
    place = np.empty(len(big), np.int64)
    place[big] = np.arange(len(big))
    rows = np.argsort(place[inverse], kind="stable")
    first = np.concatenate([[0], np.cumsum(stock)])[:-1]
    used = np.zeros(len(kinds), np.int64)
    out = np.empty(len(sizes), np.int64)
    window, head = 0, 0
    live = np.arange(len(kinds))
    while True:
        while head < len(kinds) and used[head] == stock[head]:
            head += 1
        if head == len(kinds):
            return out
        if len(live) > 64 and np.count_nonzero(used[live] < stock[live]) < len(live) // 2:
            live = live[used[live] < stock[live]]
        room = limits.astype(np.int64).copy()
        k, fits = head, live
        while True:
            out[rows[first[k] + used[k]]] = window
            used[k] += 1
            room -= kinds[k]
            fits = fits[(used[fits] < stock[fits]) & (kinds[fits] <= room).all(1)]
            if not len(fits):
                break
            k = fits[np.argmax(scaled[fits] @ (weight * room / limits))]
        window += 1


def _pack_frames(limits: tuple[int, int, int], tag: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = np.stack([table["tokens"].to_numpy(), np.ones(table.num_rows, np.int64), table["loss_tokens"].to_numpy()], 1)
        win = pack_block(sizes, np.array(limits, np.int64))
        fill = np.bincount(win, sizes[:, 0])[win] if len(win) else np.zeros(0)
        name = [f"{tag}{key[0].as_py()}-{w}" for w in win]
        return pa.table({**{c: table[c] for c in ("doc_id", "part", "parts", "tokens", "loss_tokens")}, "window_id": pa.array(name, pa.string()), "fill": pa.array(fill.astype(np.int64))})

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, window_id, part, parts, tokens, loss_tokens, oversize) from (doc_id, tokens, loss_tokens).

    Every row gets a window, repeated and null doc_ids too. Texts within the limits stay whole. A text that alone
    exceeds ``capacity`` tokens or ``max_loss`` loss-bearing ones (by default ``capacity``, so that no text that
    fits a window is cut) is ``oversize``: it is cut into full parts that fill windows of their own, and a rest that
    is packed like any text. Null sizes count as 0.
    """
    max_loss = capacity if max_loss is None else max_loss
    limits = (capacity, max_segments, max_loss)
    t, z = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("loss_tokens", F.lit(0)).cast("long")
    s = sizes.select("doc_id", t.alias("tokens"), z.alias("loss_tokens"))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("tokens") / capacity), F.ceil(F.col("loss_tokens") / max_loss))
    s = cut_lineage(s.withColumn("parts", parts))
    blocks = max(1, -(-s.count() // block))
    over = s.where("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    share = lambda c, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n).cast("long"), F.col(c) - F.col("part") * n))
    full = over.select("doc_id", "part", "parts", share("tokens", capacity).alias("tokens"), share("loss_tokens", max_loss).alias("loss_tokens"))
    whole = s.where("parts = 1").select("doc_id", F.lit(0).cast("long").alias("part"), "parts", "tokens", "loss_tokens").unionByName(full)
    # row numbers of what was checkpointed: the same when a task runs again, and repeated ids go to different blocks
    todo = whole.withColumn("block", F.pmod(F.xxhash64("doc_id", "part", F.monotonically_increasing_id()), F.lit(blocks)))
    schema = f"doc_id {sizes.schema['doc_id'].dataType.simpleString()}, part long, parts long, tokens long, loss_tokens long, window_id string, fill long"
    one = cut_lineage(todo.groupBy("block").applyInArrow(_pack_frames(limits, "a"), schema))
    low = F.col("fill") < FILLED * capacity
    left = one.where(low)
    again = max(1, -(-left.count() // block))
    two = left.withColumn("block", F.pmod(F.xxhash64("window_id"), F.lit(again))).drop("window_id", "fill")
    two = two.groupBy("block").applyInArrow(_pack_frames(limits, "b"), schema)
    out = one.where(~low).unionByName(two)
    return out.select("doc_id", "window_id", "part", "parts", "tokens", "loss_tokens", (F.col("parts") > 1).alias("oversize"))


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_sizes(read_table(spark, sf_dir, "documents")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_windows(spark, sf_dir).where("oversize").select("doc_id").distinct()
