"""Packing of documents into training sequences by best-fit decreasing.

Each task packs its documents in groups of a bounded number of tokens. In a group,
documents longer than a sequence are first cut into full sequences; what is left,
longest first, goes to the open sequence with the least room that still fits. A
segment tree indexed by remaining room finds that sequence. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.shared import table, text_batches, tidy
from tidefold.llm.tokens import encoder

GROUP_TOKENS = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"


class RoomTree:
    """Open sequences by remaining room; the tightest that fits is found along one path of the tree."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.leaves
        while at:
            self.some[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room >= need, taken out; None if there is none."""
        at = need + self.leaves
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):  # up until a right neighbour holds something
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.some[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """For pieces of at most `size`: each one's sequence, its offset there, and the number of sequences."""
    tree, sequence, offset, n = RoomTree(size), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := tree.take(lengths[i])) is None:
            room, sequence[i], n = size, n, n + 1
        else:
            room, sequence[i] = found
        offset[i] = size - room
        if room > lengths[i]:
            tree.add(room - lengths[i], sequence[i])
    return sequence, offset, n


def _packed(docs: list[tuple[int | None, bytes]], size: int, base: int) -> tuple[pa.RecordBatch, int]:
    pieces = []
    for doc_id, ids in docs:
        n = len(ids) // 4
        pieces += [(doc_id, at, min(size, n - at), ids[4 * at : 4 * min(n, at + size)], n) for at in range(0, n, size)]
    sequence, offset, n = best_fit([p[2] for p in pieces], size)
    fill = np.bincount(sequence, weights=[p[2] for p in pieces], minlength=n).astype(np.int64)[sequence]
    padded = np.where(fill & (fill - 1) == 0, fill, size)
    cols = list(zip(*pieces))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    arrays = [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array(np.array(sequence, np.int64) + base), pa.array(offset, pa.int64()), pa.array(fill), pa.array(padded)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")]), n


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, group: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path).encode, end_id.to_bytes(4, "little")
    base = TaskContext.get().partitionId() << 36
    docs: list[tuple[int | None, bytes]] = []
    held = 0

    def out() -> pa.RecordBatch:
        nonlocal base, held
        batch, n = _packed(docs, size, base)
        base, held = base + n, 0
        docs.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).cast(pa.large_binary())):
            docs.append((doc_id, encode(text.as_py() or b"") + end))
            held += len(docs[-1][1]) // 4
            if held >= group:
                yield out()
    if docs:
        yield out()
    encoder(path).forget()
    tidy()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, size: int = 2048, group: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids, doc_tokens, sequence_id, offset,
    sequence_tokens (of the whole sequence), padded_tokens (its length when padded: size, or what it holds if that is a power of two).

    tokenizer: path of a tokenizer file that never looks across white space. ids:
    unsigned 32-bit, little-endian. Every document ends with end_id; a null or empty
    text is that id alone. Rows without an id keep a null doc_id, repeated rows are
    packed each for itself, other columns are not looked at. A group of about
    `group` tokens is packed at a time, so memory is bounded by that and the longest
    text. Of pieces equally long the one that comes first is placed first, of sequences
    with equal room the one that got it last is filled. An empty table gives an empty table.
    Sets the session's Arrow batches to 1000 rows at most.
    """
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lambda it: _pack(it, tokenizer, end_id, size, group), SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4(spark, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens")
