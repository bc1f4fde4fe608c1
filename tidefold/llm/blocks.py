"""Blocks of documents: a few MB of rows as one compressed row of a bucketed table.

Operators that pass over all texts several times, each time with something that
the corpus said about them, keep the rows in blocks: a block is read without a
shuffle, and what belongs to it is sent to it by its number alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidefold.llm.shared import bucketed, partitions, read_bytes, text_batches, tidy

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 60_000
BUCKET_BYTES, MAX_BUCKETS = 512 << 20, 100_000


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes, columns: list[str] | None = None) -> pa.Table:
    """A block's rows; with columns, only these are decompressed."""
    if columns is None:
        return pa.ipc.open_stream(blob).read_all()
    names = pa.ipc.open_stream(blob).schema.names
    fields = sorted(names.index(c) for c in columns)
    return pa.ipc.open_stream(blob, options=pa.ipc.IpcReadOptions(included_fields=fields)).read_all()


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = rows = n = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([part + n], pa.int64()), "n_rows": pa.array([rows], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "rows": pa.array([pack(pa.Table.from_batches(held))], pa.binary())})

    for batch in batches:
        step = max(1, min(BLOCK_ROWS // 8, int(batch.num_rows * (most // 8) / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            if held and (size + piece.nbytes > most or rows + piece.num_rows > BLOCK_ROWS):
                yield out()
                held, size, rows, n = [], 0, 0, n + 1
            held.append(piece)
            size, rows = size + piece.nbytes, rows + piece.num_rows
    if held:
        yield out()
    held = []
    tidy()


def blocks(df: DataFrame, name: str, most: int = BLOCK_BYTES) -> DataFrame:
    """A bucketed table (block, n_rows, n_bytes, rows) with all rows and columns of df, `most` bytes a block.

    It has as many buckets as shuffles have partitions, or more where a bucket would
    hold more than BUCKET_BYTES of df's sources.
    """
    buckets = min(MAX_BUCKETS, max(partitions(df.sparkSession), read_bytes(df) // BUCKET_BYTES))
    text_batches(df.sparkSession)
    schema = "block long, n_rows long, n_bytes long, rows binary"
    return bucketed(df.mapInArrow(lambda it: _cut(it, most), schema), name, "block", buckets)


def split(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes, cut by their upper bits."""
    at = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1))) if len(at) else []
    return [(int(at[i]), int(i), int(j)) for i, j in zip(cuts, [*cuts[1:], len(h)])]


def across_blocks(held: DataFrame, hashes: Callable[[pa.Table, np.ndarray | None], np.ndarray], buckets: int, known: DataFrame | None = None) -> DataFrame:
    """(block, h): for each block those of its hashes that other blocks have too, packed as 64-bit numbers.

    hashes: from a block's rows and, where known (block, h) is given, what that has of the block, sorted.
    A block sends each of its different hashes once, so one that is everywhere brings
    as many entries into its bucket as there are blocks.
    """
    def send(block: int, h: np.ndarray) -> pa.RecordBatch:
        h = np.unique(h[np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0])
        cut = split(h, buckets)
        return pa.RecordBatch.from_pydict({"bucket": pa.array([c[0] for c in cut], pa.int64()), "block": pa.array([block] * len(cut), pa.int64()), "h": pa.array([h[i:j].tobytes() for _, i, j in cut], pa.binary())})

    def send_all(batches):
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                yield send(block, hashes(unpack(blob), None))
        tidy()

    def send_known(key, block: pa.Table, own: pa.Table) -> pa.Table:
        tidy()
        if not block.num_rows or not own.num_rows:
            return pa.Table.from_batches([send(0, np.zeros(0, np.uint64))])
        return pa.Table.from_batches([send(key[0].as_py(), hashes(unpack(block.column("rows")[0].as_py()), joined(own.column("h"))))])

    def in_two(group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint64) for x in group.column("h").to_pylist()]
        values, counts = np.unique(np.concatenate(blobs), return_counts=True)
        values = values[counts > 1]
        kept = [np.intersect1d(x, values, assume_unique=True).tobytes() for x in blobs]
        return pa.table({"block": group.column("block").cast(pa.int64()), "h": pa.array(kept, pa.binary())}).filter(pa.array([bool(k) for k in kept], pa.bool_()))

    rows, schema = held.select("block", "rows"), "bucket long, block long, h binary"
    sent = rows.mapInArrow(send_all, schema) if known is None else rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send_known, schema)
    return sent.groupBy("bucket").applyInArrow(in_two, "block long, h binary")


def joined(col: pa.ChunkedArray) -> np.ndarray:
    """Packed 64-bit numbers of several rows, sorted."""
    return np.sort(np.frombuffer(b"".join(col.to_pylist()), np.uint64))
