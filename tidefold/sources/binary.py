"""The store's binary files: logs, sorted tables with their filters, and hint files.

Whole files are read by Spark and decoded task by task, one file at a time. Sinks write
one file a task or run, from the tasks, to any store that Arrow's file systems reach;
a file appears under its name only when it is whole.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import bloom
from tidefold.plans.model import HINT, HINT_CAP
from tidefold.sources import files

#: Fixed values of the formats.
MAGIC, FOOTER = 0xDEADBEEF, "<qqIII"
TOMBSTONE = b"__TOMBSTONE__"


def encode_log(records: list[tuple[int, int, bytes, bytes]]) -> bytes:
    """Records (ts, op, key, value) as a log file's bytes."""
    return b"".join(struct.pack("<qBI", ts, op, len(k)) + k + struct.pack("<I", len(v)) + v for ts, op, k, v in records)


def decode_log(data: bytes, torn_tail: str = "ignore") -> Iterator[tuple[int, int, bytes, bytes]]:
    """The records in order. An incomplete last record is passed over, or an error with torn_tail='fail'."""
    at = 0
    while at < len(data):
        end = at + 13
        if end <= len(data):
            ts, op, n = struct.unpack_from("<qBI", data, at)
            end += n + 4
            if end <= len(data):
                m = struct.unpack_from("<I", data, end - 4)[0]
                if end + m <= len(data):
                    yield ts, op, data[at + 13 : at + 13 + n], data[end : end + m]
                    at = end + m
                    continue
        if torn_tail == "fail":
            raise ValueError(f"the log ends inside a record at {at}")
        return


def encode_table(records: list[tuple[bytes, bytes]], bloom: bytes = struct.pack("<II", 8, 1) + b"\xff") -> bytes:
    """Sorted records (key, value) as a table file's bytes; bloom: the filter's, as operators.bloom.filters() gives them."""
    body, index = [], []
    at = 0
    for k, v in records:
        index.append(struct.pack("<I", len(k)) + k + struct.pack("<q", at))
        body.append(struct.pack("<I", len(k)) + k + struct.pack("<I", len(v)) + v)
        at += len(body[-1])
    places = b"".join(index)
    return b"".join([*body, places, bloom, struct.pack(FOOTER, at, at + len(places), len(bloom), len(records), MAGIC)])


def _footer(data: bytes) -> tuple[int, int, int, int]:
    """(offset of the index, of the filter, length of the filter, records)."""
    if len(data) < 28:
        raise ValueError("the file is too small for a table")
    stop, places, size, count, magic = struct.unpack_from(FOOTER, data, len(data) - 28)
    if magic != MAGIC:
        raise ValueError("the file is no table")
    if not 0 <= stop <= places or places + size + 28 != len(data):
        raise ValueError("the table's footer doesn't fit its file")
    return stop, places, size, count


def decode_table(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The records of a table file in order; its index must have every one of them at its place."""
    stop, places, _, count = _footer(data)
    at = found = 0
    listed = stop
    while at < stop:
        n = struct.unpack_from("<I", data, at)[0]
        m = struct.unpack_from("<I", data, at + 4 + n)[0]
        if data[listed : listed + 12 + n] != data[at : at + 4 + n] + struct.pack("<q", at):
            raise ValueError(f"the index doesn't have the record at {at}")
        yield data[at + 4 : at + 4 + n], data[at + 8 + n : at + 8 + n + m]
        at, found, listed = at + 8 + n + m, found + 1, listed + 12 + n
    if found != count or listed != places:
        raise ValueError(f"the table has {found} records instead of {count}")


def decode_filter(data: bytes) -> bytes:
    """The bytes of a table file's filter."""
    _, places, size, _ = _footer(data)
    return data[places : places + size]


def _put(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    aside = f"{path}/.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(data)
    store.move(aside, f"{path}/{name}")


def write_logs(records: DataFrame, path: str) -> DataFrame:
    """Append records (seq, ts_ns, op, k, v) to the folder of logs at path, in order of seq within a file, one new file a task: (file, n)."""
    def rows(batches):
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if held:
            name = f"wal-{uuid.uuid4().hex}.log"
            _put(path, name, encode_log([(ts, op, (k or "").encode(), v or b"") for ts, op, k, v in held]))
            yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "n": pa.array([len(held)], pa.int64())})

    ordered = records.repartitionByRange("seq").sortWithinPartitions("seq").select("ts_ns", "op", "k", F.col("v").cast("binary"))
    return ordered.mapInArrow(rows, "file string, n long")


def reset_logs(spark: SparkSession, path: str) -> None:
    """Empty a folder of logs, when what they say is in a run."""
    files.delete(spark, path)


def write_tables(runs: DataFrame, path: str, m: int, k: int) -> DataFrame:
    """Write each run (tid, k, op, v) with its filter as sstable_<tid>.db under path: (tid, records, bytes). A task holds one run."""
    def one(key, records: pa.Table, filters: pa.Table) -> pa.Table:
        rows = sorted((x.encode(), TOMBSTONE if op == 2 else v or b"") for x, op, v in zip(*(records.column(c).to_pylist() for c in ("k", "op", "v"))))
        data = encode_table(rows, filters.column("filter")[0].as_py())
        tid = key[0].as_py()
        _put(path, f"sstable_{tid}.db", data)
        return pa.table({"tid": pa.array([tid], pa.int64()), "records": pa.array([len(rows)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    rows = runs.select("tid", "k", "op", F.col("v").cast("binary").alias("v")).groupBy("tid")
    return rows.cogroup(bloom.filters(bloom.bits(runs, m, k), m, k).groupBy("tid")).applyInArrow(one, "tid long, records long, bytes long")


def read_logs(spark: SparkSession, path: str, torn_tail: str = "ignore") -> DataFrame:
    """(file, seq, ts_ns, op, k, v): seq counts the records of a file from 0; v is null for a deletion."""
    def rows(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [(file, i, ts, op, k, None if op == 2 else v) for i, (ts, op, k, v) in enumerate(decode_log(data.as_py(), torn_tail))]
                cols = list(zip(*found)) or [()] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file", "seq", "ts_ns", "op", "k", "v"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, seq long, ts_ns long, op int, k binary, v binary")
    return out.withColumn("k", F.col("k").cast("string"))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(tid, k, op, v): table ids are numbers taken from the file names."""
    def rows(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [(file, k, 2 if v == TOMBSTONE else 1, None if v == TOMBSTONE else v) for k, v in decode_table(data.as_py())]
                cols = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int32(), pa.binary()))], names=["file", "k", "op", "v"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, k binary, op int, v binary")
    return out.select(F.regexp_extract("file", r"sstable_(\d+)\.db$", 1).cast("long").alias("tid"), F.col("k").cast("string").alias("k"), "op", "v")


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """(tid, filter): the filters of table files."""
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_filter(x.as_py()) for x in batch.column(1)], pa.binary())], names=["file", "filter"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, filter binary")
    return out.select(F.regexp_extract("file", r"sstable_(\d+)\.db$", 1).cast("long").alias("tid"), "filter")


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """Hint files (JSON lists, values in base64); files that are no JSON are passed over."""
    return spark.read.schema(HINT).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)


def write_hints(hints: DataFrame, path: str, cap: int = HINT_CAP) -> None:
    """Hints (target_node, k, ver, op, v, created_at) as one file of a JSON list for each of their nodes; other nodes' files stay.

    Each node has its first `cap` hints, so a list is bounded. A deletion's value is its marker.
    """
    from tidefold.operators import handoff

    value = F.when(F.col("op") == 2, F.lit(TOMBSTONE.decode())).otherwise(F.col("v"))
    record = F.struct(
        "target_node", F.col("k").alias("key"), F.base64(F.encode(value, "UTF-8")).alias("value"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("timestamp"),
        F.col("ver").alias("version"), F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
    )
    each = handoff.capped(hints, cap).groupBy(F.col("target_node").alias("node")).agg(F.array_sort(F.collect_list(F.struct("created_at", "ver", record.alias("record")))).alias("all"))
    lists = each.select("node", F.to_json(F.transform("all", lambda r: r["record"])).alias("value"))
    lists.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("node").text(path)
