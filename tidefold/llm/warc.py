"""WARC archives with a two-level capture index.

Writing: one record a page, each one or more gzip members of its own, so that any record can
be read by offset and length. Pages whose payload another page has already are
written as revisits. Tasks write files of bounded size under names of their own; only
files whose task ended well are in the table of captures that comes back.

Index: captures in order of their keys (host names reversed, then the path), dealt to
shards by ranges of keys. A shard's captures are cut into compressed blocks, one after
another in one file; the directory has one small row a block: its first and last key and where it lies.
A look-up finds the shard by binary search over the shards' bounds, the block by binary
search over the shard's part of the directory, and the captures by binary search in the
block; it reads that block's range and then those of the records, all in tasks.

Archives and index lie in a store that the executors reach by Arrow's file systems.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.shared import new_path, table, text_batches, tidy, written
from tidefold.sources import files

MEMBER_BYTES = 8 << 20
FILE_BYTES = 1 << 30
BLOCK_LINES = 3000
LEAST_REVISIT = 100
KEY_CHARS = 1000
READ_BYTES = 1 << 20  # read at once, when more records may follow
TASK_BYTES, MAX_TASKS = 16 << 20, 100_000  # of archives read by a task
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long"
BLOCK = "shard int, first_key string, last_key string, lines long, file string, offset long, length long"


def capture_key(url: Column) -> Column:
    """Reversed host, ')' and the rest in lower case, without scheme, user, port, 'www' and fragment.

    Spaces and control characters, written as such or by their number, don't count.
    Of a longer key the first KEY_CHARS characters stay, and a digest.
    """
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]|%(?:[01][0-9A-Fa-f]|20|7[Ff])", "")
    at = F.instr(clean, "://")
    rest = F.substring_index(F.when(at > 0, F.substring(clean, at + 3, F.length(clean))).otherwise(""), "#", 1)
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    path = F.lower(F.substring(rest, F.length(host) + 1, F.length(rest)))
    name = F.regexp_replace(F.regexp_replace(F.substring_index(F.lower(host), "@", -1), r":\d*$", ""), r"^www\d*\.", "")
    key = F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), F.lit(")"), path)
    return F.when(F.length(key) > KEY_CHARS, F.concat(F.substring(key, 1, KEY_CHARS), F.lit(" "), F.sha2(key, 256))).otherwise(key)


def _record(page_id, url, payload: bytes, digest: str, first_id) -> bytes:
    revisit = first_id is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first_id}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _members(record: bytes) -> bytes:
    out = []
    for at in range(0, len(record), MEMBER_BYTES):
        to = zlib.compressobj(3, zlib.DEFLATED, 31)
        out.append(to.compress(record[at : at + MEMBER_BYTES]) + to.flush())
    return b"".join(out)


class _Files:
    """Files of one task in a folder, each closed when it has `most` bytes."""

    def __init__(self, folder: str, suffix: str, most: int):
        self.folder, self.suffix, self.most, self.out = folder, suffix, most, None
        self.store, self.path = fs.FileSystem.from_uri(folder)

    def add(self, data: bytes) -> tuple[str, int]:
        """Write data; the file's name and the place of data in it."""
        if self.out is None:
            self.store.create_dir(self.path)
            name = f"{uuid.uuid4().hex}{self.suffix}"
            self.name, self.at, self.out = f"{self.folder}/{name}", 0, self.store.open_output_stream(f"{self.path}/{name}", compression=None)
        place = self.name, self.at
        self.out.write(data)
        self.at += len(data)
        if self.at >= self.most:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _write(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    out = _Files(path, ".warc.gz", most)
    try:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):  # one page's text at a time
                key, page_id, url, html, digest, first = (c[i].as_py() for c in batch.columns)
                data = _members(_record(page_id, url, (html or "").encode(), digest, first))
                rows.append((key, page_id, *out.add(data), len(data)))
            yield _rows(rows, CAPTURE)
    finally:
        out.close()
    tidy()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, most: int = FILE_BYTES) -> DataFrame:
    """Write a record for every page into archives under path: (key, page_id, file, offset, length) of each.

    Null html counts as empty, a null url as an empty target, rows without an id as page
    "none". Of equal payloads of `least` bytes and more that of the smallest id is the
    response; rows that repeat its id are responses too. An archive is closed when it has
    `most` bytes, so it is longer by one record at most; a record, however long, is held
    whole once, compressed in members of 8 MB. Other columns are not looked at. An empty table
    gives no archive. Sets the session's Arrow batches to 1000 rows at most.
    """
    text_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = rows.withColumns({"key": capture_key(F.col("url")), "digest": F.sha2(payload, 256), "size": F.octet_length(payload)})
    copies = written(
        rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("d"), "first"), "copies"
    )
    rows = rows.join(copies, (F.col("digest") == F.col("d")) & (F.col("size") >= least), "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    data = rows.select("key", "page_id", "url", "html", "digest", first)
    return written(data.mapInArrow(lambda it: _write(it, path, most), CAPTURE), "captures")


def records(source) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of all records of an archive, given as bytes or a stream."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    held, buffer, at, start, want = bytearray(), b"", 0, 0, -1
    while buffer or (buffer := stream.read(1 << 16)):
        to = zlib.decompressobj(31)
        while not to.eof:
            if not buffer and not (buffer := stream.read(1 << 16)):
                raise ValueError(f"the archive ends inside the record at {start}")
            held += to.decompress(buffer)
            at += len(buffer) - len(to.unused_data)
            buffer = to.unused_data
        if want < 0 and (head := held.find(b"\r\n\r\n")) >= 0:
            want = int(re.search(rb"\r\nContent-Length: (\d+)", held[: head + 2])[1]) + head + 8
        if 0 <= want <= len(held):
            yield start, at - start, bytes(held)
            start, want = at, -1
            held.clear()
    if held:
        raise ValueError(f"the archive ends inside the record at {start}")


def parse(record: bytes) -> dict:
    """The fields of a record; payload is None for a revisit, payload_bytes is always that of the full payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: None if x is None or "none" in x else int(x[10:-1])  # noqa: E731  <urn:page:N>
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "payload": payload if kind == "response" else None,
        "payload_bytes": len(payload) if kind == "response" else size, "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"][7:],
        "refers_to": number(fields.get("WARC-Refers-To")),
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0).to_pylist():
            store, path = fs.FileSystem.from_uri(file)
            rows = []
            with store.open_input_stream(path, compression=None) as stream:
                for offset, length, record in records(stream):
                    head = dict(line.split(": ", 1) for line in record[: record.find(b"\r\n\r\n")].decode().split("\r\n")[1:])
                    page = re.fullmatch(r"<urn:page:(-?\d+)>", head["WARC-Record-ID"])
                    rows.append((head["WARC-Target-URI"], int(page[1]) if page else None, file, offset, length))
                    if len(rows) == 1000:
                        yield _rows(rows, "url string, page_id long, file string, offset long, length long")
                        rows = []
            yield _rows(rows, "url string, page_id long, file string, offset long, length long")


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder, found by reading them through: as write_archives() gives them, up to the keys of odd urls."""
    names = [n for n in files.listed(spark, path) if n.endswith(".warc.gz")]
    there = spark.createDataFrame(pa.table({"file": pa.array([f"{path}/{n}" for n in names], pa.string())}))
    found = there.repartition(max(1, len(names))).mapInArrow(_scan, "url string, page_id long, file string, offset long, length long")
    return found.select(capture_key(F.col("url")).alias("key"), "page_id", "file", "offset", "length")


@dataclass
class Index:
    """directory: one row a block (BLOCK), in a table of its own. bounds: (first key, last key, shard) of every shard in order, one a task that made the index."""

    directory: DataFrame
    bounds: list[tuple[str, str, int]]


def _squeeze(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    out, held, shard = _Files(path, ".idx", 1 << 62), [], TaskContext.get().partitionId()

    def block() -> pa.RecordBatch:
        blob = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
        row = shard, held[0][0], held[-1][0], len(held), *out.add(blob), len(blob)
        held.clear()
        return _rows([row], BLOCK)

    try:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == most:
                    yield block()
        if held:
            yield block()
    finally:
        out.close()


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> Index:
    """The index of captures (key, page_id, file, offset, length), its blocks in files under path. A key that is everywhere goes over several shards."""
    rows = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    directory = written(rows.mapInArrow(lambda it: _squeeze(it, path, block_lines), BLOCK), "directory")
    bounds = directory.groupBy("shard").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    return Index(directory, sorted((r["low"], r["high"], r["shard"]) for r in bounds))


def lines(block: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(block).decode().split("\n")]


class _Ranges:
    """Ranges of files, read one after another; what is read ahead serves those that follow."""

    def __init__(self):
        self.name, self.at, self.data, self.file = None, 0, b"", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            store, path = fs.FileSystem.from_uri(name)
            self.name, self.at, self.data, self.file = name, 0, b"", store.open_input_file(path)
        if not self.at <= offset <= offset + length <= self.at + len(self.data):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(max(length, READ_BYTES))
        return self.data[offset - self.at : offset - self.at + length]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def look_up(index: Index, keys: DataFrame) -> DataFrame:
    """The captures (key, page_id, file, offset, length) of keys (key): every one whose key is asked, once, in any order."""
    bounds = index.bounds
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]

    def deal(batches):
        for batch in batches:
            rows = [(bounds[i][2], key) for key in batch.column(0).to_pylist() for i in range(bisect_left(highs, key), bisect_right(lows, key))]
            yield _rows(rows, "shard int, key string")

    def search(key, asked: pa.Table, directory: pa.Table) -> pa.Table:
        blocks = sorted(zip(*(directory.column(c).to_pylist() for c in ("first_key", "last_key", "file", "offset", "length"))))
        firsts, lasts = [b[0] for b in blocks], [b[1] for b in blocks]
        ranges, open_, rows, own, out = _Ranges(), -1, [], [], []
        for wanted in sorted(asked.column("key").to_pylist()):
            for i in range(bisect_left(lasts, wanted), bisect_right(firsts, wanted)):
                if i != open_:
                    open_, rows = i, lines(ranges.read(*blocks[i][2:]))
                    own = [r[0] for r in rows]
                out += rows[bisect_left(own, wanted) : bisect_right(own, wanted)]
        ranges.close()
        return pa.Table.from_batches([_rows(out, CAPTURE)])

    asked = keys.select("key").where("key IS NOT NULL").distinct().mapInArrow(deal, "shard int, key string")
    return asked.groupBy("shard").cogroup(index.directory.groupBy("shard")).applyInArrow(search, CAPTURE)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(captures: DataFrame, payload: bool = False) -> DataFrame:
    """The records of captures (file, offset, length), each read by its range: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Captures are dealt by file and place, so a task reads along a part of few archives; no record is shuffled.
    """
    schema = RECORD + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches):
        ranges = _Ranges()
        for batch in batches:
            rows, size = [], 0
            for place in zip(*(c.to_pylist() for c in batch.columns)):
                for _, _, record in records(ranges.read(*place)):
                    found = parse(record)
                    rows.append(tuple(found[n] for n in names))
                    size += payload * len(record)
                if size > READ_BYTES:
                    yield _rows(rows, schema)
                    rows, size = [], 0
            yield _rows(rows, schema)
        ranges.close()
        tidy()

    places = written(captures.select("file", "offset", "length"), "places")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(MAX_TASKS, -(-total // TASK_BYTES)))  # by the bytes that are read: the places themselves are few
    return places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives; then the keys of all pages are looked up and the records found are read back."""
    path = new_path(spark, "archives")
    pages = table(spark, sf_dir, "pages")
    index = build_index(write_archives(pages, path), f"{path}-index")
    found = look_up(index, pages.select(capture_key(F.col("url")).alias("key")))
    return read_records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
