"""Removal of passages that also occur earlier in the corpus, by level-wise doubling.

A window is n consecutive words of one document. A window is a repeat if the
same words also start earlier: in a document with a smaller id, or earlier in the
same document. All words covered by repeats go.

Levels: 5, 10, 20 words, in general twice as many until n. At each length, every window
of n words that is still a candidate is stood for by the smallest hash among the
windows of that length inside it, so equal windows are stood for by equal hashes, and
few positions are looked at. Only those whose stand-in another block has too
are extended to the next length; when none is left, no further length is looked at.
At the full length windows are compared by 128 bits, made of the 64-bit hashes of their
words: among 10^13 windows two different ones agree with a chance below 10^-12. Repeats inside
a block are found there and are not sent. What leaves a block is packed: sorted hashes,
cut by ranges into buckets, at most one entry for each distinct window and block. So a
passage that a third of all documents share brings one entry a block into its bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import words as W
from tidefold.llm.blocks import across_blocks, blocks, joined, split, unpack
from tidefold.llm.shared import table, tidy, written

BUCKET_ENTRIES, BLOCK_BYTES = 1 << 18, 3 << 20
LEAST = 5  # words at the first level
WORDS, REMOVED = "substring_words", "substring_removed"
_LAST = np.iinfo(np.int64).max


class _Texts:
    """The texts of a block as word hashes, with the bounds of each text's words."""

    def __init__(self, rows: pa.Table, id_col: str, text_col: str):
        self.ids = rows.column(id_col).cast(pa.int64()).combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.texts = rows.column(text_col).cast(pa.large_binary()).to_pylist()
        found, bounds, size, first = [], [np.zeros(1, np.int64)], 0, 0
        for i, x in enumerate(self.texts):
            size += len(x or b"")
            if size >= W.PIECE or i == len(self.texts) - 1:
                h, b = W.hash_texts(self.texts[first : i + 1], False)
                found.append(h)
                bounds.append(b[1:] + bounds[-1][-1])
                size, first = 0, i + 1
        self.hashes = np.concatenate(found or [np.zeros(0, np.uint64)])
        self.bounds = np.concatenate(bounds)

    def windows(self, n: int) -> np.ndarray:
        """Positions at which a window of n words of one text starts."""
        lens = np.diff(self.bounds)
        left = np.repeat(self.bounds[1:], lens) - np.arange(len(self.hashes))
        return np.flatnonzero(left >= n)

    def stand_ins(self, n: int, part: int, at: np.ndarray) -> np.ndarray:
        """For each window of n words at `at`, the smallest hash of the windows of `part` words inside it."""
        low, span, want = W.runs(self.hashes, part), 1, n - part + 1
        while span * 2 <= want:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < want:
            low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
        return low[at]

    def both(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two hashes of the windows at `at`."""
        return W.runs(self.hashes, n)[at], W.runs(self.hashes, n, W.WEIGHTS_B)[at]

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document id and the offset in the document of word positions."""
        row = np.searchsorted(self.bounds, at, side="right") - 1
        return self.ids[row], at - self.bounds[row]


def lengths(n: int) -> list[int]:
    """The levels for windows of n words: each twice the one before, or one less than that, and n the last."""
    out = [n]
    while (out[0] + 1) // 2 >= LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _least(h: np.ndarray, more: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For windows in any order: an index of the first of equal ones, ordered by hash."""
    order = np.lexsort((start, ids, more, h))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(more[order]) != 0)
    return order[new]


def _repeats(h: np.ndarray, more: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows start earlier among these too."""
    order = np.argsort(h, kind="stable")
    same = np.diff(h[order]) == 0
    some = order[np.append(same, False) | np.insert(same, 0, False)] if len(h) else order
    some = some[np.lexsort((start[some], ids[some], more[some], h[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (np.diff(h[some]) != 0) | (np.diff(more[some]) != 0)
    first = some[new][np.cumsum(new) - 1] if len(some) else some
    out = np.zeros(len(h), bool)
    out[some] = (ids[some] != ids[first]) | (start[some] != start[first])
    return out


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of windows in rows of packed ones, sorted."""
    h, more = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("h", "more"))
    order = np.lexsort((more, h))
    return h[order], more[order]


def repeated_spans(rows: pa.Table, id_col: str, text_col: str, n: int, known: tuple[np.ndarray, np.ndarray]) -> tuple[_Texts, np.ndarray]:
    """A block's texts and which of its words go, given the sorted hashes of windows that start earlier elsewhere."""
    t = _Texts(rows, id_col, text_col)
    at = t.windows(n)
    h, more = t.both(n, at)
    repeat = _repeats(h, more, *t.places(at))
    if len(known[0]):
        left, right = (np.searchsorted(known[0], h, side=side) for side in ("left", "right"))
        for j in range(int((right - left).max(initial=0))):  # nearly always one
            here = np.flatnonzero(left + j < right)
            repeat[here] |= known[1][left[here] + j] == more[here]
    edge = np.zeros(len(t.hashes) + 1, np.int64)
    edge[at[repeat]] += 1
    edge[at[repeat] + n] -= 1
    return t, np.cumsum(edge[:-1]) > 0


def _without(data: bytes, gone: np.ndarray) -> bytes:
    """A text without some of its words; the rest stays as it is, and one space stands between its parts."""
    places = [(s, e) for _, s, e in W.pieces(data, False)]
    starts, ends = (np.concatenate([p[i] for p in places]) for i in (0, 1))
    edge = np.flatnonzero(np.diff(~gone, prepend=False, append=False))
    return b" ".join(data[starts[i] : ends[j - 1]] for i, j in zip(edge[0::2], edge[1::2]))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 20) -> DataFrame:
    """All rows and columns of docs, the text without words that repeated windows cover.

    Adds substring_words and substring_removed (long): words before, and words
    removed (columns of these names in the input are replaced). A text of which
    nothing goes stays as it is. Null texts stay null and have no words; texts of
    fewer than n words are never changed, and a text, however long, is worked on whole in one task. Rows with the same id are one document:
    windows at the same offset in them are not earlier than each other. Rows
    without an id count as one document after all others. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    docs = docs.drop(WORDS, REMOVED)
    held = blocks(docs, "substring", BLOCK_BYTES)
    size = held.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    many = docs.groupBy(F.col(id_col).alias("k")).count().filter("count > 1").limit(1).count() > 0
    *parts, _ = lengths(n)
    survivors, before, found, entries = None, None, 0, size // 6

    for part in parts:
        def candidates(rows: pa.Table, known: np.ndarray | None, part: int = part, before: int | None = before) -> np.ndarray:
            t = _Texts(rows, id_col, text_col)
            at = t.windows(n)
            if known is not None and len(at):
                at = at[_among(t.stand_ins(n, before, at), known)]
            return t.stand_ins(n, part, at) if len(at) else np.zeros(0, np.uint64)

        # of windows of w words, the smallest of s stands for (s + 1) / 2 positions
        expected = 2 * entries // (n - part + 2)
        survivors = written(across_blocks(held, candidates, int(expected // BUCKET_ENTRIES) + 1, survivors), f"level_{part}")
        found = (survivors.agg(F.sum(F.octet_length("h"))).first()[0] or 0) // 8
        before, entries = part, found * (n - part + 2) // 2
        if not found:
            break
    buckets = int(entries // BUCKET_ENTRIES) + 1

    def level_full(key, left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        out: dict[str, list] = {k: [] for k in ("bucket", "block", "h", "more", "ids", "start")}
        if left.num_rows and (right is None or right.num_rows):
            t = _Texts(unpack(left.column("rows")[0].as_py()), id_col, text_col)
            at = t.windows(n)
            if before is not None:
                at = at[_among(t.stand_ins(n, before, at), joined(right.column("h")))]
            h, more = t.both(n, at)
            ids, start = t.places(at)
            first = _least(h, more, ids, start)
            h, more, ids, start = h[first], more[first], ids[first], start[first].astype(np.int64)
            base = int(ids.min()) if len(ids) else 0
            narrow = len(ids) and int(ids.max()) - base < 1 << 16
            for bucket, i, j in split(h, buckets):
                out["bucket"].append(bucket)
                out["block"].append(left.column("block")[0].as_py())
                out["h"].append(h[i:j].tobytes())
                out["more"].append(more[i:j].tobytes())
                out["ids"].append(b"\x01" + base.to_bytes(8, "little", signed=True) + (ids[i:j] - base).astype(np.uint16).tobytes() if narrow else b"\x00" + ids[i:j].tobytes())
                out["start"].append(start[i:j].tobytes() if many else None)
        return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "block") else pa.binary()) for k, v in out.items()})

    def earlier_elsewhere(group: pa.Table) -> pa.Table:
        blobs, sizes, ids = group.column("h").to_pylist(), [], []
        for h, x in zip(blobs, group.column("ids").to_pylist()):
            size = len(h) // 8
            sizes.append(size)
            ids.append(int.from_bytes(x[1:9], "little", signed=True) + np.frombuffer(x, np.uint16, offset=9).astype(np.int64) if x[0] else np.frombuffer(x, np.int64, offset=1))
        h, more, ids = np.frombuffer(b"".join(blobs), np.uint64), _packed(group.column("more"), np.uint64), np.concatenate(ids)
        start = _packed(group.column("start"), np.int64) if many else np.zeros(len(h), np.int64)
        own = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((start, ids, more, h))
        same = (np.diff(h[order]) == 0) & (np.diff(more[order]) == 0)
        group_of = np.concatenate([[0], np.cumsum(~same)])
        first = order[np.concatenate([[True], ~same])][group_of]
        late = (ids[order] > ids[first]) | (start[order] > start[first])
        kept = order[late]
        gone, gone_more = _by_owner(h, kept, own, len(sizes)), _by_owner(more, kept, own, len(sizes))
        return pa.table({"block": group.column("block").cast(pa.int64()), "h": pa.array(gone, pa.binary()), "more": pa.array(gone_more, pa.binary())}).filter(pa.array([bool(g) for g in gone], pa.bool_()))

    rows, schema = held.select("block", "rows"), "bucket long, block long, h binary, more binary, ids binary, start binary"
    if before is None:  # windows so short that there is no level below
        full = rows.groupBy("block").applyInArrow(lambda block: level_full(None, block, None), schema)
    else:
        full = rows.groupBy("block").cogroup(survivors.groupBy("block")).applyInArrow(level_full, schema)
    late = full.groupBy("bucket").applyInArrow(earlier_elsewhere, "block long, h binary, more binary")
    if parts and not found:
        late = spark.createDataFrame([], late.schema)

    def without(key, left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        if not left.num_rows:
            return empty
        rows = unpack(left.column("rows")[0].as_py())
        t, gone = repeated_spans(rows, id_col, text_col, n, _pairs(right))
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[t.bounds[1:]] - sums[t.bounds[:-1]]
        texts = [_without(x, gone[t.bounds[i] : t.bounds[i + 1]]) if removed[i] else x for i, x in enumerate(t.texts)]
        at = rows.schema.get_field_index(text_col)
        rows = rows.set_column(at, text_col, pa.array(texts, pa.binary()).cast(pa.string()))
        return rows.append_column(WORDS, pa.array(np.diff(t.bounds), pa.int64())).append_column(REMOVED, pa.array(removed, pa.int64()))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType

    schema = docs.schema.add(WORDS, LongType()).add(REMOVED, LongType())
    empty = to_arrow_schema(schema).empty_table()
    return held.select("block", "rows").groupBy("block").cogroup(late.groupBy("block")).applyInArrow(without, schema)


def _packed(col: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype)


def _by_owner(h: np.ndarray, kept: np.ndarray, own: np.ndarray, n: int) -> list[bytes]:
    kept = np.sort(kept)
    cuts = np.searchsorted(own[kept], np.arange(n + 1))
    return [h[kept[i:j]].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]


def op8(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return out.select("doc_id", F.col(WORDS).alias("n_words"), F.col(REMOVED).alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM rep),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
