"""Near-duplicate documents: MinHash, banding, verification, connected components.

1. Each text gets the least value of many universal hash functions over its
   word shingles. Texts with the same words in the same order fall into one class,
   whose smallest id stands for it from here on.
2. Bands of four minima put likely partners into buckets. In each bucket every
   member is paired with one pivot, never with all others. A pair is looked at
   closer if its signatures agree, and becomes a link if the full shingle sets do.
3. Links are joined to components. In buckets whose members are still in more than
   one component, those outside the largest get a pivot of their own, so that a second
   family of copies becomes a component too. What is left outside is held against all others by full
   sets, in cells of bounded size. So no link is lost by pairing with pivots alone.

Before 2, members that can't have a partner in their bucket go: a link needs common
shingles in proportion to both sets' sizes, and no more can be common than a text has
shingles that any other text in the buckets has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import words as W
from tidefold.llm.blocks import BLOCK_BYTES, across_blocks, blocks, unpack
from tidefold.llm.components import components
from tidefold.llm.shared import apart, table, text_batches, tidy, written

ROWS_PER_BAND = 4
MISS = 1e-7
OWN_ROWS, VISITORS = 128, 512
CELL_SHINGLES = 200_000
PIVOTS = 2  # rounds of them
BUCKET_ENTRIES = 1 << 18
BROADCAST_ROWS = 1_000_000


def n_bands(percent: int) -> int:
    """Bands at which a pair that is just similar enough stays unseen with a chance below MISS."""
    return max(4, math.ceil(math.log(MISS) / math.log(1 - min(0.99, percent / 100) ** ROWS_PER_BAND)))


def _shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in one array, and each text's bounds in it; a text of fewer than k words is one shingle."""
    lens = np.diff(bounds)
    counts = np.where(lens >= k, lens - k + 1, np.minimum(lens, 1))
    out = np.zeros(int(counts.sum()), np.uint64)
    to = np.concatenate([[0], np.cumsum(counts)])
    long = np.repeat(bounds[1:], lens) - np.arange(len(h)) >= k
    out[np.repeat(lens >= k, counts)] = W.runs(h, k)[np.flatnonzero(long)]
    for i in np.flatnonzero((lens > 0) & (lens < k)):
        out[to[i]] = W.runs(h[bounds[i] : bounds[i + 1]], int(lens[i]), W.WEIGHTS_B)[0]
    return out, to


def _sketches(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, k: int, bands: int) -> Iterator[pa.RecordBatch]:
    n = bands * ROWS_PER_BAND
    by, plus = W._stream(101, n) | np.uint64(1), W._stream(103, n)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_col))
        for rows, texts in W.batches(batch, text_col):
            h, bounds = W.hash_texts(texts, True)
            s, to = _shingles(h, bounds, k)
            full = np.flatnonzero(np.diff(to))
            minima = np.zeros((n, len(full)), np.uint64)
            for i in range(n if len(full) else 0):
                np.minimum.reduceat(s * by[i] + plus[i], to[full], out=minima[i])
            minima >>= np.uint64(32)
            keys = np.zeros((bands, len(full)), np.uint64)
            for b in range(bands):
                for r in range(ROWS_PER_BAND):
                    keys[b] += minima[b * ROWS_PER_BAND + r] * W.WEIGHTS[r]
                keys[b] = W.mix(keys[b] + W.WEIGHTS_B[b % 128] + np.uint64(b))
            sig = (minima & np.uint64(255)).astype(np.uint8).T.copy()
            place = {int(i): j for j, i in enumerate(full)}
            digests = [(h[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            c = np.array([[_total(d, W.WEIGHTS), _total(d, W.WEIGHTS_B)] for d in digests], np.uint64).reshape(-1, 2).view(np.int64)
            sets = [len(np.unique(s[to[i] : to[i + 1]])) for i in range(len(texts))]
            keys = keys.T.copy().view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "id": ids.slice(rows.start, rows.stop - rows.start).cast(pa.int64()), "n_shingles": pa.array(sets, pa.int64()),
                "c1": pa.array(c[:, 0], pa.int64()), "c2": pa.array(c[:, 1], pa.int64()),
                "bands": pa.array([keys[place[i]] if i in place else None for i in range(len(texts))], pa.list_(pa.int64())),
                "sig": pa.array([sig[place[i]].tobytes() if i in place else None for i in range(len(texts))], pa.binary()),
            })
    tidy()


def _total(words: np.ndarray, weights: np.ndarray) -> int:
    """A digest of a sequence of words: a polynomial with mixed terms."""
    at = np.arange(len(words), dtype=np.uint64) * weights[1] + weights[2]
    return int(W.mix((W.mix(words + at) * weights[3]).sum(dtype=np.uint64)[None] + np.uint64(len(words)))[0])


def _agree(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= least)) if batch.num_rows else batch.select([0, 1])


def _sets(squeezed: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted shingle sets of compressed texts."""
    un = zstandard.ZstdDecompressor()
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for i, z in enumerate(squeezed):
        held.append(un.decompress(z))
        size += len(held[-1])
        if size >= W.PIECE or i == len(squeezed) - 1:
            s, to = _shingles(*W.hash_texts(held, True), k)
            out += [np.unique(s[to[j] : to[j + 1]]) for j in range(len(held))]
            held, size = [], 0
    return out


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            za, zb = part.column(2).to_pylist(), part.column(3).to_pylist()
            texts = list({*za, *zb})
            sets = dict(zip(texts, _sets(texts, k)))
            linked = []
            for x, y in zip(za, zb):
                p, q = sets[x], sets[y]
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))
    tidy()


def _shared_counts(k: int):
    """(id, size, shared): of a text's set, how many shingles another text has too."""
    def count(key, block: pa.Table, known: pa.Table) -> pa.Table:
        tidy()
        ids, sizes, shared = [], [], []
        if block.num_rows:
            rows = unpack(block.column("rows")[0].as_py())
            ids, sets = rows.column("id").to_pylist(), _sets(rows.column("z").to_pylist(), k)
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            common = counts > 1
            elsewhere = np.frombuffer(b"".join(known.column("h").to_pylist()), np.uint64)
            common[np.searchsorted(values, elsewhere)] = True
            sizes = [len(s) for s in sets]
            shared = [int(common[np.searchsorted(values, s)].sum()) for s in sets]
        return pa.table({"id": pa.array(ids, pa.int64()), "size": pa.array(sizes, pa.int64()), "shared": pa.array(shared, pa.int64())})

    return count


def _cell(k: int, percent: int):
    """Links between a cell's visitors and its own rows: as many as join all components that any of them joins, so never more than there are components."""
    def links(cell: pa.Table) -> pa.Table:
        ids, comps, guest = (cell.column(c).to_numpy() for c in ("id", "comp", "guest"))
        out: list[tuple[int, int]] = []
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while c in above:
                above[c] = c = above.get(above[c], above[c])
            return c

        own = np.flatnonzero(~guest)
        if len(own) and guest.any():
            sets = _sets(cell.column("z").to_pylist(), k)
            sizes = np.array([len(s) for s in sets])
            values = np.concatenate([sets[i] for i in own])
            holder = np.repeat(np.arange(len(own)), sizes[own])
            order = np.argsort(values, kind="stable")
            values, holder = values[order], holder[order]
            for i in np.flatnonzero(guest):
                lo, hi = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], side="right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(holder[at], minlength=len(own))
                hit = (100 * both >= percent * (sizes[own] + sizes[i] - both)) & (comps[own] != comps[i])
                others, first = np.unique(comps[own[hit]], return_index=True)
                for c, j in zip(others.tolist(), own[hit][first]):
                    x, y = top(c), top(int(comps[i]))
                    if x != y:
                        above[x] = y
                        out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return links


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    to = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.int64()), "z": pa.array([to.compress(x.as_py() or b"") for x in texts], pa.binary())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets
    of k-word shingles (A-Z lower-cased). A text of fewer than k words is one
    shingle; null texts and texts without words have none and are linked with
    nothing. component is the smallest id reachable over links. Rows with the same
    id are one document with the links of all of them. Rows without an id are
    linked with nothing and have a null component. A text, however long, is worked on
    whole in one task. An empty table gives an empty table. Other columns are not looked
    at. Sets the session's Arrow batches to 1000 rows at most.
    """
    bands = n_bands(percent)
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = written(docs.mapInArrow(lambda it: _sketches(it, "id", "text", k, bands), "id long, n_shingles long, c1 long, c2 long, bands array<long>, sig binary"), "sketches")
    classes = written(base.where("id IS NOT NULL AND n_shingles > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep")), "classes")
    reps = base.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")

    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(apart("key").alias("k"))
    members = written(rows.join(shared, F.col("key") == F.col("k"), "left_semi"), "members")
    wanted = written(reps.select("id", "sig").join(members.select("id").distinct(), "id", "left_semi"), "signatures")
    ids = F.broadcast(wanted.select("id")) if wanted.count() <= BROADCAST_ROWS else wanted.select("id")
    texts = written(docs.mapInArrow(_squeezed, "id long, z binary").join(ids, "id", "left_semi"), "texts")

    held = blocks(texts, "near", BLOCK_BYTES // 4)
    total = base.agg(F.sum("n_shingles")).first()[0] or 0
    elsewhere = across_blocks(held, lambda t, _: np.concatenate(_sets(t.column("z").to_pylist(), k)), max(1, total // 4 // BUCKET_ENTRIES + 1))
    counts = held.select("block", "rows").groupBy("block").cogroup(elsewhere.groupBy("block")).applyInArrow(_shared_counts(k), "id long, size long, shared long")
    # of rows with the same id the most favourable count
    counts = written(counts.groupBy("id").agg(F.min("size").alias("size"), F.max(F.expr(f"shared * {100 + percent} div {percent}") - F.col("size")).alias("room")), "counts")
    members = members.join(counts, "id")
    for _ in range(2):
        members = written(members.select("key", "id", "size", "room"), "members")
        fit = members.groupBy("key").agg(F.min("size").alias("least"), F.max("room").alias("most"), F.count("*").alias("n")).where("n > 1")
        fit = fit.select(apart("key").alias("k"), "least", "most", "n")
        members = members.join(fit, F.col("key") == F.col("k")).where("room >= least AND size <= most")
    members = written(members.select("key", "id", "size", "n"), "live")

    n, t = bands * ROWS_PER_BAND, percent / 100
    least = t - 6.5 * math.sqrt(t * (1 - t) / n)

    def both(left: DataFrame, right: DataFrame, c: str) -> DataFrame:
        return left.join(right.select(F.col("id").alias("a"), F.col(c).alias("x")), "a").join(right.select(F.col("id").alias("b"), F.col(c).alias("y")), "b").select("a", "b", "x", "y")

    def linked(rows: DataFrame) -> DataFrame:
        """Links of the rows (key, id, n, comp) with their bucket's pivot, where that is of another component."""
        degree = rows.groupBy("id").agg(F.sum("n").alias("degree"))
        best = F.max_by(F.struct("id", "comp"), F.struct("degree", -F.col("id"))).alias("best")
        ranked = rows.join(degree, "id").groupBy("key").agg(best).select(apart("key").alias("k"), F.col("best.id").alias("pivot"), F.col("best.comp").alias("its"))
        pairs = rows.join(ranked, F.col("key") == F.col("k")).where("comp <> its")
        pairs = written(pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "pairs")
        likely = written(both(pairs, wanted, "sig").mapInArrow(lambda it: _agree(it, least), "a long, b long"), "likely")
        return written(both(likely, texts, "z").mapInArrow(lambda it: _verify(it, k, percent), "a long, b long").distinct(), "links")

    edges = linked(members.withColumn("comp", F.col("id")))
    for last in [False] * (PIVOTS - 1) + [True]:
        comps = components(edges)
        rows = written(members.join(comps, members.id == comps.node, "left").select("key", "id", "size", "n", F.coalesce("component", "id").alias("comp")), "rows")
        by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        mixed = by_comp.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "comp")).alias("top")).where("top.n < n").select(
            apart("key").alias("k"), F.greatest(F.ceil(F.col("n") / OWN_ROWS), F.ceil(F.col("size") / CELL_SHINGLES)).cast("int").alias("cells"),
            F.greatest(F.ceil((F.col("n") - F.col("top.n")) / VISITORS), F.ceil(F.col("size") * (1 - F.col("top.n") / F.col("n")) / CELL_SHINGLES)).cast("int").alias("guests"), F.col("top.comp").alias("main"),
        )
        if last:
            break
        outside = written(rows.join(mixed.select("k", "main"), F.col("key") == F.col("k")).where("comp <> main").select("key", "id", "n", "comp"), "outside")
        if outside.isEmpty():
            break
        edges = written(edges.union(linked(outside)), "links")

    left = rows.join(mixed, F.col("key") == F.col("k")).drop("k", "size", "n").join(texts, "id")
    i, j = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"), F.pmod(F.xxhash64(F.lit("guest"), "id"), F.col("guests")).cast("int")
    own = left.select("key", "id", "comp", "z", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("j"), F.lit(False).alias("guest"))
    guests = left.where("comp <> main").select("key", "id", "comp", "z", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("i"), j.alias("j"), F.lit(True).alias("guest"))
    more = own.union(guests).groupBy("key", "i", "j").applyInArrow(_cell(k, percent), "a long, b long")
    edges = written(edges.union(more.distinct()), "all_links")

    # an id whose rows have different texts joins their classes; only ids of several rows are looked up
    own = base.where("id IS NOT NULL AND n_shingles > 0").select("id", "c1", "c2")
    several = written(own.groupBy("id").agg(F.min(F.struct("c1", "c2")).alias("least"), F.max(F.struct("c1", "c2")).alias("most")).where("least <> most").select(apart("id").alias("k")), "several")
    several = own.join(several, F.col("id") == F.col("k")).select("id", F.col("c1").alias("k1"), apart("c2").alias("k2"))
    joined = classes.join(several, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2"))).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.union(joined))
    by_class = written(
        classes.join(found, classes.rep == found.node, "left").select("c1", apart("c2").alias("k2"), F.coalesce("component", "rep").alias("least")), "components"
    )
    by_class = by_class.withColumnRenamed("c1", "k1")
    out = base.join(by_class, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & F.col("id").isNotNull() & (F.col("n_shingles") > 0), "left")
    return out.select("id", "n_shingles", F.coalesce("least", "id").alias("component"))


def op2(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw FROM documents),
lw AS (SELECT doc_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM w),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[s:s + 4], ' ') END AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM lw WHERE len(ws) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM pr JOIN sz sa ON sa.doc_id = a JOIN sz sb ON sb.doc_id = b WHERE 100 * c >= 85 * (sa.n + sb.n - c)),
both_ways AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
reach AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, e.b FROM reach r JOIN both_ways e ON e.a = r.t),
comp AS (SELECT s AS doc_id, min(t) AS component_id FROM reach GROUP BY s)
SELECT d.doc_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d LEFT JOIN sz ON sz.doc_id = d.doc_id JOIN comp ON comp.doc_id = d.doc_id
"""
