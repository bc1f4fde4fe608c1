"""Quality classifier: perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model of the characters (UTF-16
units) of all documents labelled good. Documents are kept in blocks. Each block sends
out its different n-grams, with their counts in trusted text; sums over the corpus
are the model's counts. Joins sharded by n-gram, context and suffix turn every
n-gram that occurs anywhere into one log-probability, which goes back to the blocks
that have it, where the documents are scored. Nothing is sent once per word, and no
model is collected or broadcast.

A document is rejected if its perplexity, or the part of it that repeats itself,
exceeds that of nearly all trusted documents of its language by a margin. Repetition
is measured apart because a model of few characters finds it likely. How wide the
margins are is chosen from documents labelled bad. Short texts are drawn to the middle
of their language.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.blocks import blocks, unpack
from tidefold.llm.shared import apart, table, tidy, written

ORDER = 4
START = 2
QUANTILE, MARGIN, SHORT = 0.99, 1.25, 50
REPEAT, FEW_WORDS, REPEAT_MARGIN = 16, 4, 0.25
SLICE, BLOCK_BYTES = 1 << 19, 6 << 20
BINS = 200  # of a unit of ln(perplexity), and of the repeated part


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts as 64-bit numbers, the last unit lowest, and each text's bounds. A unit is 16 bits; START fills the context of the first ones."""
    units = [np.frombuffer((x or "").encode("utf-16-le", "surrogatepass"), np.uint16) for x in texts]
    lens = np.array([len(u) for u in units], np.int64)
    lead = np.full(ORDER - 1, START, np.uint16)
    every = np.concatenate([x for u in units for x in (lead, u)]) if units else np.zeros(0, np.uint16)
    wide = every.astype(np.uint64)
    out = wide.copy()
    for j in range(1, ORDER):
        out[j:] |= wide[:-j] << np.uint64(16 * j)
    ends = np.cumsum(lens + ORDER - 1)
    keep = np.ones(len(every), bool)
    for j in range(ORDER - 1):
        keep[ends - lens - 1 - j] = False
    return out[keep].view(np.int64), np.concatenate([[0], np.cumsum(lens)])


def repeated(g: np.ndarray, bounds: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """How much of each text repeats itself, 0 to 1: the larger of the shares of its REPEAT-unit windows that it had before, and of its words that equal the word before them.

    g, bounds: the n-grams of the texts. The share of words counts FEW_WORDS more, so that one doubled word is not much of a short text.
    """
    n, first = np.diff(bounds), REPEAT - ORDER
    owner = np.repeat(np.arange(len(texts)), n)
    h = owner.astype(np.uint64)
    for j in range(0, REPEAT, ORDER):
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h[j:] ^= g.view(np.uint64)[: max(0, len(g) - j)]
        h ^= h >> np.uint64(29)
    whole = np.arange(len(g)) - bounds[owner] >= first + ORDER - 1
    again = pd.Series(h[whole]).duplicated().to_numpy()
    windows = np.bincount(owner[whole][again], minlength=len(texts)) / np.maximum(n - REPEAT + 1, 1)
    doubled = []
    for x in texts:
        ws = (x or "").split()
        doubled.append(sum(map(operator.eq, ws, ws[1:])) / max(len(ws) - 1 + FEW_WORDS, 1))
    return np.maximum(windows, doubled)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about SLICE characters, each with its first one's place."""
    first = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= SLICE or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _places(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
            ids = unpack(blob, [id_col]).column(0).cast(pa.int64()).combine_chunks()
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(ids), block, np.int64)), "row": pa.array(np.arange(len(ids))), "id": ids})
    tidy()


def _distinct(text_col: str):
    """(block, g, n): the different n-grams of a block, with their counts in its trusted texts."""
    def count(key, held: pa.Table, marks: pa.Table) -> pa.Table:
        tidy()
        found, counts, own, n = [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if held.num_rows:
            texts = unpack(held.column("rows")[0].as_py(), [text_col]).column(0).to_pylist()
            trusted = np.zeros(len(texts), bool)
            trusted[marks.column("row").to_numpy()] = marks.column("trusted").to_numpy()
            for first, part in _slices(texts):
                g, bounds = grams(part)
                codes, own = pd.factorize(g)
                found.append(own)
                counts.append(np.bincount(codes[np.repeat(trusted[first : first + len(part)], np.diff(bounds))], minlength=len(own)))
        if found:
            codes, own = pd.factorize(np.concatenate(found))
            n = np.bincount(codes, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)
        return pa.table({"block": pa.array(np.full(len(own), key[0].as_py(), np.int64)), "g": pa.array(own), "n": pa.array(n)})

    return count


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of a table of counts c, from how many n-grams have a count of 1, 2, 3 and 4."""
    row = counts.agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] or 0 for i in range(1, 5))
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return tuple(min(i + 0.95, max(0.05, x)) for i, x in enumerate(d))


def _less(c, d):
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def log_probabilities(counted: DataFrame) -> DataFrame:
    """(g, lp): the natural log of every n-gram's probability; counted: (g, c), c the count in trusted text, 0 for those that are only asked for."""
    counted = written(counted, "counted")
    asked = counted.select("g")
    counts, lower = counted.where("c > 0").select(F.col("g").alias("k"), "c"), None
    bits = 16 * ORDER
    tables = []
    for order in range(ORDER, 0, -1):
        counts = written(counts, "counts")
        d = discounts(counts)
        by = counts.select(F.shiftrightunsigned("k", 16).alias("ctx"), "c")
        ctx = written(by.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(_less(F.col("c"), d)).alias("held")), "contexts")
        tables.append((order, bits, counts, ctx, d))
        bits -= 16
        mask = (1 << bits) - 1
        counts = counts.select(F.col("k").bitwiseAND(F.lit(mask)).alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    symbols = tables[-1][2].count() + 1
    out = asked.withColumn("p", F.lit(1.0 / symbols))
    for order, bits, counts, ctx, d in reversed(tables):
        mask = (1 << bits) - 1
        key = F.col("g") if bits == 64 else F.col("g").bitwiseAND(F.lit(mask))
        seen = counts.select(apart("k").alias("k"), (F.col("c") - _less(F.col("c"), d)).alias("kept"))
        given = ctx.select(apart("ctx").alias("ctx"), "total", "held")
        out = out.withColumns({"k1": key, "c1": F.shiftrightunsigned(key, 16)}).join(given, F.col("c1") == F.col("ctx"), "left").join(seen, F.col("k1") == F.col("k"), "left")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("kept", F.lit(0.0)) + F.col("held") * F.col("p")) / F.col("total"))
        out = written(out.select("g", p.alias("p")), "probabilities")
    return out.select("g", F.ln("p").alias("lp"))


def _score(text_col: str, id_col: str, lang_col: str):
    def score(key, held: pa.Table, known: pa.Table) -> pa.Table:
        tidy()
        if not held.num_rows:
            return SCORED.empty_table()
        rows = unpack(held.column("rows")[0].as_py(), [id_col, lang_col, text_col])
        have, lp = known.column("g").to_numpy(), known.column("lp").to_numpy()
        order = np.argsort(have)
        have, lp = have[order], lp[order]
        sizes, nll, again = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for _, texts in _slices(rows.column(text_col).to_pylist()):
            g, bounds = grams(texts)
            codes, found = pd.factorize(g)
            at = np.minimum(np.searchsorted(have, found), len(have) - 1)
            if not np.array_equal(have[at], found):
                raise ValueError("a block's n-grams changed between two readings")
            sums = np.concatenate([[0.0], np.cumsum(-lp[at][codes])])
            sizes.append(np.diff(bounds))
            nll.append(sums[bounds[1:]] - sums[bounds[:-1]])
            again.append(repeated(g, bounds, texts))
        sizes, nll, again = np.concatenate(sizes), np.concatenate(nll), np.concatenate(again)
        n = rows.num_rows
        block = held.column("block")[0].as_py()
        return pa.table({
            "block": pa.array(np.full(n, block, np.int64)), "row": pa.array(np.arange(n)), "id": rows.column(id_col).cast(pa.int64()).combine_chunks(),
            "lang": rows.column(lang_col).cast(pa.string()).combine_chunks(), "n": pa.array(sizes), "nll": pa.array(nll), "repeated": pa.array(again),
        }).cast(SCORED)

    return score


SCORED = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("nll", pa.float64()), ("repeated", pa.float64())])


def _quantile(scored: DataFrame, q: float, *keys: str) -> DataFrame:
    """(keys, x): the q-quantile of x, by counts of narrow ranges of it; the range's upper end."""
    bins = scored.groupBy(*keys, F.ceil(F.col("x") * BINS).alias("b")).count()
    order = Window.partitionBy(*keys).orderBy("b")
    every = Window.partitionBy(*keys)
    at = bins.withColumns({"upto": F.sum("count").over(order), "all": F.sum("count").over(every)})
    return at.where(F.col("upto") >= q * F.col("all")).groupBy(*keys).agg((F.min("b") / BINS).alias("x"))


def _cut(marked: DataFrame, most: DataFrame, reach: float) -> DataFrame:
    """(lang, limit): from the quantiles `most` (lang, x) up to `reach` more, the limit of x with the least sum of the shares of bad ones kept and trusted ones rejected; the largest of equals.

    marked: (lang, x, trusted), trusted false for bad ones. Where no bad one lies in between this is x + reach.
    """
    bins = marked.groupBy("lang", F.ceil(F.col("x") * BINS).cast("double").alias("b")).agg(F.count(F.when(F.col("trusted"), 1)).alias("good"), F.count(F.when(~F.col("trusted"), 1)).alias("bad"))
    ends = most.select("lang", (F.col("x") * BINS).alias("low"), ((F.col("x") + reach) * BINS).alias("high"))
    bins = bins.union(ends.select("lang", F.col("high") + 1, F.lit(0), F.lit(0))).groupBy("lang", "b").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    every = Window.partitionBy("lang")
    below = every.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    part = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.greatest(F.sum(c).over(every), F.lit(1))
    at = bins.select("lang", "b", (part("bad") - part("good")).alias("loss")).join(ends, "lang").where("b > low AND b <= high + 1")
    return at.groupBy("lang").agg((F.min_by("b", F.struct(F.round("loss", 9), -F.col("b"))) - 1).alias("b")).select("lang", (F.col("b") / BINS).alias("limit"))


def _limits(judged: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, limit, most_repeated) of every language with trusted text: the limits of x, the ln of perplexity, and of the repeated part.

    A bad document that the widest limit of one measure rejects does not narrow the other's.
    """
    known = judged.where("trusted IS NOT NULL")
    xs, rs = known.select("lang", "x", "trusted", "repeated"), known.select("lang", F.col("repeated").alias("x"), "trusted", F.col("x").alias("other"))
    x_low = written(_quantile(xs.where("trusted"), quantile, "lang"), "limits")
    r_low = written(_quantile(rs.where("trusted"), quantile, "lang"), "limits")
    reach = math.log(margin)
    open_x = xs.join(r_low.select("lang", (F.col("x") + REPEAT_MARGIN).alias("most")), "lang").where("trusted OR repeated <= most")
    open_r = rs.join(x_low.select("lang", (F.col("x") + reach).alias("most")), "lang").where("trusted OR other <= most")
    both = _cut(open_x, x_low, reach).join(_cut(open_r, r_low, REPEAT_MARGIN).withColumnRenamed("limit", "most_repeated"), "lang")
    return written(both, "limits")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """(blocks of docs, scores): scores has block, row, id, lang, n, perplexity, limit, repeated, most_repeated and kept for every row of docs.

    labels: (doc_id, quality, toxic). Text is trusted if it has a label and all its
    labels have quality 1 and not toxic 1, and bad if one has quality 0. Perplexity is that of a text's n characters
    together with SHORT more of its language's median, so short texts need not be
    judged apart; null and empty texts have n = 0. The limit of a language lies
    between its trusted documents' quantile and that times margin, that of the repeated
    part between their quantile and REPEAT_MARGIN more, where they part trusted and bad
    documents best; a language (null is one) without trusted text gets the limits of all
    languages together. Without any trusted text everything is kept. Rows without an id are scored, never trusted; repeated rows
    all count. A text, however long, is scored whole, in one task. An empty table gives
    empty scores. Other columns are not looked at. n counts
    UTF-16 units. A text's own U+0002 counts as the start of a text. Sets the session's
    Arrow batches to 1000 rows at most.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")).alias("good"), F.min("quality").alias("least")
    )
    good = good.where("good = 1 OR least = 0").select(apart("_id").alias("_id"), (F.col("good") == 1).alias("trusted"))
    held = blocks(docs, "quality", BLOCK_BYTES)
    places = held.select("block", "rows").mapInArrow(lambda it: _places(it, id_col), "block long, row long, id long")
    marks = written(places.join(good, F.col("id") == F.col("_id")).select("block", "row", "trusted"), "marks")
    rows = written(held.select("block", "rows").groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_distinct(text_col), "block long, g long, n long"), "grams")
    known = log_probabilities(rows.groupBy("g").agg(F.sum("n").alias("c"))).select(apart("g").alias("k"), "lp")
    known = rows.select("block", "g").join(known, F.col("g") == F.col("k")).select("block", "g", "lp")
    scored = held.select("block", "rows").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _score(text_col, id_col, lang_col), "block long, row long, id long, lang string, n long, nll double, repeated double"
    )
    scored = written(scored.join(marks, ["block", "row"], "left").withColumn("lang", F.coalesce("lang", F.lit(""))), "scored")

    plain = scored.where("trusted AND n > 0").withColumn("x", F.col("nll") / F.col("n"))
    middle = written(_quantile(plain, 0.5, "lang").withColumnRenamed("x", "mid"), "middle")
    over_all = _quantile(plain.withColumn("lang", F.lit("")), 0.5, "lang").first()
    mid = F.coalesce("mid", F.lit(over_all["x"] if over_all else 0.0))
    drawn = scored.join(middle, "lang", "left").withColumn("x", (F.col("nll") + SHORT * mid) / (F.col("n") + SHORT)).drop("mid")
    limits = _limits(drawn, quantile, margin)
    over_all = _limits(drawn.withColumn("lang", F.lit("")), quantile, margin).first()
    fallback = lambda c: F.coalesce(c, F.lit(over_all[c] if over_all else None).cast("double"))
    out = drawn.join(limits, "lang", "left").withColumns({"limit": F.exp(fallback("limit")), "most_repeated": fallback("most_repeated"), "perplexity": F.exp("x")})
    kept = (F.col("perplexity") <= F.col("limit")) & (F.col("repeated") <= F.col("most_repeated"))
    return held, out.select("block", "row", "id", "lang", "n", "perplexity", "limit", "repeated", "most_repeated", F.coalesce(kept, F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns. Nulls, long texts and empty tables as in quality()."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held, scores = quality(docs, labels, **options)
    empty = to_arrow_schema(docs.schema).empty_table()

    def keep(key, block: pa.Table, rejected: pa.Table) -> pa.Table:
        tidy()
        if not block.num_rows:
            return empty
        rows = unpack(block.column("rows")[0].as_py())
        kept = np.ones(rows.num_rows, bool)
        kept[rejected.column("row").to_numpy()] = False
        return rows.filter(pa.array(kept))

    return held.select("block", "rows").groupBy("block").cogroup(scores.where("NOT kept").select("block", "row").groupBy("block")).applyInArrow(keep, docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    scores = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[1]
    return scores.select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_chars"), F.round("perplexity", 4).alias("perplexity"), F.round("limit", 4).alias("limit"), "kept")
