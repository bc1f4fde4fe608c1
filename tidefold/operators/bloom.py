"""Bloom filters as relations: parameters, bits, bytes, probes and counters.

A key is tested against 64 runs at a time: for each bit, a number tells which of 64
runs have it set, and the conjunction over a key's bits tells which runs may hold it.
These numbers lie in one array for 64 runs, and keys come in blocks; every array meets
every block in a task, so no row for a key's bit is shuffled and nothing is broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.hashing import fnv_pair
from tidefold.plans.model import BLOOM_KEYS, BLOOM_RATE, UINT32

ABREAST = 64
#: Keys are dealt to so many blocks, whatever their number; arrays are put together from pieces of so many bits.
BLOCKS, PIECE = 256, 4096
#: Partitions of arrays and of blocks at most: each pair of them is a task.
SIDE = 32
#: Bytes of a filter that are put together as one number.
WORD = 7


def parameters(n: int = BLOOM_KEYS, p: float = BLOOM_RATE) -> tuple[int, int]:
    """(bits, hash functions) for n keys at a rate p of false positives."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def parameter_table(cases: DataFrame) -> DataFrame:
    """(n, p, m, k) of cases (n, p)."""
    n = F.col("n").cast("double")
    m = F.ceil(-n * F.log("p") / F.pow(F.log(F.lit(2.0)), F.lit(2)))
    return cases.withColumn("m", m.cast("long")).withColumn("k", F.ceil(F.col("m").cast("double") / n * F.log(F.lit(2.0))).cast("long"))


def _hashed(df: DataFrame) -> DataFrame:
    """df with h, the two hashes of k."""
    return df.withColumn("h", fnv_pair(F.col("k")))


def _each(m: int, k: int) -> list[Column]:
    """The bits of a key with hashes h: h1 + i * h2 in 32 bits, modulo m; some may be equal."""
    return [(F.col("h.h1") + F.col("h.h2") * i).bitwiseAND(F.lit(UINT32)) % m for i in range(k)]


def _places(m: int, k: int) -> Column:
    """The different bits of a key with hashes h."""
    return F.array_distinct(F.array(*_each(m, k)))


def bits(runs: DataFrame, m: int, k: int) -> DataFrame:
    """(tid, bit): the bits set in each run's filter."""
    return _hashed(runs.select("tid", "k")).select("tid", F.explode(_places(m, k)).alias("bit")).distinct()


def stats(set_bits: DataFrame, m: int, k: int) -> DataFrame:
    """(tid, bits_set, fill, fpr)."""
    fill = F.count("*").cast("double") / F.lit(float(m))
    return set_bits.groupBy("tid").agg(F.count("*").alias("bits_set"), F.round(fill, 6).alias("fill"), F.round(F.pow(fill, F.lit(float(k))), 6).alias("fpr"))


def _little(x: int) -> str:
    return x.to_bytes(4, "little").hex()


def filters(set_bits: DataFrame, m: int, k: int) -> DataFrame:
    """(tid, filter): each run's filter as bytes: m and k as 32-bit numbers, then the bits, the lowest of a byte first."""
    size = -(-m // 8)
    words = set_bits.select("tid", F.expr(f"(bit div 8) div {WORD}").alias("word"), F.expr("shiftleft(1L, cast(8 * (%d - (bit div 8) %% %d) + bit %% 8 as int))" % (WORD - 1, WORD)).alias("x"))
    blank = set_bits.select("tid").distinct().select("tid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-size // WORD) - 1).cast("long"))).alias("word"), F.lit(0).cast("long").alias("x"))
    whole = words.union(blank).groupBy("tid", "word").agg(F.bit_or("x").alias("x"))
    parts = whole.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("word", F.lpad(F.hex("x"), 2 * WORD, "0").alias("x")))).alias("parts"))
    digits = F.substring(F.array_join(F.transform("parts", lambda p: p["x"]), ""), 1, 2 * size)
    return parts.select("tid", F.unhex(F.concat(F.lit(_little(m) + _little(k)), digits)).alias("filter"))


def _number(data: Column, at: int) -> Column:
    """The 32-bit number at a byte, the lowest byte first."""
    return sum((F.conv(F.hex(F.substring(data, at + 1 + i, 1)), 16, 10).cast("long") * (1 << (8 * i)) for i in range(4)), F.lit(0).cast("long"))


def read_filters(rows: DataFrame) -> DataFrame:
    """(tid, m, k, bytes) of filters (tid, filter); those shorter than their head are left out."""
    return rows.where(F.octet_length("filter") >= 8).select("tid", _number(F.col("filter"), 0).alias("m"), _number(F.col("filter"), 4).alias("k"), F.expr("substring(filter, 9)").alias("bytes"))


def may_contain(parsed: DataFrame, keys: DataFrame) -> DataFrame:
    """(tid, k, may_contain) of a few filters as read_filters() gives them, and keys (tid, k) that are asked of each."""
    asked = _hashed(keys).join(parsed.withColumnRenamed("k", "hashes"), "tid")
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("hashes") - 1), lambda i: (F.col("h.h1") + F.col("h.h2") * i).bitwiseAND(F.lit(UINT32)) % F.col("m"))
    byte = lambda b: F.conv(F.hex(F.substring(F.col("bytes"), (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.forall(places, lambda b: F.getbit(byte(b), (b % 8).cast("int")) == 1)
    return asked.select("tid", "k", there.alias("may_contain"))


def _abreast(tid: str) -> tuple[Column, Column]:
    """(which 64 runs, the bit of a run among them)."""
    return F.expr(f"({tid} - pmod({tid}, {ABREAST})) div {ABREAST}"), F.expr(f"shiftleft(1L, cast(pmod({tid}, {ABREAST}) as int))")


def _arrays(runs: DataFrame, m: int, k: int) -> DataFrame:
    """(part, words): for 64 runs, words[b] tells which of them have bit b set, and words[m] which of them there are. Rows of runs (tid, k) may repeat.

    A run without a number is a part of its own that has no bits.
    """
    part, own = _abreast("tid")
    rows = _hashed(runs.select("tid", "k")).select(part.alias("part"), own.alias("own"), F.explode(F.array(*_each(m, k), F.lit(m).cast("long"))).alias("bit"))
    rows = rows.select("part", "bit", F.coalesce("own", F.when(F.col("bit") == m, F.lit(1).cast("long"))).alias("own")).where("bit IS NOT NULL AND own IS NOT NULL")
    blank = runs.select(part.alias("part")).distinct().select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m).cast("long"))).alias("bit"), F.lit(0).cast("long").alias("own"))
    whole = rows.union(blank).groupBy("part", "bit").agg(F.bit_or("own").alias("has"))
    pieces = whole.groupBy("part", F.expr(f"bit div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("bit", "has"))).alias("xs"))
    joined = pieces.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("piece", F.col("xs.has").alias("has")))).alias("xs"))
    return joined.select("part", F.flatten("xs.has").alias("words"))


def _tested(runs: DataFrame, keys: DataFrame, m: int, k: int) -> DataFrame:
    """keys (k and others), part, there, let: for every key and 64 runs, which runs there are and which of them let the key pass (none: 0 or null), as bits."""
    asked = _hashed(keys).select(*keys.columns, F.array(*[b.cast("int") for b in _each(m, k)]).alias("places"))
    blocks = asked.groupBy(F.expr(f"pmod(xxhash64(k), {BLOCKS})").alias("block")).agg(F.collect_list(F.struct(*asked.columns)).alias("asked")).select("asked")
    met = _arrays(runs, m, k).coalesce(SIDE).hint("shuffle_replicate_nl").crossJoin(blocks.coalesce(SIDE)).select("part", "words", F.inline("asked"))
    let = reduce(Column.bitwiseAND, [F.get("words", F.get("places", F.lit(i))) for i in range(k)])
    return met.select(*keys.columns, "part", F.get("words", F.lit(m)).alias("there"), let.alias("let"))


def passing(runs: DataFrame, keys: DataFrame, m: int, k: int) -> DataFrame:
    """(k, part, let): for keys (k, distinct), which of the 64 runs of a part let the key pass, as bits; parts where none does are left out."""
    return _tested(runs, keys.select("k"), m, k).where("let <> 0").select("k", "part", "let")


def probe(runs: DataFrame, keys: DataFrame, m: int, k: int) -> DataFrame:
    """(tid, k, present) for every run whose filter lets a key of keys (k, distinct) pass; all other runs don't hold it."""
    let = passing(runs, keys, m, k)
    places = F.filter(F.sequence(F.lit(0), F.lit(ABREAST - 1)), lambda i: F.getbit("let", i) == 1)
    pairs = let.select("k", "part", F.explode(places).alias("i")).select((F.col("part") * ABREAST + F.col("i")).alias("tid"), "k")
    return pairs.join(runs.select("tid", "k", F.lit(True).alias("there")), ["tid", "k"], "left").select("tid", "k", F.coalesce("there", F.lit(False)).alias("present"))


def hit_miss(runs: DataFrame, keys: DataFrame, m: int, k: int) -> DataFrame:
    """(hits, misses, hit_rate) of reads of keys (k) that go from the newest run on and stop where the key is: a skipped run is a hit, a searched one a miss.

    No pair of key and run is listed: runs are counted by bits, from the newest down to the
    one that has the key. Rows of runs (tid, k) may repeat, so a log does as well.
    """
    held = runs.where("k IS NOT NULL").select("k", F.col("tid").cast("long").alias("tid"), F.lit(0).cast("long").alias("n"))
    asked = keys.select("k", F.lit(None).cast("long").alias("tid"), F.lit(1).cast("long").alias("n"))
    newest = held.union(asked).groupBy("k").agg(F.max("tid").alias("at"), F.sum("n").alias("n")).where("n > 0")
    first, from_ = _abreast("at")[0], F.expr(f"shiftleft(-1L, cast(pmod(at, {ABREAST}) as int))")
    newer = F.when(F.col("at").isNull() | (F.col("part") > first), F.lit(-1).cast("long")).when(F.col("part") == first, from_).otherwise(F.lit(0).cast("long"))
    counted = _tested(runs, newest, m, k).select("n", F.bit_count(F.col("there").bitwiseAND(newer)).alias("seen"), F.bit_count(F.col("let").bitwiseAND(newer)).alias("searched"))
    total = counted.agg(*[F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0).cast("long")).alias(c) for c in ("seen", "searched")])
    rate = F.when(F.col("seen") > 0, F.round((F.col("seen") - F.col("searched")).cast("double") / F.col("seen") * 100, 6)).otherwise(0.0)
    return total.select((F.col("seen") - F.col("searched")).alias("hits"), F.col("searched").alias("misses"), rate.alias("hit_rate"))
