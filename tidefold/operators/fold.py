"""Reading a change log: the newest record of a key counts, and a deletion is a record too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.plans.model import DELETE, ENTRY_OVERHEAD, PUT, TOMBSTONE_BYTES


def newest(log: DataFrame, *keys: str, by: str = "seq") -> DataFrame:
    """One record for each key, that of the largest `by`, deletions included.

    A hash aggregate that combines before the shuffle: a hot key sends one record from
    each task.
    """
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def live(folded: DataFrame) -> DataFrame:
    """What a reader sees of folded records."""
    return folded.where(F.col("op") == PUT)


def deleted(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("op") == DELETE)


def latest(log: DataFrame) -> DataFrame:
    return live(newest(log.select("k", "op", "v", "seq"), "k")).select("k", "v", "seq")


def latest_by_aggregates(log: DataFrame) -> DataFrame:
    """As latest(), by one aggregate for each column."""
    return log.groupBy("k").agg(F.max_by("op", "seq").alias("op"), F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq")).where(F.col("op") == PUT).select("k", "v", "seq")


def service_calls(calls: DataFrame) -> DataFrame:
    """calls (seq, verb, key, value) in order of seq, each with what the store answers then: success (put, delete), found and got (get).

    A GET sees the last PUT or DELETE of its key before it.
    """
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("verb").isin("PUT", "DELETE"), F.struct((F.col("verb") == "PUT").alias("there"), F.col("value").alias("v")))
    last, get = F.last(write, ignorenulls=True).over(before), F.col("verb") == "GET"
    seen = calls.select("*", last.alias("last"))
    found = F.coalesce(F.col("last.there"), F.lit(False))
    return seen.select("seq", "verb", "key", F.when(~get, F.lit(True)).alias("success"), F.when(get, found).alias("found"), F.when(get & found, F.col("last.v")).alias("got"))


def point_get(log: DataFrame, key: str) -> DataFrame:
    """(k, v, found), one row; the key's filter reaches the scan."""
    one = log.where(F.col("k") == key).agg(F.max_by(F.struct("op", "v"), "seq").alias("r"))
    found = F.coalesce(F.col("r.op") == PUT, F.lit(False))
    return one.select(F.lit(key).alias("k"), F.when(found, F.col("r.v")).alias("v"), found.alias("found"))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, v, found) for every row of keys."""
    have = latest(log).select("k", "v", F.lit(True).alias("found"))
    return keys.join(have, "k", "left").select("k", "v", F.coalesce("found", F.lit(False)).alias("found"))


def missing(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(latest(log).select("k"), "k", "left_anti")


def range_scan(log: DataFrame, low: str, high: str) -> DataFrame:
    """Extension: live records with low <= k < high, bytewise."""
    return latest(log.where((F.col("k") >= low) & (F.col("k") < high)))


def value_bytes(v: Column) -> Column:
    """Length of a value; a deletion counts as its marker."""
    return F.coalesce(F.octet_length(v), F.lit(TOMBSTONE_BYTES))


def memtable_size(folded: DataFrame) -> DataFrame:
    return folded.agg(F.coalesce(F.sum(F.octet_length("k") + value_bytes(F.col("v")) + ENTRY_OVERHEAD), F.lit(0)).alias("memtable_bytes"), F.count("*").alias("n_keys"))


def record_stats(log: DataFrame) -> DataFrame:
    """(op, n, wal_bytes): a record takes 17 bytes and its key and value."""
    size = F.lit(17) + F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    return log.groupBy("op").agg(F.count("*").alias("n"), F.sum(size).alias("wal_bytes"))
