"""Sorted runs: flushing, layout, merging and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators import bloom
from tidefold.operators.fold import live, newest, value_bytes
from tidefold.plans.model import COMPACTION_TRIGGER, DELETE, MEMTABLE_BYTES, PUT


def flush(log: DataFrame) -> DataFrame:
    """(tid, k, op, v, seq): each run's newest record of a key, deletions kept."""
    return newest(log.select("tid", "k", "op", "v", "seq"), "tid", "k")


def index(runs: DataFrame) -> DataFrame:
    """(tid, k, data_offset): where each record starts in its run, 8 bytes a record besides key and value."""
    size = F.lit(8) + F.octet_length("k") + value_bytes(F.col("v"))
    order = Window.partitionBy("tid").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.select("tid", "k", (F.sum(size).over(order) - size).alias("data_offset"))


def footer(runs: DataFrame, filter_bits: int) -> DataFrame:
    """(tid, num_entries, index_offset, bloom_offset, bloom_len, file_bytes) of each run's file."""
    data = F.sum(F.lit(8) + F.octet_length("k") + value_bytes(F.col("v")))
    index_bytes = F.sum(F.lit(12) + F.octet_length("k"))
    bloom = 8 + -(-filter_bits // 8)
    return runs.groupBy("tid").agg(F.count("*").alias("num_entries"), data.alias("index_offset"), (data + index_bytes).alias("bloom_offset")).select(
        "tid", "num_entries", "index_offset", "bloom_offset", F.lit(bloom).cast("long").alias("bloom_len"), (F.col("bloom_offset") + bloom + 28).alias("file_bytes")
    )


def tier_order(runs: DataFrame) -> DataFrame:
    """(tid, tier_rank, lex_rank): newest first by number, and as file names would sort."""
    ids = runs.select("tid").distinct()
    name = F.concat(F.lit("sstable_"), F.col("tid").cast("string"), F.lit(".db"))
    return ids.select("tid", F.row_number().over(Window.orderBy(F.desc("tid"))).alias("tier_rank"), F.row_number().over(Window.orderBy(F.desc(name))).alias("lex_rank"))


def merge(runs: DataFrame) -> DataFrame:
    """(k, v): all runs merged, newest run first, deletions dropped; right only if every run takes part."""
    return live(newest(runs.select("k", "tid", "op", "v"), "k", by="tid")).select("k", "v")


def partial_merge(runs: DataFrame, tids: list[int]) -> DataFrame:
    """The runs with some merged into the newest of them. Deletions stay, since older runs may hold the key; all others pass."""
    picked = F.col("tid").isin(tids)
    merged = newest(runs.where(picked), "k", by="tid").withColumn("tid", F.lit(max(tids)).cast("long"))
    return runs.where(~picked).unionByName(merged.select(*runs.columns))


def merge_stats(runs: DataFrame, by: str = "tid", keep_deletions: bool = False) -> DataFrame:
    """(entries_in, keys, keys_removed, bytes_reclaimed): removed are deletions that survive the merge; bytes are all input less what stays. A merge that keeps deletions removes no key."""
    size = F.octet_length("k") + value_bytes(F.col("v"))
    per_key = runs.groupBy("k").agg(F.count("*").alias("n"), F.sum(size).alias("all"), F.max_by(F.struct("op", size.alias("size")), by).alias("r"))
    stays = (F.col("r.op") == PUT) | F.lit(keep_deletions)
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries_in"), F.count("*").alias("keys"), F.count(F.when((F.col("r.op") == DELETE) & ~stays, 1)).alias("keys_removed"),
        F.coalesce(F.sum(F.col("all") - F.when(stays, F.col("r.size")).otherwise(0)), F.lit(0)).alias("bytes_reclaimed"),
    )


def compaction_trigger(runs: DataFrame, limit: int = COMPACTION_TRIGGER) -> DataFrame:
    n = F.count_distinct("tid")
    return runs.agg(n.alias("n_tables"), (n > limit).alias("should_compact"))


def read_amplification(runs: DataFrame) -> DataFrame:
    return runs.groupBy("k").agg(F.count("*").alias("tables_with_key"), F.max("tid").alias("newest"))


def as_written_get(runs: DataFrame) -> DataFrame:
    """(k, v) as a store answers whose memory tier (the newest run) hides nothing by deletions: older values show through."""
    last = runs.agg(F.max("tid").alias("last"))
    seen = runs.join(F.broadcast(last), (F.col("op") == PUT) | (F.col("tid") < F.col("last"))).drop("last")
    return merge(seen)


def exact_runs(log: DataFrame, limit: int = MEMTABLE_BYTES) -> DataFrame:
    """(seq, tid): runs as a memory table of `limit` bytes would fill them.

    Where a run ends depends on all before it, so this is one ordered pass in one task
    over (seq, k, size); for parity checks, not for large logs.
    """
    def walk(key, rows):
        rows = rows.sort_values("seq")
        held, total, tid, out = {}, 0, 0, []
        for k, size in zip(rows["k"], rows["size"]):
            total += size - held.get(k, 0)
            held[k] = size
            out.append(tid)
            if total >= limit:
                held, total, tid = {}, 0, tid + 1
        return rows.assign(tid=out)[["seq", "tid"]]

    sized = log.select("seq", "k", (F.octet_length("k") + value_bytes(F.col("v")) + 8).cast("long").alias("size"), F.lit(0).alias("all"))
    return sized.groupBy("all").applyInPandas(walk, "seq long, tid long")


def store_stats(log: DataFrame, asked: DataFrame, m: int, k: int) -> DataFrame:
    """One row: the newest run counts as memory table, the others as files; filters count for reading the keys asked (k, distinct).

    Merging all runs is counted as one compaction if there are enough of them, at the time of the last record.
    """
    runs = flush(log)
    size = F.octet_length("k") + value_bytes(F.col("v")) + 8
    by_run = runs.groupBy("tid").agg(F.sum(size).alias("size"))
    tables = by_run.agg(F.coalesce(F.max_by("size", "tid"), F.lit(0)).alias("memtable_size"), F.greatest(F.count("*") - 1, F.lit(0)).alias("num_sstables"))
    counters = bloom.hit_miss(runs, asked, m, k).select(F.col("hits").alias("bloom_filter_hits"), F.col("misses").alias("bloom_filter_misses"))
    merged = merge_stats(runs).select("keys_removed", "bytes_reclaimed")
    last = log.agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_compaction"))
    out = tables
    for one in (counters, merged, last):  # of one row each
        out = out.join(F.broadcast(one))
    return out.withColumn("total_compactions", (F.col("num_sstables") > COMPACTION_TRIGGER).cast("long"))
