"""The data model: change records, replicas, hints, and the defaults of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operation codes and defaults of the store.
PUT, DELETE = 1, 2
TOMBSTONE_BYTES = 13
ENTRY_OVERHEAD = 8
MEMTABLE_BYTES = 67_108_864
COMPACTION_TRIGGER = 4
BLOOM_KEYS, BLOOM_RATE = 10_000, 0.01
VIRTUAL_NODES = 256
REPLICAS, WRITE_QUORUM, READ_QUORUM = 3, 2, 2
HINT_CAP, HINT_AGE_HOURS = 10_000, 24
UINT32 = 4_294_967_295

CHANGE = "seq long, ts timestamp_ntz, op tinyint, k string, v binary"
HINT = "target_node string, key string, value binary, timestamp long, version long, created_at timestamp"

#: How many records of the change log make a run.
RUN_RECORDS = 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(events: DataFrame, run_records: int = RUN_RECORDS) -> DataFrame:
    """(k, op, v, seq, ts, tid): an events table as a change log; an error deletes the user's key, anything else writes it."""
    gone = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("k"), F.when(gone, DELETE).otherwise(PUT).alias("op"),
        F.when(~gone, F.col("props")).alias("v"), F.col("event_id").alias("seq"), "ts", F.expr(f"event_id div {run_records}").alias("tid"),
    )
