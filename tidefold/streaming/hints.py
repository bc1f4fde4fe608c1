"""Hints as a stream whose state forgets them at their age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.plans.model import HINT_AGE_HOURS


def expiring(hints: DataFrame, hours: int = HINT_AGE_HOURS, every: str = "1 hour") -> DataFrame:
    """(target_node, opened, removed): how many of a node's hints (target_node, created_at) go, span by span, once all of a span are older than the age.

    The watermark stays behind the newest hint by the age, so what the state holds are the
    hints still to be delivered, counted by node and span; spans it passes come out and
    are dropped. Hints that arrive when they are too old already count nowhere. For output mode append.
    """
    aged = hints.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", f"{hours} hours")
    spans = aged.groupBy("target_node", F.window("created_at", every).alias("w")).agg(F.count("*").alias("removed"))
    return spans.select("target_node", F.col("w.start").alias("opened"), "removed")


def clean(hints: DataFrame, path: str, checkpoint: str, hours: int = HINT_AGE_HOURS):
    """Start a query that writes what expiring() tells to path, as far as there is input, and goes on from there the next time."""
    return expiring(hints, hours).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
