"""Hints: writes kept for replicas that could not be reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators.fold import newest
from tidefold.plans.model import HINT_AGE_HOURS, HINT_CAP

_ORDER = ["created_at", "ver"]


def generated(tried: DataFrame) -> DataFrame:
    """(target_node, k, ver, op, v, created_at) of every write that failed, whether or not its quorum was reached."""
    return tried.where("NOT success").select(F.concat(F.lit("node"), F.col("n").cast("string")).alias("target_node"), "k", F.col("seq").alias("ver"), "op", "v", F.col("ts").alias("created_at"))


def counts(hints: DataFrame) -> DataFrame:
    return hints.groupBy("target_node").agg(F.count("*").alias("n"))


def capped(hints: DataFrame, cap: int = HINT_CAP) -> DataFrame:
    """The first `cap` hints of each node. Spark limits each task's rows before the shuffle, so a node sends at most cap rows from a task."""
    order = Window.partitionBy("target_node").orderBy(*_ORDER)
    return hints.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).drop("rn")


def expired(hints: DataFrame, as_of: Column, hours: int = HINT_AGE_HOURS) -> DataFrame:
    """(target_node, kept, removed): hints younger than the age stay, all others go."""
    young = F.col("created_at") > as_of - F.expr(f"INTERVAL {hours} HOURS")
    return hints.groupBy("target_node").agg(F.count_if(young).alias("kept"), F.count_if(~young).alias("removed"))


def live(hints: DataFrame, as_of: Column, hours: int = HINT_AGE_HOURS) -> DataFrame:
    return hints.where(F.col("created_at") > as_of - F.expr(f"INTERVAL {hours} HOURS"))


def remove_at(hints: DataFrame, index: int) -> DataFrame:
    """Each node's hints but the one at an index, from 0; an index beyond the end removes nothing.

    The one to go is found among the first index + 1 of a node, so only these are sorted.
    """
    rest = [c for c in hints.columns if c != "target_node"]
    gone = capped(hints, index + 1).groupBy("target_node").agg(F.count("*").alias("n"), F.max_by(F.struct(*rest), F.struct(*_ORDER)).alias("r")).where(F.col("n") > index)
    return hints.join(gone.select("target_node", F.col("r.ver").alias("ver"), F.col("r.k").alias("k")), ["target_node", "ver", "k"], "left_anti").select(*hints.columns)


def clear(hints: DataFrame, node: str) -> DataFrame:
    return hints.where(F.col("target_node") != node)


def replay(replicas: DataFrame, hints: DataFrame) -> DataFrame:
    """(n, k, ver, op, v): replicas after their hints are delivered; the newest version stays."""
    late = hints.select(F.regexp_extract("target_node", r"(\d+)$", 1).cast("int").alias("n"), "k", "ver", "op", "v")
    return newest(replicas.select("n", "k", "ver", "op", "v").unionByName(late), "n", "k", by="ver")
