"""Replication: quorums, newest write wins, read repair.

Attempts are rows (seq, k, n, success, ...): one for each write and replica. A
replica's state is (n, k, ver, v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators.fold import newest
from tidefold.operators.ring import preference_list
from tidefold.plans.model import PUT, READ_QUORUM, REPLICAS, WRITE_QUORUM


def attempts(log: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """The log once for each replica, and whether the write got there: a fixed pattern of losses, for trials."""
    each = log.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
    return each.withColumn("success", (F.col("seq") * 7 + F.col("n") * 3) % 10 >= 3)


def write_quorum(tried: DataFrame, quorum: int = WRITE_QUORUM) -> DataFrame:
    acks = F.count_if("success")
    return tried.groupBy("seq").agg(acks.alias("acks"), (acks >= quorum).alias("quorum_ok"))


def resolve(responses: DataFrame, *keys: str) -> DataFrame:
    """The response of the largest (ts, version), then node, of each key; others are dropped."""
    rest = [c for c in responses.columns if c not in keys]
    return responses.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "version", "node_id")).alias("r")).select(*keys, "r.*")


def needs_read_repair(responses: DataFrame, *keys: str) -> DataFrame:
    differ = (F.min("ts") != F.max("ts")) | (F.min("version") != F.max("version"))
    return responses.groupBy(*keys).agg(((F.count("*") > 1) & differ).alias("needs_repair"))


def states(tried: DataFrame) -> DataFrame:
    """(n, k, ver, op, v): what each replica holds after the writes that reached it."""
    return tried.where("success").groupBy("n", "k").agg(F.max_by(F.struct("op", "v"), "seq").alias("r"), F.max("seq").alias("ver")).select("n", "k", "ver", "r.op", "r.v")


def quorum_read(replicas: DataFrame, quorum: int = READ_QUORUM) -> DataFrame:
    """(k, latest, v, found, replicas, status, needs_repair) for every key that any replica holds.

    v is the value of the newest version, found whether that is a value at all; without
    a quorum latest, v and found are null.
    """
    ok = F.count("*") >= quorum
    top = F.max_by(F.struct("op", "v"), "ver")
    return replicas.groupBy("k").agg(
        F.when(ok, F.max("ver")).alias("latest"), F.when(ok & (top["op"] == PUT), top["v"]).alias("v"), F.when(ok, top["op"] == PUT).alias("found"), F.count("*").alias("replicas"),
        F.when(ok, "ok").otherwise("quorum_not_reached").alias("status"), (ok & (F.min("ver") != F.max("ver"))).alias("needs_repair"),
    )


def outdated(replicas: DataFrame, quorum: int = 1) -> DataFrame:
    """(n, k, ver, latest, op, v): replicas behind the newest version of keys that at least `quorum` replicas hold, and that version's record."""
    top = replicas.groupBy("k").agg(F.max("ver").alias("latest"), F.max_by(F.struct("op", "v"), "ver").alias("r"), F.count("*").alias("held"))
    return replicas.select("n", "k", "ver").join(top, "k").where((F.col("ver") < F.col("latest")) & (F.col("held") >= quorum)).select("n", "k", "ver", "latest", "r.op", "r.v")


def read_repair_writes(replicas: DataFrame, quorum: int = READ_QUORUM) -> DataFrame:
    """(n, k, ver, op, v): the records to write to replicas that a quorum read found behind."""
    return outdated(replicas, quorum).select("n", "k", F.col("latest").alias("ver"), "op", "v")


def repaired(replicas: DataFrame, writes: DataFrame) -> DataFrame:
    """(n, k, ver, op, v): replicas after records were written to them; the newest version stays."""
    return newest(replicas.select("n", "k", "ver", "op", "v").unionByName(writes.select("n", "k", "ver", "op", "v")), "n", "k", by="ver")


def routed(log: DataFrame, ring: DataFrame) -> DataFrame:
    """attempts() along each key's preference list on a ring of nodes with numbered names: with node_id, and n its number."""
    each = preference_list(log, F.col("k"), ring).drop("h").withColumn("n", F.regexp_extract("node_id", r"(\d+)$", 1).cast("int"))
    return each.withColumn("success", (F.col("seq") * 7 + F.col("n") * 3) % 10 >= 3)


def cluster_put(tried: DataFrame, quorum: int = WRITE_QUORUM) -> DataFrame:
    """(seq, k, replicas, acks, status, hinted): the outcome of each routed write; hinted are the nodes for which a hint is kept, in order of the list."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "node_id", "success")))
    acks = F.count_if("success")
    each = tried.groupBy("seq", "k").agg(listed.alias("all"), acks.alias("acks"), F.when(acks >= quorum, "ok").otherwise("quorum_not_reached").alias("status"))
    names = lambda nodes: F.array_join(F.transform(nodes, lambda x: x["node_id"]), ",")
    return each.select("seq", "k", names(F.col("all")).alias("replicas"), "acks", "status", names(F.filter("all", lambda x: ~x["success"])).alias("hinted"))


def placement(located: DataFrame) -> DataFrame:
    """(node_id, pos, n): how many keys have a node at a position of their list."""
    return located.groupBy("node_id", "pos").agg(F.count("*").alias("n"))


def node_stats(replicas: DataFrame) -> DataFrame:
    """(node_id, n_keys, n_deleted, memtable_size) of each replica."""
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(13)) + 8
    return replicas.groupBy(F.concat(F.lit("node"), F.col("n").cast("string")).alias("node_id")).agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("op") == 2).alias("n_deleted"), F.sum(size).alias("memtable_size")
    )
