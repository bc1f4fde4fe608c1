"""Consistent hashing: virtual nodes, arcs, owners and preference lists.

A ring of any size is a small table of arcs. Keys find their arc by an equality join
on the upper bits of their position and a comparison inside, so the work for a key
doesn't grow with the ring.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.hashing import ring_hash
from tidefold.plans.model import UINT32, VIRTUAL_NODES

CELL_BITS = 20


def _local(spark: SparkSession, rows: list[tuple], **kinds) -> DataFrame:
    """A small table held in the plan."""
    cols = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(cols, kinds.items())}))


def nodes(spark: SparkSession, names: list[str]) -> DataFrame:
    return _local(spark, [(n,) for n in names], node_id=pa.string())


def vnodes(members: DataFrame, count: int = VIRTUAL_NODES) -> DataFrame:
    """(node_id, vhash): each node's places on the ring; of equal places the last node, by name, stays."""
    count = count if count > 0 else VIRTUAL_NODES
    each = members.select("node_id").distinct().select("node_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    return each.select("node_id", ring_hash(F.concat("node_id", F.lit("-vnode-"), F.col("i").cast("string"))).alias("vhash")).groupBy("vhash").agg(F.max("node_id").alias("node_id"))


def arcs(places: DataFrame, n: int = 1) -> DataFrame:
    """(lo, hi, node_id, pref): positions above lo up to hi belong to node_id; pref are the first n different nodes from there on, clockwise.

    The places are collected: a ring has as many as its nodes have virtual ones, whatever
    it holds. The table of arcs is then known when queries over it are planned.
    """
    ring = sorted((r["vhash"], r["node_id"]) for r in places.select("vhash", "node_id").collect())
    total = len({node for _, node in ring})
    rows: list[tuple[int, int, str, list[str]]] = []
    ahead: list[str] = []
    for at in range(2 * len(ring) - 1, -1, -1):  # twice around, backwards: a node's next place is always known
        vhash, node = ring[at % len(ring)]
        ahead = [node, *(x for x in ahead if x != node)][:total]
        if at < len(ring):
            rows.append((ring[at - 1][0] if at else -1, vhash, node, ahead[:n]))
    if ring and ring[-1][0] < UINT32:
        rows.append((ring[-1][0], UINT32, rows[-1][2], rows[-1][3]))
    return _local(places.sparkSession, rows, lo=pa.int64(), hi=pa.int64(), node_id=pa.string(), pref=pa.list_(pa.string()))


def merged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lo, hi, old_node, new_node): the arcs of two rings over each other."""
    one, two = (sorted((r["hi"], r["lo"], r["node_id"]) for r in ring.select("lo", "hi", "node_id").collect()) for ring in (before, after))
    cuts = sorted({hi for ring in (one, two) for hi, _, _ in ring})
    rows, lo, i, j = [], -1, 0, 0
    for hi in cuts if one and two else []:
        rows.append((lo, hi, one[i][2], two[j][2]))
        lo, i, j = hi, i + (one[i][0] == hi), j + (two[j][0] == hi)
    return _local(before.sparkSession, rows, lo=pa.int64(), hi=pa.int64(), old_node=pa.string(), new_node=pa.string())


def locate(keys: DataFrame, key: Column, ring: DataFrame) -> DataFrame:
    """keys with h (their position) and what the arc they lie on has. ValueError for a ring without arcs."""
    if ring.isEmpty():
        raise ValueError("the ring has no nodes")
    cells = ring.select("*", F.explode(F.sequence(F.shiftright(F.greatest(F.col("lo") + 1, F.lit(0)), CELL_BITS), F.shiftright("hi", CELL_BITS))).alias("cell"))
    at = keys.withColumn("h", ring_hash(key))
    return at.join(cells, (F.shiftright("h", CELL_BITS) == F.col("cell")) & (F.col("h") > F.col("lo")) & (F.col("h") <= F.col("hi"))).drop("cell", "lo", "hi")


def preference_list(keys: DataFrame, key: Column, ring: DataFrame) -> DataFrame:
    """keys with pos (from 1) and node_id of every node on their list."""
    return locate(keys, key, ring).drop("node_id").select("*", F.posexplode("pref").alias("p", "node_id")).withColumn("pos", F.col("p") + 1).drop("p", "pref")


def rebalance(keys: DataFrame, key: Column, before: DataFrame, after: DataFrame) -> DataFrame:
    """(old_node, new_node, n): where keys lie on two rings; one look-up for both."""
    return locate(keys.select(key.alias("key")), F.col("key"), merged(before, after)).groupBy("old_node", "new_node").agg(F.count("*").alias("n"))


class Registry:
    """Names and addresses of nodes, with the ring they make."""

    def __init__(self, spark: SparkSession, virtual: int = VIRTUAL_NODES):
        self.spark, self.virtual, self.known = spark, virtual, {}

    def register(self, node_id: str, address: str) -> None:
        if node_id in self.known:
            raise ValueError(f"node {node_id} is registered already")
        self.known[node_id] = address

    def unregister(self, node_id: str) -> None:
        if node_id not in self.known:
            raise KeyError(f"node {node_id} is not registered")
        del self.known[node_id]

    def address(self, node_id: str) -> str:
        return self.known[node_id]

    def addresses(self) -> dict[str, str]:
        return dict(self.known)

    def __len__(self) -> int:
        return len(self.known)

    def table(self) -> DataFrame:
        return _local(self.spark, list(self.known.items()), node_id=pa.string(), address=pa.string())

    def ring(self, n: int = 1) -> DataFrame:
        if not self.known:
            raise ValueError("the ring has no nodes")
        return arcs(vnodes(self.table(), self.virtual), n)

    def nodes(self) -> list[str]:
        return sorted(self.known)

    def for_keys(self, keys: DataFrame, key: Column) -> DataFrame:
        return locate(keys, key, self.ring()).drop("pref", "h").join(F.broadcast(self.table()), "node_id")
