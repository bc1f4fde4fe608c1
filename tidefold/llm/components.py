"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.shared import apart, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _with_least(edges: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, m): m is the least neighbour of x, or x itself. A node with very many edges may be split over tasks."""
    least = edges.groupBy(x).agg(F.min(y).alias("m")).select(apart(x).alias("k"), F.least(x, "m").alias("m"))
    return edges.join(least, F.col(x) == F.col("k")).drop("k")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node from which a lesser one can be reached; component is the least of these.

    Edges with a null end or with equal ends are ignored; repeated edges count once.
    Each step is written to the shared folder, so the plan never grows with the
    number of rounds, which is about the logarithm of the longest path.
    """
    edges = written(
        edges.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        if not now[0]:
            break
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        large = written(_with_least(both, "x", "y").where("y > x AND y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = _with_least(large, "u", "v")
        edges = written(
            small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct(), "small"
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
