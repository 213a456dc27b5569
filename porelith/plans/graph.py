"""Connected components of an undirected edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import dropped, staged


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _to_least(arcs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours, found by partial aggregation.

    A node with very many neighbours is a hot key of an inner join of exchanges, which adaptive execution splits.
    """
    least = arcs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return arcs.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node.  Loops and nulls are ignored, repeated edges count once.

    Each round is one table in the shared folder, so lineage stays short.  Rounds grow with the logarithm
    of the longest path.  An empty table gives an empty result.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    e = staged(e, "edges")
    mark = _mark(e)
    while mark[0]:
        arcs = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(arcs).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = _to_least(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = staged(small, "edges")
        dropped(e)
        e, before = new, mark
        mark = _mark(e)
        if mark == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
