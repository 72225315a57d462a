"""Connected components of a graph given as edges, by alternating large and small stars.

Every round replaces each node's edges by edges to its smallest neighbour, first towards larger
neighbours, then among the smaller ones; it ends when the edges are stars whose centres are the smallest
nodes. A round is aggregations with partial sums and joins on node ids, so a hub's edges are never gathered
in one task's memory, and its result is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(h, 32))).first())


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root: for every node with an edge to another node, the smallest node it can reach.

    Edges with a null end and loops are ignored, repeated edges count once, an edge's direction has no
    meaning; no edges give no rows. ``u`` and ``v`` are of one orderable type.
    """
    shared_dir(edges.sparkSession)
    a, b = F.col(u), F.col(v)
    edges = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = _kept(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
