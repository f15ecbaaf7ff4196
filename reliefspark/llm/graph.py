"""Connected components of an edge table, with joins and minima only.

Alternating stars: the large star hangs every larger neighbour of a node on the node's smallest neighbour, the small
star does the same with the smaller ones.  Both keep the components and end in stars around their smallest members.
A hub costs a combined minimum and a join that adaptive execution may split; no neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefspark.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _round(edges: DataFrame) -> DataFrame:
    """One large and one small star over edges ``a > b``."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    hung = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node that has an edge to another one; the component is its smallest node.

    ``edges`` has two columns of one orderable type.  Loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (a.isNull() | b.isNull()).alias("open"))
    now = stored(edges.where("not open and a > b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now, before = stored(_round(now), "edges"), state
        state = _state(now)
        if state == before:
            break
    rows = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return rows.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
