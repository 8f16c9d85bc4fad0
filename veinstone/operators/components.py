"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.session import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b) with a > b: link neighbours to the least neighbour; only the larger ones (large) or only the
    smaller ones and the node itself (small)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every row of nodes(node); component is the least node of it. edges(a, b) in any direction; loops and
    repeats do no harm. No task gathers a neighbourhood: both rounds are a minimum by node and a join."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut(pairs)
    before = None
    for _ in range(max_rounds):
        last, pairs = pairs, cut(_star(_star(pairs, True), False))
        discard(last)
        print_ = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(print_) == before:
            break
        before = tuple(print_)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(pairs.withColumnRenamed("a", "node").withColumnRenamed("b", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
