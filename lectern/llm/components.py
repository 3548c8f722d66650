"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.landing import landed
from lectern.operators.joins import spread_join

MAX_ROUNDS = 64
# Links of one node that a task gets at most.
LINKS_PER_TASK = 100_000


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` of every node that has a link to another; root is the smallest node it can reach.

    Every round points the larger neighbours of each node to the smallest node around it (large star), then
    each node's smaller neighbours, and itself, likewise (small star). Minima are partial aggregates, so a node
    with very many links is summed up before it is shuffled, and its links meet its minimum in several tasks.
    Rounds are landed, and end when nothing changes.
    """
    edges = links.select(F.greatest(left, right).alias("node"), F.least(left, right).alias("root"))
    edges = landed(edges.where("node <> root").distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        large = _to_lowest(both, F.col("root") > F.col("node"), F.least(F.min("root"), F.col("node")))
        large = landed(large.select(F.col("root").alias("node"), F.col("low").alias("root")).distinct(), "large")
        down = _to_lowest(large, F.lit(True), F.min("root"))
        lowest = large.groupBy("node").agg(F.min("root").alias("low"))
        down = down.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        edges = landed(lowest.withColumnRenamed("low", "root").unionByName(down).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            return edges
    raise RuntimeError("the components have not settled")


def _to_lowest(links: DataFrame, taken: Column, low: Column) -> DataFrame:
    """Links with the ``low`` of their node. A node with very many links is dealt out over tasks."""
    lowest = landed(links.groupBy("node").agg(low.alias("low"), F.count_if(taken).alias("n_rows")), "lowest")
    return spread_join(links.where(taken), lowest.select("node", "low"), "node", counts=lowest.select("node", "n_rows"), rows_per_salt=LINKS_PER_TASK)


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("node", "root").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())
