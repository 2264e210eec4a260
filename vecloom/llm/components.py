"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the greater ones; small: the lesser) to the least of them."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of long nodes -> (node, label): the least node of its component.

    Nodes without edges don't appear. Each round is written to the shared folder, so a lost
    executor costs a part of one round, and the rounds grow with the logarithm of the nodes.
    """
    now = stored(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        if not state["n"]:
            break
        new = stored(_star(_star(now, True), False), "edges")
        drop_stored(now)
        now = new
    # every edge leads from a node to its component's least one
    pair = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label"))
    return pair.unionByName(pair.select(F.col("label").alias("node"), "label").distinct())
