"""Connected components of a large edge table by contraction.

Every node points to its least neighbour, pointers are shortened, and the edges are
relabelled; each round removes most edges, so chains of thousands of links take a few
rounds. Each round's tables are written to the shared folder. A hub with a third of all
edges is only ever the unique side of a join or a pre-aggregated key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.store import Stage


def components(edges: DataFrame, stage: Stage, tag: str) -> DataFrame:
    """``node``, ``comp`` for each node of edges (a, b), equal where nodes are connected; a written table."""
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels, k = None, 0
    while k == 0 or not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        up = stage.table(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("comp")), f"{tag}-up{k}")
        hop = lambda df, up=up: df.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        start = up if labels is None else hop(labels)
        # Two further steps up: to the parent's parent and beyond.
        labels = stage.table(hop(hop(start)), f"{tag}-labels{k}")
        name = lambda c, up=labels: up.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_"))
        moved = edges.select("a", "b").join(name("a"), "a").join(name("b"), "b").where("a_ <> b_")
        left = stage.table(moved.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct(), f"{tag}-left{k}")
        k += 1
    return labels
