"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of edges(a, b) with a <> b; component is the smallest node reached.

    Each round a node takes the least node beside it, and then the one that this took; edges are redrawn between what
    their ends took, and those within one are dropped, so every round works on what the one before has left. The smallest node
    of a component always takes itself, so it is what remains. Tables are written to the shared folder each round, which cuts
    the lineage. A node that takes in many others doesn't gather their rows in one task (see common.looked_up). Ends when no edge is left.
    """
    spark = edges.sparkSession
    plain = lambda df, a, b: df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left = common.save(spark, plain(edges, "a", "b"), "edges")
    taken: DataFrame | None = None
    for _ in range(max_rounds):
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        beside = common.save(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "beside")
        jumped = common.looked_up(beside, beside.select(F.col("node").alias("up"), F.col("up").alias("component")), "up").select("node", "component")
        labels = common.save(spark, jumped, "labels")
        if taken is None:
            after = labels
        else:
            further = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
            after = common.save(spark, common.looked_up(taken, further, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "components")
            common.drop_saved(spark, taken)
        ends = common.looked_up(left, labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
        ends = common.looked_up(ends, labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        redrawn = common.save(spark, plain(ends, "x", "y"), "edges")
        for old in (left, beside, *([] if taken is None else [labels])):
            common.drop_saved(spark, old)
        taken, left = after, redrawn
        if left.isEmpty():
            return taken
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
