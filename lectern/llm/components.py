"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, hot_joined, loop_tables


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it; ``total`` edges, by which a node with many is told."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return hot_joined(both.where("v > u"), least, ["u"], "n", 2 * total, most=2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = hot_joined(down, least, ["u"], "n", total, most=total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v long); root is the smallest node reached.

    Two shuffles of the edges a step, no step gathers a node's neighbours in one row or one task, and each round is
    written out.  The number of rounds grows with the logarithm of the longest path.  No edges, no rows.
    """
    mark = lambda df: df.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
    with loop_tables(edges.sparkSession) as written:
        edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before = mark(edges)
        for _ in range(max_rounds):
            if not before[0]:
                break
            edges = written(_large_star(edges, before[0]))
            edges = written(_small_star(edges, before[0]))
            after = mark(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
        return checkpointed(nodes.distinct())
