"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .session import cut

ROWS_AT_ONCE = 100_000


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the component's smallest node.

    Each round hangs all larger neighbours of a node on its smallest, then all
    smaller ones; the table never grows beyond nodes plus edges, and a hub's rows
    are reduced by partial minima before they are shuffled. Ends when a round
    changes nothing, which takes a few rounds more than the logarithm of the longest
    path; no end after ``rounds`` is an error. Edges of a node to itself and nulls are
    left out.

    Tables are small beside the documents: between shuffles they are held in a
    partition for each ``ROWS_AT_ONCE`` rows, so that a shuffle writes few small files.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, parts = state, state[0] // ROWS_AT_ONCE + 1
        few = lambda df: df.coalesce(parts)  # noqa: B023, E731
        both = few(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(few(few(small.where("u <> v")).distinct()))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root")).coalesce(parts)
