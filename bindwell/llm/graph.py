"""Connected components by contraction, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindwell.llm.store import settled


def _ordered(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for the nodes of ``edges`` (longs ``a``, ``b``).

    Every round each node joins the neighbour with the smallest hash, if smaller than its own, and
    edges are rewritten to what their ends joined. Hashes make long chains fold in a number of
    rounds that is logarithmic in their length. All state is in DataFrames; a hub's edges are summed
    before they are shuffled and joined from stored tables, whose hot partitions can be split.
    """
    edges = settled(_ordered(edges))
    labels = None
    rest = edges
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("n"), F.col("b").alias("m")).union(rest.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("p"))
        parents = settled(both.groupBy("n").agg(F.least(F.min(rank("m")), F.first(rank("n")))["p"].alias("p")))
        if labels is None:
            labels = parents
        else:
            step = parents.select(F.col("n").alias("p"), F.col("p").alias("q"))
            labels = settled(labels.join(step, "p", "left").select("n", F.coalesce("q", "p").alias("p")))
        to_a, to_b = (parents.select(F.col("n").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        rest = settled(_ordered(rest.join(to_a, "a").join(to_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    smallest = settled(labels.groupBy("p").agg(F.min("n").alias("component")))
    return labels.join(smallest, "p").select(F.col("n").alias("node"), "component")
