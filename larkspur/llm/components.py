"""Connected components of links that live in Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, stage


def merge(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links: pairs of nodes (long).  node and comp (the smallest node reachable) of every node that has a link.

    Each round, every component takes the smallest label among its own and its
    neighbours', follows that label's own choice once more, and links inside a
    component go.  Labels only fall, and every link that is left joins two labels of
    which one falls, so the rounds end; stars end after one.
    """
    both = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = stage(both, "links")
    nodes = stage(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("comp")), "nodes")
    while edges.limit(1).count():
        low = edges.groupBy(F.col("b").alias("comp")).agg(F.min("a").alias("up"))
        low = stage(low, "lower")
        # twice: the label's own choice
        far = low.alias("x").join(low.alias("y"), F.col("x.up") == F.col("y.comp"), "left").select("x.comp", F.coalesce("y.up", "x.up").alias("up"))
        far = stage(far, "lower")
        moved = nodes.join(far, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        moved = stage(moved, "nodes")
        lifted = lambda c: far.select(F.col("comp").alias(c), F.col("up").alias(f"{c}2"))  # noqa: B023, E731
        rest = edges.join(lifted("a"), "a", "left").join(lifted("b"), "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        rest = stage(rest.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        drop(edges, nodes, low, far)
        edges, nodes = rest, moved
    drop(edges)
    return nodes
