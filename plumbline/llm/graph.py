"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node with an edge in ``edges`` (a, b); root is the smallest node reachable.

    Each round hooks every root to its smallest neighbour, shortens the chains by pointer jumping and
    maps the edges to roots. At least half of the roots that still have edges go in a round. Null ends are left
    out, repeated edges and loops change nothing.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    labels = scratch.keep(nodes.select("node", F.col("node").alias("root")))
    left = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("parent"))
        hooks = scratch.keep(hooks.select("child", F.least("child", "parent").alias("parent")))
        while True:
            up = hooks.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
            jumped = scratch.keep(hooks.join(up, hooks.parent == up.c2).select("child", F.col("p2").alias("parent"), (F.col("p2") != F.col("parent")).alias("moved")))
            scratch.drop(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        new_labels = labels.join(hooks, labels.root == hooks.child, "left").select("node", F.coalesce("parent", "root").alias("root"))
        to = hooks.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
        mapped = left.join(hooks, left.a == hooks.child).select(F.col("parent").alias("x"), "b").join(to, F.col("b") == F.col("c2")).select("x", F.col("p2").alias("y"))
        new_left = mapped.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new_labels, new_left = scratch.keep(new_labels), scratch.keep(new_left)
        scratch.drop(labels, left, hooks)
        labels, left = new_labels, new_left
    return labels
