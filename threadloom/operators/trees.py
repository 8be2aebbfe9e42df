"""Measures of reply trees: subtree sizes, depth-first order, depths.

All are sums over ways of a forest, found by pointer doubling on slim rows (node, parent and a number): after k rounds a
row knows what lies within 2^k steps, so a thread of depth d takes log2(d) joins, and no row holds a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.tables import cut


def subtree_sizes(built: DataFrame) -> DataFrame:
    """(node, size) of (node, parent): each node counted with all its descendants.

    Nodes are distinct, a null parent makes a root. At or below a circle there is no finite count: those nodes count what is
    reached until the ways meet, so callers cut circles first (as `forest` does). An empty table gives an empty one.
    """
    now = cut(built.select("node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")))
    while not now.where("up is not null").isEmpty():
        # what lies within 2^k below the nodes that are 2^k steps below
        below = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        over = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        now = cut(now.join(below, "node", "left").join(over, "up", "left").select("node", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    return now.select("node", "size")


def forest(built: DataFrame) -> DataFrame:
    """(node, parent, root, id, sent_at) of threads.build: mails on a circle, which it files at depth 0, are roots."""
    parent = F.when(F.col("depth") > 0, F.col("parent"))
    return built.select(F.col("mid").alias("node"), parent.alias("parent"), "root", "id", "sent_at")


def depth_first(nodes: DataFrame, *order: Column | str) -> DataFrame:
    """(node, place) of (node, parent, ...): the place of each node in the depth-first order of its tree, from 1.

    Children stand in the given order. A node stands behind its parent and behind the whole subtrees of its earlier
    siblings, so its place is a sum along its way to the root.
    """
    sized = nodes.join(subtree_sizes(nodes), "node")
    earlier = W.partitionBy("parent").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    child = sized.where("parent is not null").select("node", "parent", (F.lit(1) + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("step"))
    now = cut(child.unionByName(nodes.where("parent is null").select("node", "parent", F.lit(1).cast("bigint").alias("step"))).withColumnRenamed("parent", "up"))
    while not now.where("up is not null").isEmpty():
        over = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("step").alias("more"))
        now = cut(now.join(over, "up", "left").select("node", F.col("next").alias("up"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step")))
    return now.select("node", F.col("step").alias("place"))


def depth_histogram(built: DataFrame) -> DataFrame:
    """(depth, mails) over all threads."""
    return built.groupBy("depth").agg(F.count("*").alias("mails"))


def by_root_date(built: DataFrame) -> DataFrame:
    """(root, place): threads by the instant of their root, latest first, unreadable dates last, ties by the stored order."""
    from threadloom.operators.knowledge import numbered

    roots = built.where("mid = root").select("root", F.struct((-F.coalesce(F.unix_micros("sent_at"), F.lit(-(1 << 62)))).alias("at"), "id").alias("_order"))
    return numbered(roots, "_order").select("root", F.col("n").alias("place"))
