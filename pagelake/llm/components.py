"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node in ``edges``: a, b.

    Each round, every node hooks to its least smaller neighbour, which gives a forest; pointers are doubled until they are
    roots; edges are relabelled by roots and those inside a tree dropped. The trees that are left at least halve, so
    the rounds are few however long the paths. Every step is a join or an aggregate, rows of a hub are
    dealt over several tasks, and nothing comes to the driver but counts.
    """
    left = stored(_ordered(edges), "edges")
    labels = None
    while not left.isEmpty():
        # A node's least neighbour: an aggregate that is mostly done before its shuffle, whatever a hub's degree.
        least = left.select(F.col("b").alias("node"), F.col("a").alias("up")).groupBy("node").agg(F.min("up").alias("up"))
        tops = left.select(F.col("a").alias("node")).distinct().join(least, "node", "left_anti").select("node", F.col("node").alias("up"))
        forest = stored(least.unionByName(tops), "forest")
        while True:
            up = forest.select(F.col("node").alias("up"), F.col("up").alias("top"))
            moved = stored(dealt_join(forest, up, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "forest")
            forest = moved.drop("moved")
            if moved.filter("moved").isEmpty():
                break
        if labels is None:
            labels = forest.select("node", F.col("up").alias("root"))
        else:
            to = forest.select(F.col("node").alias("root"), F.col("up").alias("top"))
            labels = stored(dealt_join(labels, to, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        a, b = forest.select(F.col("node").alias("a"), F.col("up").alias("x")), forest.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = stored(_ordered(dealt_join(dealt_join(left, a, "a"), b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        labels = edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, root; stored) after ``edges`` (a, b; stored) are added to their graph: only the components that these join are gone through."""
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        to = labels.select(F.col("node").alias(end), F.col("root").alias("top"))
        ends = stored(dealt_join(ends, to, end, "left").withColumn(end, F.coalesce("top", end)).drop("top"), "contracted")
    over = stored(components(ends), "joined")
    new = over.join(labels.select(F.col("root").alias("node")).distinct(), "node", "left_anti")
    to = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return dealt_join(labels, to, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(new)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
